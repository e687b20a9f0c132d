"""Queries of flattening and scalar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.toolchain import toolchain_bin as bins
from ..operators import flatten as FL
from . import adapters as A
from .registry import big, query, rounded, table

D = A.DOC_NODES_SQL
KEY = "sample::VARCHAR AS sample, 'func_' || ((unit + 1) * 70) AS unit"


def units(spark, sf):
    return FL.explode_units(A.graph_records(spark, sf))


@query("explode_units", f"""WITH {D}, n AS (SELECT sample, unit, count(*) AS n FROM dnodes GROUP BY ALL)
  SELECT l.sample::VARCHAR AS sample, 'func_' || ((l.unit + 1) * 70) AS unit, l.unit AS ord, (l.unit + 1) * 70 AS addr,
         coalesce(n, 0) AS n_nodes FROM dlines l LEFT JOIN n USING (sample, unit)""")
def explode_units(spark, sf):
    return big(units(spark, sf).select("sample", "unit", "ord", "addr", F.size("nodes").alias("n_nodes")), "n_nodes")


@query("explode_nodes", f"""WITH {D} SELECT {KEY}, idx, lower(token) AS token, idx // 4 AS block,
    CASE WHEN length(token) % 5 = 0 THEN token WHEN length(token) % 7 = 0 THEN token || '|alt' ELSE '' END AS api FROM dnodes""")
def explode_nodes(spark, sf):
    return FL.explode_nodes(units(spark, sf)).select("sample", "unit", "idx", "token", "block", F.array_join("api", "|").alias("api"))


@query("explode_blocks", f"WITH {D} SELECT {KEY}, idx // 4 AS addr, idx AS first_idx, 4 AS size FROM dnodes WHERE idx % 4 = 0")
def explode_blocks(spark, sf):
    return FL.explode_blocks(units(spark, sf)).select("sample", "unit", "addr", "first_idx", "size")


@query("explode_edges", f"""WITH {D} SELECT {KEY}, 'cfg' AS kind, idx - 1 AS src, idx AS dst FROM dnodes WHERE idx % 4 = 0 AND idx > 0
  UNION ALL SELECT {KEY}, 'seq', idx - 1, idx FROM dnodes WHERE idx % 4 <> 0""")
def explode_edges(spark, sf):
    return FL.explode_edge_lists(units(spark, sf), {"cfg": "edges_cfg", "seq": "edges_seq"})


@query("explode_evidence", f"WITH {D} SELECT {KEY}, 'T1' AS technique_id, 'r' AS rule_name FROM dlines WHERE unit % 5 <> 4")
def explode_evidence(spark, sf):
    return FL.explode_evidence(units(spark, sf), "node_indicators").select("sample", "unit", "technique_id", "rule_name")


@query("unit_position", """SELECT c_custkey, k, CASE c_custkey % 3 WHEN 2 THEN 0 ELSE c_custkey END AS position FROM (
    SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'func_' || c_custkey WHEN 1 THEN 'func_0x' || printf('%x', c_custkey)
           ELSE 'func_zz' END AS k FROM customer)""")
def unit_position(spark, sf):
    c = F.col("c_custkey")
    key = (F.when(c % 3 == 0, F.concat(F.lit("func_"), c.cast("string")))
           .when(c % 3 == 1, F.concat(F.lit("func_0x"), F.lower(F.hex(c)))).otherwise("func_zz"))
    return FL.unit_position(table(spark, sf, "customer").select("c_custkey", key.alias("k")), "k")


@query("normalize_api_name", "SELECT event_id, event_type AS api_name FROM events")
def normalize_api_name(spark, sf):
    raw = F.concat(F.lit("lib!x! "), "event_type", F.lit(" "))
    return FL.normalize_api_name(table(spark, sf, "events").select("event_id", raw.alias("raw")), "raw").drop("raw")


@query("qualified_api_name", """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN '?' ELSE lower(o_orderstatus) || '.dll' END || '!' || o_orderpriority AS qualified FROM orders""")
def qualified_api_name(spark, sf):
    dll = F.when(F.col("o_orderstatus") != "P", F.concat("o_orderstatus", F.lit(".DLL")))
    rows = table(spark, sf, "orders").select("o_orderkey", dll.alias("dll"), "o_orderpriority")
    return FL.qualified_api_name(rows, "dll", "o_orderpriority").drop("dll", "o_orderpriority")


NAMES = "CASE {0} WHEN 1 THEN 'reg' WHEN 2 THEN 'imm' WHEN 3 THEN 'mem' WHEN 4 THEN 'fp' ELSE 'op' || ({0}) END"


@query("instruction_token", f"""SELECT p_partkey, replace(lower(p_name), ' ', '.') || '_' || {NAMES.format('p_size % 6')} || '_' || {NAMES.format('p_size % 4')} AS token FROM part""")
def instruction_token(spark, sf):
    s = F.col("p_size")
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.lit(" "), F.upper("p_name")).alias("m"), F.array(s % 6, s % 4).alias("ops"))
    return FL.instruction_token(rows, "m", "ops").drop("m", "ops")


@query("statement_token", """WITH e AS (SELECT event_id, event_type AS t, (props->>'$.k')::BIGINT AS k FROM events)
  SELECT event_id, concat_ws(':', CASE t WHEN 'click' THEN 'Exit' WHEN 'view' THEN 'WrTmp' ELSE 'Put' END,
    CASE WHEN t = 'click' THEN 'Ijk_Boring' END, CASE WHEN k % 3 > 0 THEN 'Binop' END, CASE WHEN k % 3 = 2 THEN 'Iop_Add' END) AS token
  FROM e WHERE t <> 'error'""")
def statement_token(spark, sf):
    t, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    tag = (F.when(t == "click", "Ist_Exit").when(t == "view", "Ist_WrTmp").when(t == "error", "Ist_NoOp").otherwise("Ist_Put"))
    rows = table(spark, sf, "events").select("event_id", tag.alias("tag"), F.lit("Ijk_Boring").alias("jump"),
                                             F.when(k % 3 > 0, "Iex_Binop").alias("data"), F.when(k % 3 != 1, "Iop_Add").alias("op"))
    return FL.statement_token(rows, "tag", "jump", "data", "op").select("event_id", "token")


@query("sequence_tokens", """WITH b AS (SELECT user_id AS sample, event_type AS unit, event_id, unnest([event_type, props]) AS token,
    unnest([0, 1]) AS sub FROM events)
  SELECT sample, unit, row_number() OVER (PARTITION BY sample, unit ORDER BY event_id, sub) - 1 AS ord, token FROM b""")
def sequence_tokens(spark, sf):
    blocks = table(spark, sf, "events").select(F.col("user_id").alias("sample"), F.col("event_type").alias("unit"),
                                               F.col("event_id").alias("addr"), F.array("event_type", "props").alias("tokens"))
    return FL.sequence_tokens(blocks, "block")


@query("assign_call_positions", """WITH s AS (SELECT user_id AS sample, event_type AS unit, event_id, unnest(CASE WHEN event_id % 3 = 0 THEN [event_type, 'extra'] ELSE [event_type] END) AS api,
    unnest(CASE WHEN event_id % 3 = 0 THEN [0, 1] ELSE [0] END) AS nth FROM events)
  SELECT sample, unit, event_id::VARCHAR AS node_id, api, row_number() OVER (PARTITION BY sample, unit ORDER BY event_id, nth) - 1 AS position FROM s""")
def assign_call_positions(spark, sf):
    apis = F.when(F.col("event_id") % 3 == 0, F.array("event_type", F.lit("extra"))).otherwise(F.array("event_type"))
    sites = table(spark, sf, "events").select(F.col("user_id").alias("sample"), F.col("event_type").alias("unit"),
                                              F.col("event_id").cast("string").alias("node_id"), F.col("event_id").alias("addr"), apis.alias("apis"))
    return FL.assign_call_positions(sites)


def nodes(spark, sf):
    return A.order_nodes(spark, sf).withColumn("sample", F.lit(0))


@query("seq_edges", f"""WITH {A.ONODES_SQL} SELECT 0 AS sample, unit, lag(idx) OVER (PARTITION BY unit, block ORDER BY idx) AS src, idx AS dst
  FROM onodes QUALIFY src IS NOT NULL""")
def seq_edges(spark, sf):
    return FL.seq_edges(nodes(spark, sf))


@query("block_to_node_edges", f"""WITH {A.ONODES_SQL}, e AS (SELECT unit, block, min(idx) AS f, max(idx) AS l FROM onodes GROUP BY ALL)
  SELECT 0 AS sample, a.unit, a.l AS src, b.f AS dst FROM e a JOIN e b ON a.unit = b.unit AND b.block = (a.block + 1) % 3""")
def block_to_node_edges(spark, sf):
    links = A.order_units(spark, sf).select(F.lit(0).alias("sample"), "unit", F.explode(F.array(*[F.struct(
        F.lit(b).cast("long").alias("src"), F.lit((b + 1) % 3).cast("long").alias("dst")) for b in range(3)])).alias("e"))
    return FL.block_to_node_edges(nodes(spark, sf), links.select("sample", "unit", "e.*"))


TC = """p AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN ['.text', '.symtab'] WHEN 1 THEN ['CODE', '.bss'] WHEN 2 THEN ['.text', '.eh_fram']
    WHEN 3 THEN ['.text', '.bss', '.CRT'] WHEN 4 THEN ['.text', '.bss', '.edata', '.pdata'] ELSE ['.text'] END AS secs,
    CASE p_partkey % 5 WHEN 0 THEN ['libgcc_s.dll'] WHEN 1 THEN ['msvcrt.dll'] WHEN 2 THEN ['vcruntime140.dll', 'kernel32.dll']
    WHEN 3 THEN ['kernel32.dll'] ELSE ['api-ms-win-crt-runtime.dll', 'bcrypt.dll'] END AS imps,
    p_partkey % 17 AS lk, p_partkey % 7 = 0 AS rich, p_partkey % 11 = 0 AS dotnet, p_partkey % 13 AS mk FROM part),
  f AS (SELECT *, list_has_any(secs, ['.buildid', '.symtab']) AS go, list_has_any(secs, ['CODE', 'DATA', '.itext']) AS delphi,
    list_contains(secs, '.eh_fram') OR list_contains(imps, 'libgcc_s.dll') AS gnu,
    lk <= 2 AND NOT rich AND list_contains(secs, '.bss') AND (list_contains(secs, '.CRT') OR list_has_all(secs, ['.edata', '.pdata'])) AS layout,
    rich OR list_has_any(imps, ['vcruntime140.dll', 'api-ms-win-crt-runtime.dll']) OR (list_contains(imps, 'msvcrt.dll') AND lk >= 6) AS crt,
    CASE WHEN lk <= 10 THEN 'MSVC<=10' WHEN lk IN (11, 12) THEN 'MSVC 11-12' ELSE 'MSVC 14' END AS msvc,
    CASE WHEN lk <= 10 THEN 'MSVC<=10' WHEN lk IN (11, 12) THEN 'MSVC 11-12' WHEN lk >= 14 THEN 'MSVC 14' ELSE 'MSVC khac' END AS msvc2 FROM p)"""


@query("toolchain_bin", f"""WITH {TC} SELECT p_partkey,
    CASE WHEN go THEN 'Go' WHEN delphi THEN 'Delphi' WHEN gnu OR layout THEN 'GNU/MinGW' WHEN crt THEN msvc ELSE 'khac' END AS "full",
    CASE WHEN go THEN 'Go' WHEN delphi THEN 'Delphi' WHEN gnu THEN 'GNU/MinGW' WHEN crt THEN msvc ELSE 'khac' END AS no_layout,
    CASE WHEN dotnet THEN 'dotnet' WHEN go THEN 'Go' WHEN delphi THEN 'Delphi' WHEN gnu OR layout THEN 'GNU/MinGW' WHEN crt THEN msvc ELSE 'khac' END AS dotnet,
    CASE WHEN go THEN 'Go' WHEN delphi THEN 'Delphi' WHEN gnu OR layout THEN 'GNU/MinGW' WHEN crt THEN msvc ELSE 'khac' END AS records,
    CASE WHEN list_contains(secs, '.symtab') THEN 'Go' WHEN delphi THEN 'Delphi'
         WHEN list_contains(imps, 'libgcc_s.dll') OR (NOT rich AND list_contains(imps, 'msvcrt.dll') AND lk < 14) THEN 'GNU/MinGW'
         WHEN list_contains(imps, 'bcrypt.dll') THEN 'Rust?'
         WHEN rich OR list_has_any(imps, ['vcruntime140.dll', 'msvcrt.dll']) THEN msvc2 ELSE 'khac' END AS heuristic,
    CASE WHEN mk = 0 THEN 'Go' WHEN mk = 1 THEN 'Rust' WHEN mk = 2 THEN 'GNU/MinGW' WHEN mk = 3 OR list_contains(secs, 'CODE') THEN 'Delphi'
         WHEN rich OR list_has_any(imps, ['vcruntime140.dll', 'api-ms-win-crt-runtime.dll', 'msvcrt.dll']) THEN msvc2 ELSE 'khac' END AS strings FROM f""")
def toolchain_bin(spark, sf):
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    s, k = F.col("p_size") % 6, F.col("p_partkey")
    secs = (F.when(s == 0, arr(".text", ".symtab")).when(s == 1, arr("CODE", ".bss")).when(s == 2, arr(".text", ".eh_fram"))
            .when(s == 3, arr(".text", ".bss", ".CRT")).when(s == 4, arr(".text", ".bss", ".edata", ".pdata")).otherwise(arr(".text")))
    imps = (F.when(k % 5 == 0, arr("libgcc_s.dll")).when(k % 5 == 1, arr("msvcrt.dll")).when(k % 5 == 2, arr("vcruntime140.dll", "kernel32.dll"))
            .when(k % 5 == 3, arr("kernel32.dll")).otherwise(arr("api-ms-win-crt-runtime.dll", "bcrypt.dll")))
    m = k % 13
    marks = (F.when(m == 0, arr("go1.")).when(m == 1, arr("rustc")).when(m == 2, arr("GCC: (")).when(m == 3, arr("Borland")).otherwise(arr("none")))
    df = table(spark, sf, "part").select(
        "p_partkey", secs.alias("secs"), imps.alias("imps"), (k % 17).cast("double").alias("linker"), (k % 7 == 0).alias("rich"),
        (k % 11 == 0).alias("is_net"), marks.alias("marks"), (k % 5 == 0).alias("has_mingw"),
        (k % 5).isin(2, 4).alias("has_other_crt"), (k % 5 == 1).alias("has_msvcrt"))
    out = df.withColumn("dotnet", F.col("is_net"))
    for v in ("full", "no_layout", "records", "heuristic", "strings"):
        out = bins(out, v, v)
    return bins(out, "dotnet", "dotnet").select("p_partkey", "full", "no_layout", "dotnet", "records", "heuristic", "strings")


@query("epoch_year", """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE year(o_orderdate) END AS year FROM orders""")
def epoch_year(spark, sf):
    secs = F.when(F.col("o_orderkey") % 9 == 0, F.lit(0)).otherwise(F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    return FL.epoch_year(table(spark, sf, "orders").select("o_orderkey", secs.alias("ts")), "ts").drop("ts")


@query("confidence_tier", """SELECT p_partkey, CASE WHEN p_size % 8 = 0 THEN 'unknown' WHEN p_size >= 15 THEN 'high' WHEN p_size >= 5 THEN 'medium' ELSE 'low' END AS tier FROM part""")
def confidence_tier(spark, sf):
    votes = F.when(F.col("p_size") % 8 != 0, F.col("p_size"))
    return FL.confidence_tier(table(spark, sf, "part").select("p_partkey", votes.alias("votes")), "votes").drop("votes")


@query("consensus_label", """WITH v AS (SELECT user_id AS id, count(*) FILTER (value > 60 AND event_type NOT IN ('view', 'click')) AS n_votes FROM events GROUP BY user_id)
  SELECT id, n_votes, CASE WHEN n_votes >= 5 THEN 1 ELSE 0 END AS label FROM v WHERE n_votes >= 5 OR n_votes <= 2""")
def consensus_label(spark, sf):
    votes = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("voter"), (F.col("value") > 60).alias("vote"))
    return FL.consensus_label(votes, 5, 2, ["view", "click"])


@query("asset_pick", """WITH a AS (SELECT p_brand, p_partkey, p_size, CASE WHEN p_partkey % 4 = 0 THEN 'setup.exe' WHEN p_partkey % 4 = 1 THEN 'tool-x64.zip'
    WHEN p_partkey % 4 = 2 THEN 'tool.7z' ELSE 'tool-src.zip' END AS name FROM part),
  s AS (SELECT *, CASE name WHEN 'tool-x64.zip' THEN 0 WHEN 'tool.7z' THEN 1 WHEN 'setup.exe' THEN 2 END AS score FROM a)
  SELECT p_brand, p_partkey, p_size, name, score FROM s WHERE score IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY score, p_size, p_partkey) = 1""")
def asset_pick(spark, sf):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "setup.exe").when(k == 1, "tool-x64.zip").when(k == 2, "tool.7z").otherwise("tool-src.zip")
    rows = table(spark, sf, "part").select("p_brand", "p_partkey", "p_size", name.alias("name"))
    return FL.asset_pick(rows.withColumn("score", FL.asset_score(F.col("name"))), "p_brand", "score", "p_size", "p_partkey")
