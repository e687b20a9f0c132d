"""Test tables seen as operator inputs, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.rules import CHAIN, FAMILY, SET, Rule, rule_table
from ..scale import Carry, prefix_scan, ranked, spread
from .registry import table

WINDOW = 8

EVENT_RULES = (
    Rule("R1", "signup_funnel", CHAIN, apis=("signup", "view", "click", "purchase"), singleton=False,
         caveat="order of event names only"),
    Rule("R2", "error_burst", SET, apis=("error",)),
    Rule("R3", "cp_family", FAMILY, prefixes=("c", "p")),
)
ORDER_RULES = (Rule("O1", "line_chain", CHAIN, apis=("AO", "RF", "NO", "AF"), singleton=False),)


def event_rules(spark: SparkSession) -> DataFrame:
    return rule_table(spark, EVENT_RULES)


# ---- users' weeks as units, events as calls
def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sample"),
        F.concat_ws("|", "user_id", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")).alias("unit"),
        F.col("event_id").cast("string").alias("node_id"), F.col("event_type").alias("api"), "ts", "event_id")
    return ranked(ev, ["sample", "unit"], [F.col("ts"), F.col("event_id")], "position", 0).drop("ts", "event_id")


CALLS_SQL = """calls AS (
  SELECT user_id AS sample, user_id || '|' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS unit,
         event_id::VARCHAR AS node_id, event_type AS api,
         row_number() OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts, event_id) - 1 AS position
  FROM events)"""


def chain_sql(calls: str, apis: tuple[str, ...], window: int, prefix: str = "st") -> str:
    """CTEs of a greedy chain: one per step, each takes the next smallest position."""
    parts = [f"{prefix}1 AS (SELECT sample, unit, min(position) AS p1 FROM {calls} "
             f"WHERE api = '{apis[0]}' GROUP BY sample, unit)"]
    for i, api in enumerate(apis[1:], start=2):
        prev = ", ".join(f"s.p{j}" for j in range(1, i))
        parts.append(
            f"{prefix}{i} AS (SELECT s.sample, s.unit, {prev}, "
            f"CASE WHEN min(c.position) - s.p{i-1} <= {window} THEN min(c.position) END AS p{i} "
            f"FROM {prefix}{i-1} s LEFT JOIN {calls} c ON c.sample = s.sample AND c.unit = s.unit "
            f"AND c.api = '{api}' AND c.position > s.p{i-1} GROUP BY s.sample, s.unit, {prev})")
    n = len(apis)
    pairs = " UNION ALL ".join(
        f"SELECT sample, unit, p{i} AS pa, p{i+1} AS pb, p{n} IS NOT NULL AS whole FROM {prefix}{n} "
        f"WHERE p{i+1} IS NOT NULL" for i in range(1, n))
    return ",\n".join(parts) + f",\n{prefix}pairs AS ({pairs})"


EVENT_EDGES_SQL = CALLS_SQL + ",\n" + chain_sql("calls", EVENT_RULES[0].apis, WINDOW) + f""",
chain_edges AS (
  SELECT p.sample, p.unit, a.node_id AS src, b.node_id AS dst, 'R1' AS technique_id, 'signup_funnel' AS rule_name,
         CASE WHEN whole THEN 'full_chain' ELSE 'partial_chain' END AS confidence
  FROM stpairs p JOIN calls a ON a.sample = p.sample AND a.unit = p.unit AND a.position = p.pa
  JOIN calls b ON b.sample = p.sample AND b.unit = p.unit AND b.position = p.pb),
hits AS (
  SELECT *, 'R2' AS technique_id, 'error_burst' AS rule_name FROM calls WHERE api = 'error'
  UNION ALL SELECT *, 'R3', 'cp_family' FROM calls WHERE api[1] IN ('c', 'p')),
near AS (
  SELECT *, lag(node_id) OVER w AS before, lag(position) OVER w AS at_pos FROM hits
  WINDOW w AS (PARTITION BY sample, unit, technique_id ORDER BY position)),
pair_edges AS (
  SELECT sample, unit, before AS src, node_id AS dst, technique_id, rule_name, 'co_occurrence' AS confidence
  FROM near WHERE position - at_pos <= {WINDOW}),
singles AS (
  SELECT sample, unit, node_id, technique_id, rule_name FROM hits h WHERE NOT EXISTS (
    SELECT 1 FROM pair_edges e WHERE e.sample = h.sample AND e.unit = h.unit AND e.technique_id = h.technique_id
    AND (e.src = h.node_id OR e.dst = h.node_id))),
edges AS (SELECT * FROM chain_edges UNION ALL SELECT * FROM pair_edges),
evidence AS (
  SELECT sample, unit, technique_id, 'edge' AS kind FROM edges
  UNION ALL SELECT sample, unit, technique_id, 'indicator' FROM singles),
user_samples AS (
  SELECT user_id AS sample, user_id % 2 AS label, count(*) FILTER (event_type = 'error') AS votes
  FROM events GROUP BY user_id),
rule_names AS (SELECT * FROM (VALUES ('R1', 'signup_funnel'), ('R2', 'error_burst'), ('R3', 'cp_family'))
               t(technique_id, rule_name))"""


def user_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sample"))
            .agg(F.count_if(F.col("event_type") == "error").alias("votes"))
            .withColumn("label", F.col("sample") % 2))


# ---- customers' orders as units chained by date, line items as calls
def order_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = (table(spark, sf_dir, "lineitem")
          .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                  F.concat("l_returnflag", "l_linestatus").alias("api")))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_custkey").alias("sample"))
    seq = ranked(li.withColumnRenamed("l_orderkey", "unit"), ["unit"],
                 [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], "position", 0)
    return (seq.join(orders, "unit")
            .select("sample", "unit", F.concat_ws(":", "unit", "position").alias("node_id"), "api", "position"))


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    scan = prefix_scan(orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"), ["o_custkey"],
                       [F.col("o_orderdate"), F.col("o_orderkey")], src=Carry("prev", F.col("o_orderkey")))
    hops = scan.filter(F.col("src").isNotNull()).select(
        F.col("o_custkey").alias("sample"), "src", F.col("o_orderkey").alias("dst"))
    loops = orders.filter(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return hops.unionByName(loops)


ORDER_GRAPH_SQL = """ocalls AS (
  SELECT o_custkey AS sample, l_orderkey AS unit, l_orderkey || ':' || pos AS node_id, api, pos AS position FROM (
    SELECT l_orderkey, l_returnflag || l_linestatus AS api,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos
    FROM lineitem) JOIN orders ON o_orderkey = l_orderkey),
hops AS (
  SELECT o_custkey AS sample, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS src,
         o_orderkey AS dst FROM orders QUALIFY src IS NOT NULL),
ograph AS (SELECT * FROM hops UNION ALL
           SELECT o_custkey, o_orderkey, o_orderkey FROM orders WHERE o_orderstatus = 'F')"""


# ---- line items as nodes of orders (units) of customers (samples)
def order_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, unit) of every order."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("unit"))


def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("unit"), "l_linenumber", "l_partkey", "l_suppkey",
        F.concat_ws("_", F.lower("l_returnflag"), "l_linestatus").alias("token"),
        (F.col("l_suppkey") % 3).alias("block"),
        F.when(F.col("l_discount") > 0.05, F.concat(F.lit("api"), F.col("l_partkey") % 20)).alias("api"))
    return ranked(li, ["unit"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], "idx", 0) \
        .drop("l_linenumber", "l_partkey", "l_suppkey")


def order_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("sample"), (F.col("c_custkey") % 2).alias("label"),
        F.col("c_mktsegment").alias("split"))


ONODES_SQL = """onodes AS (
  SELECT l_orderkey AS unit, lower(l_returnflag) || '_' || l_linestatus AS token, l_suppkey % 3 AS block,
         CASE WHEN l_discount > 0.05 THEN 'api' || (l_partkey % 20) END AS api,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS idx
  FROM lineitem),
ounits AS (SELECT o_custkey AS sample, o_orderkey AS unit FROM orders),
osamples AS (SELECT c_custkey AS sample, c_custkey % 2 AS label, c_mktsegment AS split FROM customer)"""


# ---- documents as samples, lines as units, words as nodes
def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    lines = docs.select(F.col("doc_id").alias("sample"), F.posexplode(F.split("text", "\n")).alias("unit", "line"))
    return lines.select("sample", F.col("unit").cast("long").alias("unit"), F.posexplode(
        F.regexp_extract_all("line", F.lit("([^ \\n]+)"))).alias("idx", "token")).withColumn("idx", F.col("idx").cast("long"))


DOC_NODES_SQL = """dlines AS (
  SELECT doc_id AS sample, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS unit FROM documents),
dnodes AS (
  SELECT sample, unit, unnest(regexp_extract_all(line, '[^ \\n]+')) AS token,
         generate_subscripts(regexp_extract_all(line, '[^ \\n]+'), 1) - 1 AS idx FROM dlines)"""


# ---- documents joined to labels, as a labelled feature table
def digit_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    words = F.regexp_extract_all("text", F.lit("([^ \\n]+)"))
    return (docs.join(labels, "doc_id")
            .select("doc_id", "lang", "source", "n_chars", "quality", "toxic", words.alias("words"),
                    digit_count(F.col("text")).cast("double").alias("n_digits"),
                    F.size(F.split("text", "\n")).cast("double").alias("n_lines"))
            .withColumns({"n_words": F.size("words").cast("double"),
                          "distinct_ratio": F.coalesce(F.try_divide(F.size(F.array_distinct("words")).cast("double"),
                                                                    F.size("words").cast("double")), F.lit(0.0)),
                          "f_chars": F.col("n_chars").cast("double")}).drop("words"))


LABELLED_SQL = """labelled AS (
  SELECT doc_id, lang, source, n_chars, quality, toxic, n_digits, n_lines, n_words::DOUBLE AS n_words,
         CASE WHEN n_words = 0 THEN 0.0 ELSE n_distinct::DOUBLE / n_words END AS distinct_ratio,
         n_chars::DOUBLE AS f_chars
  FROM (SELECT d.*, quality, toxic, length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE AS n_digits,
               len(string_split(text, chr(10)))::DOUBLE AS n_lines,
               len(regexp_extract_all(text, '[^ \\n]+')) AS n_words,
               len(list_distinct(regexp_extract_all(text, '[^ \\n]+'))) AS n_distinct
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id))"""


# ---- pseudo-scores
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, id, label, score, cluster, bin) of three models; the third has missing scores."""
    base = (table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
            .join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id"))
    one = (F.col("n_chars") % 1000) / F.lit(1000.0)
    two = ((F.col("n_chars") * 7 + F.col("doc_id")) % 1000) / F.lit(1000.0)
    three = F.when(F.col("doc_id") % 11 != 0, two)
    return (base.withColumn("m", F.explode(F.array(
        F.struct(F.lit("a").alias("model"), one.alias("score")),
        F.struct(F.lit("b").alias("model"), two.alias("score")),
        F.struct(F.lit("c").alias("model"), three.alias("score")))))
        .select("m.model", F.col("doc_id").alias("id"), F.col("quality").alias("label"), "m.score",
                F.col("source").alias("cluster"), F.col("lang").alias("bin")))


SCORES_SQL = """scores AS (
  SELECT model, d.doc_id AS id, quality AS label, source AS cluster, lang AS bin,
         CASE model WHEN 'a' THEN (n_chars % 1000) / 1000.0::DOUBLE
                    WHEN 'b' THEN ((n_chars * 7 + d.doc_id) % 1000) / 1000.0::DOUBLE
                    ELSE CASE WHEN d.doc_id % 11 <> 0 THEN ((n_chars * 7 + d.doc_id) % 1000) / 1000.0::DOUBLE END
         END AS score
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id, (VALUES ('a'), ('b'), ('c')) m(model))"""


def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pseudo-scores per line item in long form, at the size of the fact table."""
    li = table(spark, sf_dir, "lineitem")
    seeds = [F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000]
    return li.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.explode(F.array(*[F.struct(F.lit(f"s{i}").alias("model"), s.alias("score"))
                            for i, s in enumerate(seeds)])).alias("m")).select("id", "label", "m.*")


LINE_SCORES_SQL = """line_scores AS (
  SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id,
         (l_returnflag = 'R')::INT AS label, model,
         CASE model WHEN 's0' THEN l_discount WHEN 's1' THEN l_tax WHEN 's2' THEN l_quantity / 50
                    ELSE l_extendedprice / 100000 END AS score
  FROM lineitem, (VALUES ('s0'), ('s1'), ('s2'), ('s3')) m(model))"""


# ---- events as address intervals
GAP_TOL, FAR_GAP, MIN_SPREAD, MAX_COVERAGE = 43_200, 259_200, 604_800, 0.15


def event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, unit, addr, size, first_idx) of one block per event."""
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("sample"), F.col("user_id").alias("unit"), "event_id",
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("addr"),
        (600 * (F.floor("value").cast("long") + 1)).alias("size"),
        (F.get_json_object("props", "$.k").cast("long") % 2 == 0).alias("linked"))
    return ranked(ev, ["sample", "unit"], [F.col("addr"), F.col("event_id")], "first_idx", 0)


def block_links(blocks: DataFrame) -> DataFrame:
    """CFG edges between consecutive blocks where the block's event is linked."""
    scan = prefix_scan(blocks, ["sample", "unit"], [F.col("first_idx")], src_idx=Carry("prev", F.col("first_idx")))
    return scan.filter(F.col("linked") & F.col("src_idx").isNotNull()).select(
        "sample", "unit", "src_idx", F.col("first_idx").alias("dst_idx"))


def unit_entries(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("sample", "unit").agg(F.min("addr").alias("entry"))


BLOCKS_SQL = """blocks AS (
  SELECT event_type AS sample, user_id AS unit, event_id, epoch(date_trunc('second', ts))::BIGINT AS addr,
         600 * (floor(value)::BIGINT + 1) AS size, (props->>'$.k')::BIGINT % 2 = 0 AS linked,
         row_number() OVER (PARTITION BY event_type, user_id ORDER BY epoch(date_trunc('second', ts)), event_id) - 1 AS first_idx
  FROM events),
running AS (
  SELECT *, max(addr + size) OVER (PARTITION BY sample, unit ORDER BY first_idx
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM blocks),
seg_blocks AS (
  SELECT *, (sum(CASE WHEN prev_end IS NULL OR addr > prev_end + 43200 THEN 1 ELSE 0 END)
            OVER (PARTITION BY sample, unit ORDER BY first_idx) - 1)::BIGINT AS seg FROM running),
segs AS (
  SELECT sample, unit, seg, min(addr) AS seg_start, max(addr + size) AS seg_end, count(*) AS n_blocks
  FROM seg_blocks GROUP BY sample, unit, seg),
entries AS (SELECT sample, unit, min(addr) AS entry FROM blocks GROUP BY sample, unit),
links AS (
  SELECT sample, unit, lag(seg) OVER w AS src_seg, seg AS dst_seg, linked FROM seg_blocks
  WINDOW w AS (PARTITION BY sample, unit ORDER BY first_idx)),
incoming AS (
  SELECT DISTINCT sample, unit, dst_seg AS seg, src_seg FROM links
  WHERE linked AND src_seg IS NOT NULL AND src_seg <> dst_seg)"""


# ---- documents as nested graph records: lines are units, words are nodes, four words a block
def graph_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), "doc_id")

    def node(word: Column, j: Column, addr: Column) -> Column:
        n = F.length(word)
        api = (F.when(n % 5 == 0, word).when(n % 7 == 0, F.to_json(F.array(word, F.lit("alt")))))
        return F.struct(F.concat(addr.cast("string"), F.lit(":"), j.cast("string")).alias("node_id"), j.cast("int").alias("idx"),
                        (addr * 1000 + j).alias("addr"), F.floor(j / 4).alias("block"), F.lower(word).alias("token"),
                        F.when(n % 3 == 0, "call").otherwise("mov").alias("mnemonic"), api.alias("api"))

    def unit(line: Column, i: Column) -> Column:
        addr = (i.cast("long") + 1) * 70
        words = F.regexp_extract_all(line, F.lit("([^ \\n]+)"))
        body = F.transform(F.array(words), lambda ws: F.struct(
            addr.alias("addr"), F.concat(F.lit("f"), i.cast("string")).alias("name"),
            F.transform(ws, lambda w, j: node(w, j, addr)).alias("nodes"),
            F.filter(F.transform(ws, lambda w, j: F.array((j - 1).cast("int"), j.cast("int"))),
                     lambda e: e[1] % 4 != 0).alias("edges_seq"),
            F.filter(F.transform(ws, lambda w, j: F.array((j - 1).cast("int"), j.cast("int"))),
                     lambda e: (e[1] % 4 == 0) & (e[1] > 0)).alias("edges_cfg"),
            F.transform(F.filter(F.transform(ws, lambda w, j: j), lambda j: j % 4 == 0), lambda j: F.struct(
                F.floor(j / 4).alias("addr"), F.lit(4).alias("size"), j.cast("int").alias("first_idx"))).alias("blocks"),
            F.when(i % 5 != 4, F.array(F.struct(F.lit("T1").alias("technique_id"), F.lit("r").alias("rule_name"))))
            .alias("node_indicators")))
        return F.struct(F.concat(F.lit("func_"), addr.cast("string")).alias("key"), F.element_at(body, 1).alias("value"))

    units = F.map_from_entries(F.transform(F.split("text", "\n"), unit))
    return docs.select(F.col("doc_id").cast("string").alias("sample_id"), F.col("n_chars").alias("file_size"),
                       (F.col("doc_id") % 2).cast("int").alias("label"), units.alias("intra_procedural_graphs"))


# ---- the hash tree over rows (h) as SQL
def tree_sql(rows: str) -> str:
    level = "l0"
    parts = [f"l0 AS (SELECT h, h || ':' || count(*) AS digest, count(*) AS n FROM ({rows}) GROUP BY h)"]
    for i, width in enumerate((12, 8, 4, 0), start=1):
        parts.append(f"l{i} AS (SELECT substr(h, 1, {width}) AS h, sha256(string_agg(digest, ',' ORDER BY digest)) AS digest, "
                     f"sum(n)::BIGINT AS n FROM {level} GROUP BY substr(h, 1, {width}))")
        level = f"l{i}"
    return "WITH " + ", ".join(parts) + f" SELECT digest AS fingerprint, n AS n_rows FROM {level}"
