"""Queries of interval and graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G, intervals as I
from ..scale import ranked
from . import adapters as A
from .registry import big, query, rounded, table

PARAMS = {"gap_tol": A.GAP_TOL, "far_gap": A.FAR_GAP, "min_spread": A.MIN_SPREAD,
          "max_coverage": A.MAX_COVERAGE}


@query("segment_intervals", f"WITH {A.BLOCKS_SQL} SELECT * FROM segs")
def segment_intervals(spark, sf):
    return I.segment_intervals(A.event_blocks(spark, sf), A.GAP_TOL)


SPREAD_SQL = """SELECT sample, unit, max(addr + size) - min(addr) AS spread,
    sum(size)::DOUBLE / (max(addr + size) - min(addr)) AS coverage FROM blocks GROUP BY sample, unit"""


@query("spread_coverage", f"""WITH {A.BLOCKS_SQL}
  SELECT sample, unit, spread, round(coverage, 6) AS coverage, spread >= {A.MIN_SPREAD} AND coverage < {A.MAX_COVERAGE} AS is_spread
  FROM ({SPREAD_SQL})""")
def spread_coverage(spark, sf):
    return rounded(I.spread_coverage(A.event_blocks(spark, sf), A.MIN_SPREAD, A.MAX_COVERAGE), "coverage")


@query("node_to_block_asof", f"""WITH {A.BLOCKS_SQL}
  SELECT n.sample, n.unit, n.first_idx AS idx, n.event_id, max(b.first_idx) AS block_first_idx,
         max(b.addr) AS block_addr
  FROM blocks n LEFT JOIN blocks b ON b.sample = n.sample AND b.unit = n.unit AND b.linked AND b.first_idx <= n.first_idx
  GROUP BY ALL""")
def node_to_block_asof(spark, sf):
    blocks = A.event_blocks(spark, sf)
    nodes = blocks.select("sample", "unit", F.col("first_idx").alias("idx"), "event_id")
    return I.node_to_block_asof(nodes, blocks.filter("linked").select("sample", "unit", "first_idx", "addr"))


@query("segment_incoming", f"WITH {A.BLOCKS_SQL} SELECT * FROM incoming")
def segment_incoming(spark, sf):
    blocks = A.event_blocks(spark, sf)
    return I.segment_incoming(I.segment_blocks(blocks, A.GAP_TOL), A.block_links(blocks))


FAR_SQL = f"""SELECT s.sample, s.unit, s.seg, seg_start, gap FROM (
    SELECT *, seg_start - lag(seg_end) OVER (PARTITION BY sample, unit ORDER BY seg) AS gap FROM segs) s
  WHERE gap > {A.FAR_GAP} AND NOT EXISTS (
    SELECT 1 FROM incoming i WHERE i.sample = s.sample AND i.unit = s.unit AND i.seg = s.seg)"""


@query("far_unlinked", f"WITH {A.BLOCKS_SQL} {FAR_SQL}")
def far_unlinked(spark, sf):
    blocks = A.event_blocks(spark, sf)
    segs = I.segment_blocks(blocks, A.GAP_TOL)
    return I.far_unlinked(I.segments_of(segs), I.segment_incoming(segs, A.block_links(blocks)), A.FAR_GAP)


OVERLAP_SQL = """SELECT DISTINCT s.sample, s.unit, e.entry AS inside FROM segs s
  JOIN entries o ON o.sample = s.sample AND o.unit = s.unit
  JOIN entries e ON e.sample = s.sample AND e.entry >= s.seg_start AND e.entry < s.seg_end AND e.entry <> o.entry"""


@query("interval_overlap", f"WITH {A.BLOCKS_SQL} {OVERLAP_SQL}")
def interval_overlap(spark, sf):
    blocks = A.event_blocks(spark, sf)
    return I.interval_overlap(I.segment_intervals(blocks, A.GAP_TOL), A.unit_entries(blocks))


@query("shared_blocks", """SELECT l_returnflag AS sample, l_partkey AS addr, count(DISTINCT l_orderkey) AS n_units
  FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_orderkey) > 1""")
def shared_blocks(spark, sf):
    return I.shared_blocks(table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("sample"), F.col("l_orderkey").alias("unit"), F.col("l_partkey").alias("addr")))


@query("boundary_flags", f"""WITH {A.BLOCKS_SQL}, far AS ({FAR_SQL}), lap AS ({OVERLAP_SQL}), sp AS ({SPREAD_SQL}),
  nf AS (SELECT sample, unit, count(*) AS n FROM far GROUP BY ALL),
  no AS (SELECT sample, unit, count(*) AS n FROM lap GROUP BY ALL),
  ns AS (SELECT sample, unit, count(*) AS n FROM segs GROUP BY ALL),
  sh AS (SELECT sample, addr FROM blocks GROUP BY ALL HAVING count(DISTINCT unit) > 1),
  nb AS (SELECT b.sample, b.unit, count(*) AS n_blocks, count(sh.addr) AS n_shared FROM blocks b LEFT JOIN sh ON sh.sample = b.sample AND sh.addr = b.addr GROUP BY ALL),
  ni AS (SELECT event_type AS sample, user_id AS unit, count(*) AS n FROM events WHERE value >= 50 GROUP BY ALL)
  SELECT e.sample, e.unit, spread, round(coverage, 6) AS coverage, coalesce(ns.n, 0) AS n_segments,
         coalesce(nf.n, 0) AS n_far, coalesce(no.n, 0) AS n_overlapped, coalesce(ni.n, 0) AS n_insns, coalesce(n_blocks, 0) AS n_blocks, coalesce(n_shared, 0)::BIGINT AS n_shared,
         concat_ws(',', CASE WHEN spread >= {A.MIN_SPREAD} AND coverage < {A.MAX_COVERAGE} THEN 'SPREAD' END,
                   CASE WHEN nf.n > 0 THEN 'FAR_UNLINK' END, CASE WHEN no.n > 0 THEN 'OVERLAP' END) AS flags
  FROM entries e JOIN sp USING (sample, unit) LEFT JOIN nf USING (sample, unit) LEFT JOIN no USING (sample, unit)
  LEFT JOIN ns USING (sample, unit) LEFT JOIN nb USING (sample, unit) LEFT JOIN ni USING (sample, unit)""")
def boundary_flags(spark, sf):
    blocks = A.event_blocks(spark, sf)
    nodes = table(spark, sf, "events").filter("value >= 50").select(F.col("event_type").alias("sample"), F.col("user_id").alias("unit"))
    out = I.boundary_flags(A.unit_entries(blocks), blocks, A.block_links(blocks), PARAMS, nodes)
    return rounded(out.withColumn("flags", F.concat_ws(",", "flags")).drop("entry", "is_spread"), "coverage")


OIDX_SQL = """oidx AS (SELECT o_custkey AS sample, o_orderkey AS unit,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx FROM orders {where})"""


def order_index(spark, sf, where="true"):
    orders = table(spark, sf, "orders").filter(where)
    return G.unit_index(orders.select(F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("unit"),
                                      F.col("o_orderkey").alias("addr"))).drop("addr")


@query("call_graph_edges", f"""WITH {A.ORDER_GRAPH_SQL}, {OIDX_SQL.format(where="WHERE o_orderstatus <> 'P'")}
  SELECT DISTINCT g.sample, a.idx AS caller_idx, b.idx AS callee_idx FROM ograph g
  JOIN oidx a ON a.sample = g.sample AND a.unit = g.src JOIN oidx b ON b.sample = g.sample AND b.unit = g.dst""")
def call_graph_edges(spark, sf):
    return G.call_graph_edges(A.order_edges(spark, sf), order_index(spark, sf, "o_orderstatus <> 'P'"))


@query("resolve_thunks", """WITH t AS (
    SELECT 'r' || r_regionkey AS id, 'thunk' AS kind, r_name AS name FROM region
    UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'api' ELSE 'thunk' END, n_name FROM nation
    UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'other' ELSE 'api' END, s_name FROM supplier),
  h AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
        UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
  one AS (SELECT t.id AS target, x.* FROM t JOIN h ON h.src = t.id JOIN t x ON x.id = h.dst WHERE t.kind = 'thunk'),
  two AS (SELECT one.target, x.* FROM one JOIN h ON h.src = one.id JOIN t x ON x.id = h.dst WHERE one.kind = 'thunk')
  SELECT id AS target, name, 0 AS hops FROM t WHERE kind = 'api'
  UNION ALL SELECT target, name, 1 FROM one WHERE kind = 'api'
  UNION ALL SELECT target, name, 2 FROM two WHERE kind = 'api'""")
def resolve_thunks(spark, sf):
    tid = lambda p, c: F.concat(F.lit(p), F.col(c)).alias("id")
    region = table(spark, sf, "region").select(tid("r", "r_regionkey"), F.lit("thunk").alias("kind"), F.col("r_name").alias("name"))
    nation = table(spark, sf, "nation")
    supplier = table(spark, sf, "supplier")
    targets = region.unionByName(nation.select(
        tid("n", "n_nationkey"), F.when(F.col("n_nationkey") % 5 == 0, "api").otherwise("thunk").alias("kind"),
        F.col("n_name").alias("name"))).unionByName(supplier.select(
            tid("s", "s_suppkey"), F.when(F.col("s_suppkey") % 7 == 0, "other").otherwise("api").alias("kind"),
            F.col("s_name").alias("name")))
    hops = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst")) \
        .unionByName(supplier.select(F.concat(F.lit("n"), "s_nationkey").alias("src"),
                                     F.concat(F.lit("s"), "s_suppkey").alias("dst")))
    return big(G.resolve_thunks(targets, hops), "hops")


@query("api_histogram", "SELECT user_id AS sample, event_type AS api, count(*) AS n FROM events GROUP BY ALL")
def api_histogram(spark, sf):
    calls = table(spark, sf, "events").select(F.col("user_id").alias("sample"), F.col("event_type").alias("api"))
    return G.api_histogram(calls, ["sample"])


@query("unique_apis", "SELECT DISTINCT user_id AS sample, event_type AS api FROM events")
def unique_apis(spark, sf):
    calls = table(spark, sf, "events").select(F.col("user_id").alias("sample"), F.col("event_type").alias("api"))
    return G.unique_apis(calls, ["sample"])


@query("call_count_two_ways", f"""WITH {A.ORDER_GRAPH_SQL},
  c AS (SELECT sample, count(*) AS n FROM ocalls GROUP BY sample), e AS (SELECT sample, count(*) AS n FROM ograph GROUP BY sample)
  SELECT sample, coalesce(c.n, 0) AS n_call_sites, coalesce(e.n, 0) AS n_graph_calls FROM c FULL JOIN e USING (sample)""")
def call_count_two_ways(spark, sf):
    return G.call_count_two_ways(A.order_calls(spark, sf), A.order_edges(spark, sf))


@query("induced_subgraph_remap", f"""WITH {A.ORDER_GRAPH_SQL}, {OIDX_SQL.format(where="")},
  sel AS (SELECT sample, unit, row_number() OVER (PARTITION BY sample ORDER BY idx) - 1 AS new_idx
          FROM oidx JOIN orders ON o_orderkey = unit WHERE o_orderstatus <> 'P')
  SELECT g.sample, a.new_idx AS src, b.new_idx AS dst FROM ograph g
  JOIN sel a ON a.sample = g.sample AND a.unit = g.src JOIN sel b ON b.sample = g.sample AND b.unit = g.dst""")
def induced_subgraph_remap(spark, sf):
    kept = order_index(spark, sf, "o_orderstatus <> 'P'")
    kept = ranked(kept, ["sample"], [F.col("idx")], "new_idx", 0).withColumnRenamed("unit", "pos")
    return G.induced_subgraph_remap(A.order_edges(spark, sf), kept.select("sample", "pos", "new_idx"))


@query("bounded_edges", f"""WITH {A.ORDER_GRAPH_SQL}, {OIDX_SQL.format(where="")},
  sizes AS (SELECT sample, count(*) // 2 AS n FROM oidx GROUP BY sample)
  SELECT g.sample, a.idx AS src, b.idx AS dst FROM ograph g
  JOIN oidx a ON a.sample = g.sample AND a.unit = g.src JOIN oidx b ON b.sample = g.sample AND b.unit = g.dst
  JOIN sizes s ON s.sample = g.sample WHERE a.idx < n AND b.idx < n""")
def bounded_edges(spark, sf):
    index = order_index(spark, sf)
    edges = G.induced_subgraph_remap(A.order_edges(spark, sf),
                                     index.select("sample", F.col("unit").alias("pos"), F.col("idx").alias("new_idx")))
    sizes = index.groupBy("sample").agg(F.floor(F.count(F.lit(1)) / 2).alias("n"))
    return G.bounded_edges(edges, sizes)


def pool_sql(fn: str) -> str:
    return f"""WITH c AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
  SELECT label, pos, round({fn}(x), 6) AS x FROM c GROUP BY label, pos"""


def pooled_rows(df):
    return rounded(df.select("label", F.posexplode("vector").alias("pos", "x")), "x")


@query("pool_max", pool_sql("max"))
def pool_max(spark, sf):
    return pooled_rows(G.pool_max(table(spark, sf, "embeddings"), ["label"]))


@query("pool_mean", pool_sql("avg"))
def pool_mean(spark, sf):
    return pooled_rows(G.pool_mean(table(spark, sf, "embeddings"), ["label"]))
