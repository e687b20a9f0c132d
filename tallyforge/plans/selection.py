"""Queries of selection and sampling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as S
from ..scale import Carry, prefix_scan, ranked
from . import adapters as A
from .registry import big, query, rounded, table

K = 5
N = A.ONODES_SQL
SEED = "42"


def units(spark, sf):
    return A.order_units(spark, sf)


@query("first_k_units", f"""WITH {N} SELECT sample, unit FROM ounits
  QUALIFY row_number() OVER (PARTITION BY sample ORDER BY unit) <= {K}""")
def first_k_units(spark, sf):
    return S.first_k_units(units(spark, sf), K)


DENSE = "SELECT unit, count(*) AS n_calls FROM onodes WHERE api IS NOT NULL GROUP BY unit"


# Event types are the units here: their names repeat in every sample.
@query("density_top_k", """WITH u AS (SELECT DISTINCT user_id AS sample, event_type AS unit FROM events),
  d AS (SELECT user_id AS sample, event_type AS unit, count(*) AS n_calls FROM events WHERE event_id % 3 = 0 GROUP BY ALL)
  SELECT sample, unit, coalesce(n_calls, 0) AS n_calls FROM u LEFT JOIN d USING (sample, unit)
  QUALIFY row_number() OVER (PARTITION BY sample ORDER BY coalesce(n_calls, 0) DESC, unit) <= 2""")
def density_top_k(spark, sf):
    nodes = table(spark, sf, "events").select(F.col("user_id").alias("sample"), F.col("event_type").alias("unit"),
                                              F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("api"))
    return S.density_top_k(nodes.select("sample", "unit").distinct(), nodes, 2)


SPREAD = f"""SELECT sample, unit FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY unit) - 1 AS p,
    count(*) OVER (PARTITION BY sample) AS n FROM ounits)
  WHERE n <= {K} OR p = 0 OR (p * {K}) // n <> ((p - 1) * {K}) // n"""


@query("spread_top_k", f"WITH {N} {SPREAD}")
def spread_top_k(spark, sf):
    return S.spread_top_k(units(spark, sf), K)


def order_evidence(spark, sf):
    return units(spark, sf).filter("unit % 4 = 0")


@query("evidence_first_top_k", f"""WITH {N} SELECT sample, unit, unit % 4 = 0 AS has_evidence FROM ounits
  QUALIFY row_number() OVER (PARTITION BY sample ORDER BY (unit % 4 = 0) DESC, unit) <= {K}""")
def evidence_first_top_k(spark, sf):
    return S.evidence_first_top_k(units(spark, sf), order_evidence(spark, sf), K)


@query("drop_empty", f"WITH {N} SELECT * FROM osamples WHERE sample IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')")
def drop_empty(spark, sf):
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
    return S.drop_empty(A.order_samples(spark, sf), urgent.select(F.col("o_custkey").alias("sample")))


def labels(spark, sf):
    return table(spark, sf, "labels").withColumnRenamed("doc_id", "id")


def rk(seed: str, by: str = "", key: str = "id") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({part}ORDER BY md5('{seed}|' || {key}), {key})"


LB = "lb AS (SELECT doc_id AS id, quality, toxic FROM labels)"


@query("balance_classes", f"""WITH {LB} SELECT id, quality, toxic FROM lb
  QUALIFY {rk(SEED, 'quality')} <= (SELECT min(n) FROM (SELECT count(*) AS n FROM lb GROUP BY quality))""")
def balance_classes(spark, sf):
    return S.balance_classes(labels(spark, sf), "quality", SEED)


def docs(spark, sf):
    return (A.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
            .join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").withColumnRenamed("doc_id", "id"))


DOCS = """dl AS (SELECT d.doc_id AS id, lang, source, n_chars, quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


@query("balance_per_group", f"""WITH {DOCS}, neg AS (
    SELECT id, {rk(SEED)} AS r FROM dl WHERE quality = 0),
  pos AS (SELECT lang, id, row_number() OVER (PARTITION BY lang ORDER BY md5('{SEED}|' || lang || '|' || id), id) AS r
          FROM dl WHERE quality = 1),
  sizes AS (SELECT lang, least(count(*), (SELECT count(*) FROM neg)) AS n FROM pos GROUP BY lang HAVING n >= 20)
  SELECT lang, id, 1 AS quality FROM pos JOIN sizes USING (lang) WHERE r <= n
  UNION ALL SELECT lang, id, 0 FROM sizes JOIN neg ON r <= n""")
def balance_per_group(spark, sf):
    return S.balance_per_group(docs(spark, sf), "lang", "quality", 20, SEED)


@query("stratified_split", f"""WITH {LB} SELECT *, CASE WHEN {rk(SEED, 'quality')} <=
    round(count(*) OVER (PARTITION BY quality) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM lb""")
def stratified_split(spark, sf):
    return S.stratified_split(labels(spark, sf), "quality", 0.8, SEED)


def documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")


DC = "dc AS (SELECT doc_id AS id, lang, source, n_chars FROM documents)"


@query("group_shuffle_split", f"""WITH {DC}, g AS (
    SELECT source, {rk(SEED, key='source')} AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM dc))
  SELECT dc.*, CASE WHEN r <= ceil(round((1 - 0.8::DOUBLE) * n, 9)) THEN 'test' ELSE 'train' END AS split
  FROM dc JOIN g USING (source)""")
def group_shuffle_split(spark, sf):
    return S.group_shuffle_split(documents(spark, sf), "source", 0.8, SEED)


@query("group_key", """SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 > 1 THEN source END AS cluster,
    coalesce(nullif(CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 > 1 THEN source END, ''), doc_id::VARCHAR) AS group_key
  FROM documents""")
def group_key(spark, sf):
    m = F.col("id") % 5
    rows = documents(spark, sf).select("id", F.when(m == 0, "").when(m > 1, F.col("source")).alias("cluster"))
    return S.group_key(rows)


GROUP = "source || ':' || (n_chars % 30)"


def grouped(spark, sf):
    return documents(spark, sf).withColumn("grp", F.concat_ws(":", "source", F.col("n_chars") % 30)).select("id", "grp")


GR = f"gr AS (SELECT doc_id AS id, {GROUP} AS grp FROM documents), sz AS (SELECT grp, count(*) AS size FROM gr GROUP BY grp)"


@query("group_kfold", f"""WITH RECURSIVE {GR}, ord AS (
    SELECT grp, size, row_number() OVER (ORDER BY size DESC, md5('{SEED}|' || grp), grp) AS r FROM sz),
  walk AS (SELECT 0::BIGINT AS r, [0, 0, 0, 0, 0]::BIGINT[] AS loads, NULL::BIGINT AS fold
    UNION ALL
    SELECT o.r, list_transform(w.loads, lambda x, i: CASE WHEN i = list_position(w.loads, list_min(w.loads)) THEN x + o.size ELSE x END),
           list_position(w.loads, list_min(w.loads)) - 1
    FROM walk w JOIN ord o ON o.r = w.r + 1)
  SELECT id, gr.grp, fold FROM walk JOIN ord USING (r) JOIN gr ON gr.grp = ord.grp""")
def group_kfold(spark, sf):
    return S.group_kfold(grouped(spark, sf), "grp", 5, "greedy", SEED)


@query("group_kfold_snake", f"""WITH {GR}, ord AS (
    SELECT grp, (row_number() OVER (ORDER BY size DESC, md5('{SEED}|' || grp), grp) - 1) % 10 AS t FROM sz)
  SELECT id, grp, CASE WHEN t < 5 THEN t ELSE 9 - t END AS fold FROM gr JOIN ord USING (grp)""")
def group_kfold_snake(spark, sf):
    return S.group_kfold(grouped(spark, sf), "grp", 5, "snake", SEED)


@query("carve_validation", f"""WITH {DOCS}, g AS (
    SELECT source, count(*) AS n, count(*) FILTER (quality = 0) AS n_neg FROM dl GROUP BY source),
  s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY md5('9|' || source), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(n) OVER () AS total FROM g),
  f AS (SELECT * FROM (VALUES (0.15::DOUBLE), (0.2::DOUBLE), (0.25::DOUBLE), (0.3::DOUBLE), (0.35::DOUBLE)) t(f)),
  ok AS (SELECT f, sum(n_neg) AS negs FROM s, f WHERE before < floor(f * total) GROUP BY f),
  pick AS (SELECT coalesce(min(f) FILTER (negs >= 15), 0.35::DOUBLE) AS f FROM ok)
  SELECT dl.id, source, quality, CASE WHEN before < floor(pick.f * total) THEN 'val' ELSE 'train' END AS split
  FROM dl JOIN s USING (source), pick""")
def carve_validation(spark, sf):
    return S.carve_validation(docs(spark, sf).select("id", "source", "quality"), "source", "quality", min_neg=15, seed="9")


@query("leave_one_group_out", f"""WITH {DOCS}, fam AS (SELECT DISTINCT lang AS held_out FROM dl WHERE quality = 1)
  SELECT id, lang, quality, held_out,
         CASE WHEN quality = 1 THEN CASE WHEN lang = held_out THEN 'test' ELSE 'train' END
              WHEN id % 3 = 0 THEN 'test' ELSE 'train' END AS role
  FROM dl, fam""")
def leave_one_group_out(spark, sf):
    rows = docs(spark, sf).select("id", "lang", "quality")
    return S.leave_one_group_out(rows, "lang", "quality", F.col("id") % 3 == 0)


@query("source_cap", f"""WITH {DC} SELECT * FROM dc WHERE source <> 'src5' UNION ALL
  (SELECT * FROM dc WHERE source = 'src5' QUALIFY {rk(SEED)} <= 12)""")
def source_cap(spark, sf):
    return S.source_cap(documents(spark, sf), "source", "src5", 12, SEED)


@query("vendor_fraction_cap", f"""WITH {DC} SELECT * FROM dc WHERE lang <> 'en' UNION ALL
  (SELECT * FROM dc WHERE lang = 'en' QUALIFY row_number() OVER (ORDER BY id) <= floor(0.2::DOUBLE * (SELECT count(*) FROM dc)))""")
def vendor_fraction_cap(spark, sf):
    return S.vendor_fraction_cap(documents(spark, sf), "lang", "en", 0.2)


# Sources are vendors and languages bins; the limit is looked for from below, one row more at a time.
@query("vendor_cap_per_bin", f"""WITH RECURSIVE {DC},
  v AS (SELECT lang, source, count(*) AS c FROM dc GROUP BY ALL),
  lim AS (SELECT lang, list(c) AS cs, 0::BIGINT AS k FROM v GROUP BY lang
    UNION ALL SELECT lang, cs, k + 1 FROM lim
    WHERE k < list_max(cs) AND k + 1 <= 0.06::DOUBLE * list_sum(list_transform(cs, lambda c: least(c, k + 1))) + 1e-9),
  best AS (SELECT lang, max(k) AS k FROM lim GROUP BY lang)
  SELECT dc.* FROM dc JOIN best ON best.lang IS NOT DISTINCT FROM dc.lang
  QUALIFY row_number() OVER (PARTITION BY dc.lang, source ORDER BY md5('{SEED}|' || id), id) <= k""")
def vendor_cap_per_bin(spark, sf):
    return S.vendor_cap_per_bin(documents(spark, sf), "lang", "source", 0.06, SEED)


PT = "pt AS (SELECT p_partkey AS id, p_brand, p_type FROM part)"


@query("bin_fraction_cap", f"""WITH {PT}, m AS (
    SELECT *, {rk(SEED)} AS r FROM pt WHERE p_type = 'ECONOMY')
  SELECT *, 'train' AS split FROM pt WHERE p_type <> 'ECONOMY'
  UNION ALL SELECT id, p_brand, p_type, CASE WHEN r <= floor(0.1::DOUBLE * (SELECT count(*) FROM pt WHERE p_type <> 'ECONOMY') / 0.9::DOUBLE)
    THEN 'train' ELSE 'holdout' END FROM m""")
def bin_fraction_cap(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type")
    return S.bin_fraction_cap(parts, F.col("p_type") == "ECONOMY", 0.1, "holdout", SEED)


@query("per_group_top_n", """SELECT p_brand, p_partkey, p_size FROM part WHERE p_size > 0 AND p_size <= 40
  QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) <= 3""")
def per_group_top_n(spark, sf):
    parts = table(spark, sf, "part").select("p_brand", "p_partkey", "p_size")
    return S.per_group_top_n(parts, "p_brand", 3, [F.col("p_size").desc(), F.col("p_partkey").asc()], "p_size", 40)


@query("quota_round_robin", f"""WITH {DC}, i AS (
    SELECT *, {rk(SEED, 'lang, source')} AS r FROM dc),
  t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY r, md5('{SEED}|' || source), source, id) AS turn
        FROM i JOIN (SELECT lang, count(*) // 4 AS quota FROM dc GROUP BY lang) USING (lang) WHERE r <= quota)
  SELECT id, lang, source, n_chars, turn FROM t WHERE turn <= quota""")
def quota_round_robin(spark, sf):
    rows = documents(spark, sf)
    quotas = rows.groupBy("lang").agg(F.floor(F.count(F.lit(1)) / 4).alias("quota"))
    return S.quota_round_robin(rows, "lang", "source", quotas, SEED)


@query("weighted_interleave", f"""WITH a AS (SELECT p_partkey AS id, {rk(SEED, key='p_partkey')} - 1 AS i FROM part),
  b AS (SELECT s_suppkey AS id, {rk(SEED, key='s_suppkey')} - 1 AS i FROM supplier),
  u AS (SELECT id, 'a' AS list, (i // 3) * 5 + i % 3 AS at_pos FROM a UNION ALL SELECT id, 'b', (i // 2) * 5 + 3 + i % 2 FROM b)
  SELECT id, list, row_number() OVER (ORDER BY at_pos) - 1 AS position FROM u""")
def weighted_interleave(spark, sf):
    return S.weighted_interleave(table(spark, sf, "part").withColumnRenamed("p_partkey", "id"),
                                 table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "id"), 3, 2, SEED)


@query("random_subset", f"WITH {DC} SELECT * FROM dc QUALIFY {rk(SEED)} <= 100")
def random_subset(spark, sf):
    return S.random_subset(documents(spark, sf), 100, SEED)


PAIRS = """og AS (SELECT o_custkey AS graph, o_orderkey, o_orderstatus,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
  sizes AS (SELECT graph, count(*) AS n FROM og GROUP BY graph),
  pos AS (SELECT graph, i, i + 1 AS j FROM og JOIN sizes USING (graph) WHERE o_orderstatus = 'F' AND i + 1 < n AND n >= 2)"""


def draw(t: str) -> str:
    return f"('0x' || substr(md5('{SEED}|' || graph || '|' || t || '|{t}'), 1, 8))::BIGINT % n AS {t}"


@query("negative_pair_sampling", f"""WITH {PAIRS},
  need AS (SELECT s.graph, n, CASE WHEN count(p.i) > 0 THEN count(p.i) * 3 ELSE least(4, n) END AS n_neg
           FROM sizes s LEFT JOIN pos p USING (graph) WHERE n >= 2 GROUP BY s.graph, n),
  tries AS (SELECT graph, n, n_neg, unnest(range(n_neg * 60 + 200)) AS t FROM need),
  drawn AS (SELECT graph, n_neg, t, {draw('i')}, {draw('j')} FROM tries),
  free AS (SELECT * FROM drawn d WHERE i <> j AND NOT EXISTS (SELECT 1 FROM pos p WHERE p.graph = d.graph AND p.i = d.i AND p.j = d.j))
  SELECT graph, i, j, 1 AS label FROM pos
  UNION ALL SELECT graph, i, j, 0 FROM (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY t) AS r FROM free) WHERE r <= n_neg""")
def negative_pair_sampling(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("graph"), "o_orderkey", "o_orderstatus")
    index = ranked(orders, ["graph"], [F.col("o_orderkey")], "i", 0)
    sizes = orders.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    pos = index.filter("o_orderstatus = 'F'").select("graph", "i", (F.col("i") + 1).alias("j"))
    return S.negative_pair_sampling(sizes, pos, 3, SEED)
