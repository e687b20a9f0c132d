"""Queries of feature operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X, flatten as FL, vocab as V
from . import adapters as A, audits as AU, selection as SEL
from .registry import ORACLE, big, query, rounded, table


def nodes(spark, sf):
    return A.order_nodes(spark, sf).join(A.order_units(spark, sf), "unit")


def customers(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("sample"), (F.col("c_acctbal") / 1000).alias("mean_entropy"),
        (F.col("c_acctbal") / 500).alias("max_entropy"), (F.col("c_acctbal") / 2000).alias("min_entropy"),
        (F.col("c_custkey") * 10).alias("file_size"))


BASE = f"""{AU.OEV}, {A.ORDER_GRAPH_SQL}, sn AS (SELECT sample, onodes.* FROM onodes JOIN ounits USING (unit)),
  u AS (SELECT sample, count(*) AS n FROM ounits GROUP BY sample),
  nn AS (SELECT sample, count(*) AS n, count(api) AS a FROM sn GROUP BY sample),
  se AS (SELECT sample, count(*) AS n FROM (SELECT sample, lag(idx) OVER (PARTITION BY unit, block ORDER BY idx) AS p FROM sn) WHERE p IS NOT NULL GROUP BY sample),
  ev AS (SELECT sample, count(*) FILTER (kind = 'edge') AS e, count(*) FILTER (kind = 'indicator') AS i FROM oev GROUP BY sample),
  ie AS (SELECT sample, count(*) AS n FROM ograph GROUP BY sample)"""


@query("simple_features", f"""WITH {BASE} SELECT c_custkey AS sample, round(c_acctbal / 1000, 6) AS mean_entropy, round(c_acctbal / 500, 6) AS max_entropy,
    round(c_acctbal / 2000, 6) AS min_entropy, (c_custkey * 10)::DOUBLE AS file_size, coalesce(nn.a, 0)::DOUBLE AS num_api_calls,
    coalesce(u.n, 0)::DOUBLE AS num_units, coalesce(nn.n, 0)::DOUBLE AS total_nodes, coalesce(se.n, 0)::DOUBLE AS total_edges_seq,
    coalesce(ev.e, 0)::DOUBLE AS total_seed_edges, coalesce(ev.i, 0)::DOUBLE AS total_node_indicators, coalesce(ie.n, 0)::DOUBLE AS inter_edges
  FROM customer LEFT JOIN u ON u.sample = c_custkey LEFT JOIN nn ON nn.sample = c_custkey LEFT JOIN se ON se.sample = c_custkey
  LEFT JOIN ev ON ev.sample = c_custkey LEFT JOIN ie ON ie.sample = c_custkey""")
def simple_features(spark, sf):
    n = nodes(spark, sf)
    out = X.simple_features(customers(spark, sf), A.order_units(spark, sf), n, FL.seq_edges(n),
                            AU.order_evidence(spark, sf), A.order_edges(spark, sf))
    return rounded(out, "mean_entropy", "max_entropy", "min_entropy")


@query("meta8", """SELECT p_partkey AS sample, (p_size % 2)::DOUBLE AS has_sig, p_size / 4.0::DOUBLE AS linker, (2000 + p_size)::DOUBLE AS year,
    (p_size % 3 = 0)::INT::DOUBLE AS has_rich, CASE WHEN p_size % 4 = 0 THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END AS n_sec, CASE WHEN p_size % 4 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS nonstd_sec,
    CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE p_size / 8.0::DOUBLE END AS max_ent, round(log10(greatest(p_partkey, 1)), 6) AS log_size FROM part""")
def meta8(spark, sf):
    s = F.col("p_size")
    secs = F.when(s % 4 == 0, F.array(F.lit(".TEXT"), F.lit(".data"), F.lit(".odd"))).otherwise(F.array(F.lit(".TEXT"), F.lit(".data")))
    ents = F.when(s % 5 == 0, F.array().cast("array<double>")).otherwise(F.array(s / F.lit(8.0), F.lit(0.0)))
    df = table(spark, sf, "part").select(
        F.col("p_partkey").alias("sample"), (s % 2).alias("has_sig"), (s / F.lit(4.0)).alias("linker"), (s + 2000).alias("year"),
        (s % 3 == 0).cast("int").alias("has_rich"), secs.alias("sections"), ents.alias("entropies"), F.col("p_partkey").alias("file_size"))
    return rounded(X.meta8(df), "log_size")


GRAPH = f"""WITH {A.ONODES_SQL}, sn AS (SELECT sample, onodes.* FROM onodes JOIN ounits USING (unit)),
  n AS (SELECT sample, count(*) AS nodes, count(api) AS apis FROM sn GROUP BY sample), u AS (SELECT sample, count(*) AS units FROM ounits GROUP BY sample),
  g AS (SELECT c_custkey AS sample, coalesce(units, 0)::DOUBLE AS num_functions, coalesce(apis, 0)::DOUBLE AS num_api_calls, (c_nationkey)::DOUBLE AS num_imports,
    (c_custkey * 10)::DOUBLE AS file_size, round(c_acctbal / 1500, 6) AS max_section_entropy,
    (c_acctbal / 1500 >= 7.2 OR c_nationkey < 10)::INT::DOUBLE AS packed, coalesce(nodes, 0)::DOUBLE AS total_nodes
  FROM customer LEFT JOIN n ON n.sample = c_custkey LEFT JOIN u ON u.sample = c_custkey)"""


def graph_rows(spark, sf):
    n = nodes(spark, sf).groupBy("sample").agg(F.count(F.lit(1)).alias("total_nodes"), F.count("api").alias("num_api_calls"))
    u = A.order_units(spark, sf).groupBy("sample").agg(F.count(F.lit(1)).alias("num_functions"))
    c = table(spark, sf, "customer")
    top = F.col("c_acctbal") / 1500
    base = c.select(F.col("c_custkey").alias("sample"), F.col("c_nationkey").alias("num_imports"), (F.col("c_custkey") * 10).alias("file_size"),
                    top.alias("max_section_entropy"), ((top >= 7.2) | (F.col("c_nationkey") < 10)).cast("int").alias("packed"))
    return rounded(X.graph7(base.join(n, "sample", "left").join(u, "sample", "left")), "max_section_entropy")


@query("graph7", f"{GRAPH} SELECT * FROM g")
def graph7(spark, sf):
    return graph_rows(spark, sf)


@query("global_features", """SELECT c_custkey AS sample, round(c_acctbal / 1000, 6) AS mean_entropy, round(c_acctbal / 500, 6) AS max_entropy,
    round(c_acctbal / 2000, 6) AS min_entropy, CASE WHEN c_custkey % 4 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS has_any_external_call FROM customer""")
def global_features(spark, sf):
    df = customers(spark, sf).withColumn("has_any_external_call", F.when(F.col("sample") % 4 != 0, 1))
    return rounded(X.global_features(df), "mean_entropy", "max_entropy", "min_entropy")


@query("feature_concat_gapi", f"""{GRAPH}, c AS (SELECT sample, api, count(*) AS n FROM sn WHERE api IS NOT NULL GROUP BY ALL),
  top AS (SELECT api, row_number() OVER (ORDER BY count(*) DESC, api) + 6 AS pos FROM c GROUP BY api QUALIFY pos <= 16),
  cells AS (SELECT sample, unnest([num_functions, num_api_calls, num_imports, file_size, max_section_entropy, packed, total_nodes]) AS x, unnest(range(7)) AS pos FROM g
    UNION ALL SELECT g.sample, coalesce(n, 0), pos FROM g CROSS JOIN top LEFT JOIN c ON c.sample = g.sample AND c.api = top.api)
  SELECT sample, pos, x FROM cells""")
def feature_concat_gapi(spark, sf):
    counts = (nodes(spark, sf).filter("api is not null").groupBy("sample", F.col("api").alias("term")).agg(F.count(F.lit(1)).alias("n")))
    out = X.feature_concat_gapi(graph_rows(spark, sf), counts, 10)
    return out.select("sample", F.posexplode("features").alias("pos", "x"))


@query("standard_scale", f"""WITH {A.LABELLED_SQL}, m AS (SELECT avg(f_chars) AS mc, stddev_pop(f_chars) AS sc, avg(n_words) AS mw, stddev_pop(n_words) AS sw FROM labelled WHERE doc_id % 5 <> 0)
  SELECT doc_id, round((f_chars - mc) / sc, 6) AS f_chars, round((n_words - mw) / sw, 6) AS n_words FROM labelled, m""")
def standard_scale(spark, sf):
    rows = A.labelled(spark, sf).select("doc_id", "f_chars", "n_words")
    return rounded(X.standard_scale(rows, ["f_chars", "n_words"], F.col("doc_id") % 5 != 0), "f_chars", "n_words")


@query("class_weights_balanced", """SELECT doc_id, quality, round((SELECT count(*) FROM labels)::DOUBLE / (2 * count(*) OVER (PARTITION BY quality)), 6) AS weight FROM labels""")
def class_weights_balanced(spark, sf):
    return rounded(X.class_weights_balanced(table(spark, sf, "labels").select("doc_id", "quality"), "quality"), "weight")


@query("cell_weights_clipped", f"""WITH {SEL.DOCS}, c AS (SELECT *, count(*) OVER (PARTITION BY lang, quality) AS n, count(*) OVER () AS total,
    count(*) FILTER (quality = 0) OVER (PARTITION BY lang) AS neg FROM dl),
  k AS (SELECT count(*) AS k FROM (SELECT DISTINCT lang, quality FROM dl))
  SELECT id, lang, quality, round(least(greatest(total::DOUBLE / (k * n), 0.25), 4.0), 6) AS weight, neg < 10 AS underpowered FROM c, k""")
def cell_weights_clipped(spark, sf):
    out = X.cell_weights_clipped(SEL.docs(spark, sf).select("id", "lang", "quality"), "lang", "quality", min_neg=10)
    return rounded(out, "weight")
