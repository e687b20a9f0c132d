"""Queries of the audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits as Q, intervals as I, patterns as P, sampling as S
from ..operators.rules import Rule, SET, rule_table
from ..scale import ranked
from . import adapters as A, evidence as E, graphs as GR, selection as SEL
from .registry import ORACLE, big, query, rounded, table

EV = A.EVENT_EDGES_SQL
NEVER = Rule("R9", "never_fires", SET, apis=("no_such_event",))


def rules(spark):
    return rule_table(spark, (*A.EVENT_RULES, NEVER))


RULES = "all_rules AS (SELECT * FROM rule_names UNION ALL SELECT 'R9', 'never_fires')"
KINDS = """kinds AS (SELECT sample, unit, technique_id, kind FROM evidence
  UNION ALL SELECT sample, unit, technique_id, 'any' FROM evidence)"""
FIRED = f"""{KINDS}, fired AS (SELECT technique_id, kind, label, count(DISTINCT k.sample) AS n_firing
  FROM kinds k JOIN user_samples u ON u.sample = k.sample GROUP BY ALL),
  classes AS (SELECT label, count(*) AS n_samples FROM user_samples GROUP BY label)"""


def seed(spark, sf):
    return P.seed_evidence(A.event_calls(spark, sf), A.event_rules(spark), A.WINDOW)


def evidence(spark, sf):
    return seed(spark, sf).select("sample", "unit", "technique_id", "kind")


def split_kinds(spark, sf):
    ev = seed(spark, sf)
    return ev.filter("kind = 'edge'"), ev.filter("kind = 'indicator'")


@query("required_fields_gate", """SELECT user_id AS sample, count(*) FILTER (v > 180) AS missing_seed_edges,
    count(*) FILTER (k % 17 = 0) AS missing_node_indicators
  FROM (SELECT user_id, value AS v, (props->>'$.k')::BIGINT AS k FROM events) GROUP BY user_id
  HAVING count(*) FILTER (v > 180) > 0 OR count(*) FILTER (k % 17 = 0) > 0""")
def required_fields_gate(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    units = table(spark, sf, "events").select(
        F.col("user_id").alias("sample"), F.when(F.col("value") <= 180, 1).alias("seed_edges"),
        F.when(k % 17 != 0, 1).alias("node_indicators"))
    return Q.required_fields_gate(units, ["seed_edges", "node_indicators"])


@query("evidence_by_unit", f"""WITH {EV} SELECT sample, unit, technique_id, count(*) FILTER (kind = 'edge') AS edge,
    count(*) FILTER (kind = 'indicator') AS indicator, count(*) AS any FROM evidence GROUP BY ALL""".replace("AS any", 'AS "any"'))
def evidence_by_unit(spark, sf):
    return Q.evidence_by_unit(*split_kinds(spark, sf))


@query("sample_techniques", f"WITH {EV} SELECT DISTINCT sample, technique_id, kind FROM evidence")
def sample_techniques(spark, sf):
    return Q.sample_techniques(*split_kinds(spark, sf))


@query("fire_rate", f"""WITH {EV}, {RULES}, {FIRED}
  SELECT r.technique_id, r.rule_name, k.kind, c.label, n_samples, coalesce(n_firing, 0) AS n_firing,
         round(100.0::DOUBLE * coalesce(n_firing, 0) / n_samples, 6) AS fire_pct,
         coalesce(n_firing, 0)::DOUBLE / n_samples < 0.01 AS low_rate
  FROM all_rules r, (VALUES ('edge'), ('indicator'), ('any')) k(kind), classes c
  LEFT JOIN fired f ON f.technique_id = r.technique_id AND f.kind = k.kind AND f.label = c.label""")
def fire_rate(spark, sf):
    out = Q.fire_rate(A.user_samples(spark, sf), evidence(spark, sf), rules(spark))
    return rounded(out, "fire_pct")


@query("unknown_techniques", f"WITH {EV} SELECT DISTINCT technique_id FROM evidence WHERE technique_id <> 'R1' AND technique_id <> 'R3'")
def unknown_techniques(spark, sf):
    return Q.unknown_techniques(evidence(spark, sf), rules(spark).filter("technique_id in ('R1', 'R3', 'R9')"))


@query("cross_unit_fire_rate", f"""WITH cross_edges AS ({ORACLE['cross_unit_chain_1hop']}),
  s AS (SELECT c_custkey AS sample, c_custkey % 2 AS label FROM customer),
  n AS (SELECT label, count(*) AS n_samples FROM s GROUP BY label),
  f AS (SELECT label, count(DISTINCT sample) AS n_firing, count(*) AS n_edges FROM cross_edges JOIN s USING (sample) GROUP BY label)
  SELECT 'O1' AS technique_id, label, n_samples, coalesce(n_firing, 0) AS n_firing, coalesce(n_edges, 0) AS n_edges,
         round(100.0::DOUBLE * coalesce(n_firing, 0) / n_samples, 6) AS fire_pct FROM n LEFT JOIN f USING (label)""")
def cross_unit_fire_rate(spark, sf):
    out = Q.cross_unit_fire_rate(A.order_samples(spark, sf), E.cross_unit_chain_1hop(spark, sf),
                                 rule_table(spark, A.ORDER_RULES))
    return rounded(out, "fire_pct")


@query("evidence_coverage", f"""WITH {EV}, h AS (SELECT sample, max((kind = 'edge')::INT) AS e FROM evidence WHERE technique_id = 'R1' OR technique_id = 'R2' GROUP BY sample),
  r AS (SELECT u.sample, CASE WHEN votes >= 15 THEN 'high' WHEN votes >= 5 THEN 'medium' ELSE 'low' END AS tier,
        CASE WHEN e = 1 THEN 'edge' WHEN e = 0 THEN 'indicator' ELSE 'none' END AS state
        FROM user_samples u LEFT JOIN h ON h.sample = u.sample WHERE label = 1),
  g AS (SELECT tier, state FROM r UNION ALL SELECT 'TOTAL', state FROM r),
  c AS (SELECT tier, count(*) AS n, count(*) FILTER (state = 'none') AS n_none, count(*) FILTER (state = 'indicator') AS n_indicator,
        count(*) FILTER (state = 'edge') AS n_edge FROM g GROUP BY tier)
  SELECT *, round(100.0::DOUBLE * n_none / n, 6) AS pct_none, round(100.0::DOUBLE * n_indicator / n, 6) AS pct_indicator,
         round(100.0::DOUBLE * n_edge / n, 6) AS pct_edge FROM c""")
def evidence_coverage(spark, sf):
    from ..operators.flatten import confidence_tier
    samples = confidence_tier(A.user_samples(spark, sf), "votes")
    ev = evidence(spark, sf).filter("technique_id in ('R1', 'R2')")
    out = Q.evidence_coverage(samples.select("sample", "label", "tier"), ev)
    return rounded(out, "pct_none", "pct_indicator", "pct_edge")


@query("technique_discrimination", f"""WITH {EV}, {FIRED}, p AS (
    SELECT technique_id, kind,
           100.0::DOUBLE * coalesce(sum(n_firing) FILTER (label = 0), 0) / (SELECT n_samples FROM classes WHERE label = 0) AS neg_pct,
           100.0::DOUBLE * coalesce(sum(n_firing) FILTER (label = 1), 0) / (SELECT n_samples FROM classes WHERE label = 1) AS pos_pct
    FROM fired GROUP BY technique_id, kind)
  SELECT technique_id, kind, round(neg_pct, 6) AS neg_pct, round(pos_pct, 6) AS pos_pct, round(pos_pct - neg_pct, 6) AS diff,
         abs(pos_pct - neg_pct) < 15 AND neg_pct > 30 AS is_noise FROM p""")
def technique_discrimination(spark, sf):
    out = Q.technique_discrimination(A.user_samples(spark, sf), evidence(spark, sf))
    return rounded(out, "neg_pct", "pos_pct", "diff")


@query("evidence_histogram", f"""WITH {EV}, n AS (SELECT sample, count(*) AS n FROM chain_edges GROUP BY sample)
  SELECT label, least(coalesce(n, 0), 20) AS n_edges, count(*) AS n_samples
  FROM user_samples u LEFT JOIN n ON n.sample = u.sample GROUP BY ALL""")
def evidence_histogram(spark, sf):
    return Q.evidence_histogram(A.user_samples(spark, sf), E.ordered_chain(spark, sf))


@query("boundary_lift", f"""WITH {EV}, {KINDS}, fl AS (SELECT sample, unit, count(*) AS n, count(*) >= 15 AS flagged FROM calls GROUP BY ALL),
  base AS (SELECT sum(n) FILTER (flagged)::DOUBLE / sum(n) AS s FROM fl),
  c AS (SELECT technique_id, kind, count(*) FILTER (NOT flagged) AS clean, count(*) FILTER (flagged) AS flagged
        FROM kinds JOIN fl USING (sample, unit) GROUP BY technique_id, kind)
  SELECT technique_id, kind, clean, flagged, round(100.0::DOUBLE * flagged / (clean + flagged), 6) AS flagged_pct,
         round(flagged::DOUBLE / (clean + flagged) / s, 6) AS lift FROM c, base""")
def boundary_lift(spark, sf):
    calls = A.event_calls(spark, sf)
    units = calls.groupBy("sample", "unit").agg((F.count(F.lit(1)) >= 15).alias("flagged"))
    return rounded(Q.boundary_lift(units, calls, evidence(spark, sf)), "flagged_pct", "lift")


CAP = 5
OEV = f"""{A.ONODES_SQL}, oev AS (SELECT sample, unit, CASE WHEN unit % 3 = 0 THEN 'T1' ELSE 'T2' END AS technique_id,
    CASE WHEN unit % 4 = 0 THEN 'edge' ELSE 'indicator' END AS kind FROM ounits WHERE unit % 3 = 0 OR unit % 5 = 0),
  orank AS (SELECT sample, unit, row_number() OVER (PARTITION BY sample ORDER BY unit) - 1 AS rank,
            count(*) OVER (PARTITION BY sample) AS n FROM ounits)"""


def order_evidence(spark, sf):
    m = F.col("unit")
    return A.order_units(spark, sf).filter((m % 3 == 0) | (m % 5 == 0)).withColumns({
        "technique_id": F.when(m % 3 == 0, "T1").otherwise("T2"), "kind": F.when(m % 4 == 0, "edge").otherwise("indicator")})


@query("position_bias", f"""WITH {OEV}, k AS (SELECT * FROM oev UNION ALL SELECT sample, unit, technique_id, 'any' FROM oev),
  h AS (SELECT k.*, rank FROM k JOIN orank r USING (sample, unit) WHERE n > {CAP}),
  p AS (SELECT sample, technique_id, kind, min(rank) AS lo, max(rank) AS hi FROM h GROUP BY ALL)
  SELECT technique_id, kind, NULL::BIGINT AS rank, count(*) AS n_with, count(*) FILTER (hi >= {CAP}) AS n_beyond,
         count(*) FILTER (lo >= {CAP}) AS n_lost FROM p GROUP BY ALL
  UNION ALL SELECT NULL, kind, rank, count(*), NULL, NULL FROM (SELECT DISTINCT sample, unit, kind, least(rank, 200) AS rank FROM h) GROUP BY kind, rank""")
def position_bias(spark, sf):
    return Q.position_bias(A.order_units(spark, sf), order_evidence(spark, sf), CAP)


@query("truncation_stats", f"""WITH {A.ONODES_SQL}, s AS (SELECT o.sample, label, split, count(unit) AS n_units
    FROM osamples o LEFT JOIN ounits u ON u.sample = o.sample GROUP BY ALL)
  SELECT split, label, count(*) AS n, count(*) FILTER (n_units > {CAP}) AS n_truncated,
         round(quantile_cont(n_units::DOUBLE, 0.5::DOUBLE), 6) AS median_units,
         round(quantile_cont((n_units - {CAP})::DOUBLE, 0.5::DOUBLE) FILTER (n_units > {CAP}), 6) AS median_dropped,
         round(100.0::DOUBLE * count(*) FILTER (n_units > {CAP}) / count(*), 6) AS truncated_pct
  FROM s GROUP BY split, label""")
def truncation_stats(spark, sf):
    sizes = A.order_units(spark, sf).groupBy("sample").agg(F.count(F.lit(1)).alias("n_units"))
    samples = A.order_samples(spark, sf).join(sizes, "sample", "left").fillna(0, ["n_units"])
    out = Q.truncation_stats(samples, CAP, ["split", "label"])
    return rounded(out, "median_units", "median_dropped", "truncated_pct")


@query("evidence_truncation", f"""WITH {OEV}, e AS (
    SELECT r.sample, r.rank, n1.idx AS src_idx, n1.idx + 1 AS dst_idx FROM onodes n1
    JOIN orank r ON r.unit = n1.unit JOIN onodes n2 ON n2.unit = n1.unit AND n2.idx = n1.idx + 1)
  SELECT sample % 2 AS label, count(*) AS n_edges, count(*) FILTER (rank >= {CAP}) AS lost_by_units,
         count(*) FILTER (rank < {CAP} AND dst_idx >= 4) AS lost_by_nodes,
         round(100.0::DOUBLE * count(*) FILTER (rank >= {CAP}) / count(*), 6) AS lost_units_pct,
         round(100.0::DOUBLE * count(*) FILTER (rank < {CAP} AND dst_idx >= 4) / count(*), 6) AS lost_nodes_pct
  FROM e GROUP BY sample % 2""")
def evidence_truncation(spark, sf):
    nodes = A.order_nodes(spark, sf).select("unit", "idx")
    pairs = nodes.filter("idx > 0").select("unit", (F.col("idx") - 1).alias("src_idx"), F.col("idx").alias("dst_idx"))
    ranks = ranked(A.order_units(spark, sf), ["sample"], [F.col("unit")], "rank", 0)
    edges = pairs.join(ranks, "unit").withColumn("label", F.col("sample") % 2)
    return rounded(Q.evidence_truncation(edges, CAP, 4, ["label"]), "lost_units_pct", "lost_nodes_pct")


@query("selection_coverage", f"""WITH {OEV}, d AS ({SEL.DENSE}),
  f AS (SELECT sample, unit FROM ounits QUALIFY row_number() OVER (PARTITION BY sample ORDER BY unit) <= {CAP}),
  g AS (SELECT sample, unit FROM ounits LEFT JOIN d USING (unit)
        QUALIFY row_number() OVER (PARTITION BY sample ORDER BY coalesce(n_calls, 0) DESC, unit) <= {CAP}),
  s AS ({SEL.SPREAD}),
  a AS (SELECT 'first' AS policy, * FROM f UNION ALL SELECT 'density', * FROM g UNION ALL SELECT 'spread', * FROM s),
  t AS (SELECT count(*) AS total FROM oev)
  SELECT policy, count(*) AS kept, total, round(100.0::DOUBLE * count(*) / total, 6) AS kept_pct
  FROM a JOIN oev USING (sample, unit), t GROUP BY policy, total""")
def selection_coverage(spark, sf):
    units = A.order_units(spark, sf)
    nodes = A.order_nodes(spark, sf).join(units, "unit")  # an order has one customer
    out = Q.selection_coverage(order_evidence(spark, sf), {
        "first": S.first_k_units(units, CAP), "density": S.density_top_k(units, nodes, CAP),
        "spread": S.spread_top_k(units, CAP)})
    return rounded(out, "kept_pct")


SPLIT = f"""{SEL.DOCS}, sp AS (SELECT *, CASE WHEN n_chars % 5 = 0 THEN 'test' ELSE 'train' END AS split,
    CASE WHEN id % 13 <> 0 THEN source || (n_chars % 20) END AS grp FROM dl)"""


def split_docs(spark, sf):
    return SEL.docs(spark, sf).withColumns({
        "split": F.when(F.col("n_chars") % 5 == 0, "test").otherwise("train"),
        "grp": F.when(F.col("id") % 13 != 0, F.concat("source", (F.col("n_chars") % 20).cast("string")))})


@query("split_balance", f"""WITH {SPLIT} SELECT split, quality, count(*) AS n, sum(count(*)) OVER (PARTITION BY split)::BIGINT AS n_split,
    round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS pct FROM sp GROUP BY split, quality""")
def split_balance(spark, sf):
    return rounded(Q.split_balance(split_docs(spark, sf), "split", "quality"), "pct")


@query("group_leakage", f"""WITH {SPLIT}, g AS (SELECT grp, count(*) FILTER (split = 'train') AS tr, count(*) FILTER (split = 'test') AS te
    FROM sp WHERE grp IS NOT NULL GROUP BY grp)
  SELECT count(*) AS n_groups, count(*) FILTER (tr > 0 AND te > 0) AS leaked_groups,
         coalesce(sum(te) FILTER (tr > 0 AND te > 0), 0)::BIGINT AS leaked_test_rows,
         (SELECT count(*) FROM sp WHERE grp IS NULL) AS rows_without_group FROM g""")
def group_leakage(spark, sf):
    return Q.group_leakage(split_docs(spark, sf), "split", "grp")


def unit_sizes(spark, sf):
    n = A.order_nodes(spark, sf).groupBy("unit").agg(F.count(F.lit(1)).alias("n_nodes"))
    return A.order_units(spark, sf).join(n, "unit", "left").fillna(0, ["n_nodes"])


@query("unit_size_stats", f"""WITH {A.ONODES_SQL}, u AS (SELECT sample, u.unit, count(idx) AS n FROM ounits u LEFT JOIN onodes n ON n.unit = u.unit GROUP BY ALL)
  SELECT sample, count(*) AS n_units, min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS mean_size,
         count(*) FILTER (n <= 3) AS n_tiny FROM u GROUP BY sample""")
def unit_size_stats(spark, sf):
    return rounded(Q.unit_size_stats(unit_sizes(spark, sf)), "mean_size")


@query("find_sample", f"""WITH {A.ONODES_SQL}, c AS (SELECT sample, count(*) AS n_units FROM ounits GROUP BY sample)
  SELECT * FROM (SELECT s.*, coalesce(n_units, 0) AS n_units FROM osamples s LEFT JOIN c USING (sample) WHERE sample = 7)
  UNION ALL SELECT * FROM (SELECT s.*, n_units FROM osamples s JOIN c USING (sample) WHERE n_units = 12 ORDER BY sample LIMIT 1)""")
def find_sample(spark, sf):
    samples, units = A.order_samples(spark, sf), A.order_units(spark, sf)
    return Q.find_sample(samples, units, sample=7).unionByName(Q.find_sample(samples, units, n_units=12))


@query("anomaly_report", f"""WITH f AS ({ORACLE['boundary_flags']}),
  c AS (SELECT sample, count(*) AS n_units, count(*) FILTER (flags <> '') AS n_flagged,
        count(*) FILTER (flags LIKE '%SPREAD%') AS n_spread, count(*) FILTER (flags LIKE '%FAR%') AS n_far_unlink,
        count(*) FILTER (flags LIKE '%OVERLAP%') AS n_overlap FROM f GROUP BY sample)
  SELECT f.sample, unit, spread, coverage, flags, n_units, n_flagged, n_spread, n_far_unlink, n_overlap
  FROM f JOIN c USING (sample) WHERE flags <> ''
  QUALIFY row_number() OVER (PARTITION BY f.sample ORDER BY spread DESC, unit) <= 20""")
def anomaly_report(spark, sf):
    blocks = A.event_blocks(spark, sf)
    flags = I.boundary_flags(A.unit_entries(blocks), blocks, A.block_links(blocks), GR.PARAMS)
    out = Q.anomaly_report(flags, 20).withColumn("flags", F.concat_ws(",", "flags"))
    return rounded(out, "coverage")


@query("near_size_overlap", f"""WITH {SEL.DOCS}, r AS (SELECT max(lo) AS overlap_low, min(hi) AS overlap_high
    FROM (SELECT quality, min(n_chars) AS lo, max(n_chars) AS hi FROM dl GROUP BY quality))
  SELECT id, quality, n_chars, overlap_low, overlap_high FROM dl, r WHERE n_chars BETWEEN overlap_low AND overlap_high""")
def near_size_overlap(spark, sf):
    return Q.near_size_overlap(SEL.docs(spark, sf).select("id", "quality", "n_chars"), "n_chars", "quality")


@query("crosstab_source_bin", """SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS source,
    CASE WHEN grouping(lang) = 1 THEN 'TOTAL' ELSE lang END AS lang, count(*) AS n FROM documents GROUP BY CUBE (source, lang)""")
def crosstab_source_bin(spark, sf):
    return Q.crosstab_source_bin(table(spark, sf, "documents").select("source", "lang"), "source", "lang")


@query("plan_vs_built", """WITH b AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A')
  SELECT o_orderpriority, count(*) AS planned, count(l_orderkey) AS built, count(*) - count(l_orderkey) AS lost
  FROM orders LEFT JOIN b ON l_orderkey = o_orderkey GROUP BY o_orderpriority""")
def plan_vs_built(spark, sf):
    built = table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return Q.plan_vs_built(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), built, "o_orderpriority", "o_orderkey")


@query("funnel_counts", """WITH c AS (SELECT event_type AS step, floor(value / 100)::BIGINT::VARCHAR AS reason, count(*) AS n FROM events GROUP BY ALL)
  SELECT step, reason, n, round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS pct,
         round(100.0::DOUBLE * CASE WHEN step = 'purchase' THEN n ELSE 0 END / sum(CASE WHEN step = 'purchase' THEN n ELSE 0 END) OVER (), 6) AS kept_share FROM c""")
def funnel_counts(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_type").alias("step"),
                                            F.floor(F.col("value") / 100).cast("long").cast("string").alias("reason"))
    return rounded(Q.funnel_counts(log, "purchase"), "pct", "kept_share")


@query("failure_taxonomy", """WITH l AS (SELECT CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'out_of_scope' ELSE 'ok' END AS outcome,
    CASE WHEN event_type = 'error' THEN 'E' || ((props->>'$.k')::BIGINT % 4) END AS exception_type FROM events)
  SELECT outcome, exception_type, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM l), 6) AS pct FROM l GROUP BY ALL""")
def failure_taxonomy(spark, sf):
    e = F.col("event_type")
    log = table(spark, sf, "events").select(
        F.when(e == "error", "failed").when(e == "view", "out_of_scope").otherwise("ok").alias("outcome"),
        F.when(e == "error", F.concat(F.lit("E"), (F.get_json_object("props", "$.k").cast("long") % 4).cast("string"))).alias("exception_type"))
    return rounded(Q.failure_taxonomy(log), "pct")


@query("projection_from_prior", """WITH p AS (SELECT source, lang AS bin FROM documents WHERE source <> 'src7'),
  t AS (SELECT source, count(*) * 2.0::DOUBLE AS target FROM documents GROUP BY source),
  lim AS (SELECT sum(target * 0.7::DOUBLE) * 0.05::DOUBLE AS l FROM t),
  k AS (SELECT source, CASE WHEN source = 'src3' THEN least(target * 0.7::DOUBLE, l) ELSE target * 0.7::DOUBLE END AS kept FROM t, lim),
  own AS (SELECT source, bin, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY source) AS p FROM p GROUP BY source, bin),
  tot AS (SELECT bin, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM p GROUP BY bin)
  SELECT source, bin, round(kept * p, 6) AS expected FROM k JOIN own USING (source)
  UNION ALL SELECT source, bin, round(kept * p, 6) FROM k, tot WHERE source NOT IN (SELECT source FROM own)""")
def projection_from_prior(spark, sf):
    docs = table(spark, sf, "documents")
    prior = docs.filter("source <> 'src7'").select("source", F.col("lang").alias("bin"))
    targets = docs.groupBy("source").agg((F.count(F.lit(1)) * 2).alias("target"))
    return rounded(Q.projection_from_prior(prior, targets, 0.3, "src3", 0.05), "expected")


@query("confusion_matrix", "SELECT quality AS truth, toxic AS pred, count(*) AS n FROM labels GROUP BY ALL")
def confusion_matrix(spark, sf):
    return Q.confusion_matrix(table(spark, sf, "labels"), "quality", "toxic")


@query("reproduction_diff", """WITH a AS (SELECT lang, avg(n_chars) AS v FROM documents WHERE lang <> 'fr' GROUP BY lang),
  b AS (SELECT lang, avg(n_chars) AS v FROM documents JOIN labels USING (doc_id) WHERE lang <> 'es' GROUP BY lang)
  SELECT lang, round(a.v, 6) AS published, round(b.v, 6) AS recomputed, round(abs(b.v - a.v), 6) AS delta FROM a FULL JOIN b USING (lang)""")
def reproduction_diff(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    avg = lambda df: df.groupBy("lang").agg(F.avg("n_chars").alias("value"))
    sub = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id").filter("lang <> 'es'")
    out = Q.reproduction_diff(avg(docs.filter("lang <> 'fr'")), avg(sub), ["lang"])
    return rounded(out, "published", "recomputed", "delta")


@query("mean_std_report", """SELECT ddof, source, round(avg(n_chars), 6) AS mean, round(CASE ddof WHEN 1 THEN stddev_samp(n_chars) ELSE stddev_pop(n_chars) END, 6) AS std,
    count(*) AS n FROM documents, (VALUES (0), (1)) d(ddof) GROUP BY ddof, source""")
def mean_std_report(spark, sf):
    docs = table(spark, sf, "documents").select("source", "n_chars")
    parts = [Q.mean_std_report(docs, ["source"], "n_chars", d).withColumn("ddof", F.lit(d)) for d in (0, 1)]
    return rounded(parts[0].unionByName(parts[1]), "mean", "std")
