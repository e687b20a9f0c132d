"""Queries of the evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from . import adapters as A
from .registry import big, query, rounded

S = A.SCORES_SQL + ",\nvalid AS (SELECT * FROM scores WHERE score IS NOT NULL)"
L = A.LINE_SCORES_SQL
ROUNDS, SEED = 2000, "7"


def auc_sql(rows: str, by: str, weight: str = "1", extra: str = "") -> str:
    """CTEs ``pts``/``cum``/``area`` with tie-aware AUC per ``by``."""
    return f"""
  pts{extra} AS (SELECT {by}, score, sum(CASE WHEN label = 1 THEN {weight} ELSE 0 END)::DOUBLE AS pos,
                 sum(CASE WHEN label = 0 THEN {weight} ELSE 0 END)::DOUBLE AS neg FROM {rows} GROUP BY {by}, score),
  cum{extra} AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY score
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM pts{extra}),
  area{extra} AS (SELECT {by}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                  THEN sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) END AS auc,
                  sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg FROM cum{extra} GROUP BY {by})"""


@query("roc_auc", f"WITH {L}, {auc_sql('line_scores', 'model')} SELECT model, round(auc, 6) AS auc, n_pos, n_neg FROM area")
def roc_auc(spark, sf):
    return rounded(M.roc_auc(A.line_scores(spark, sf)), "auc")


PR_SQL = """
  pts AS (SELECT model, score, sum((label = 1)::INT)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM {rows} GROUP BY ALL),
  cum AS (SELECT model, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM pts
          WINDOW w AS (PARTITION BY model ORDER BY score DESC))
  SELECT model, round(sum(pos * tp / seen) / sum(pos), 6) AS pr_auc FROM cum GROUP BY model"""


@query("pr_auc", f"WITH {L}, {PR_SQL.format(rows='line_scores')}")
def pr_auc(spark, sf):
    return rounded(M.pr_auc(A.line_scores(spark, sf)), "pr_auc")


@query("balanced_accuracy", f"""WITH {S}
  SELECT model, round((avg((score >= 0.5)::INT) FILTER (label = 1) + avg((score < 0.5)::INT) FILTER (label = 0)) / 2, 6)
         AS balanced_accuracy FROM valid GROUP BY model""")
def balanced_accuracy(spark, sf):
    return rounded(M.balanced_accuracy(A.scores(spark, sf), 0.5), "balanced_accuracy")


@query("accuracy_prf1", f"""WITH {S}, c AS (
    SELECT model, count(*) FILTER (label = 1 AND score >= 0.5)::DOUBLE AS tp,
           count(*) FILTER (label = 0 AND score >= 0.5)::DOUBLE AS fp,
           count(*) FILTER (label = 1 AND score < 0.5)::DOUBLE AS fn, count(*)::DOUBLE AS n,
           count(*) FILTER ((label = 1) = (score >= 0.5))::DOUBLE AS ok FROM valid GROUP BY model)
  SELECT model, round(ok / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
         round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
         round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def accuracy_prf1(spark, sf):
    df = M.valid_scores(A.scores(spark, sf)).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return rounded(M.accuracy_prf1(df, "label", "pred", ["model"]), "accuracy", "precision", "recall", "f1")


@query("threshold_at_tpr", f"""WITH {L}
  SELECT model, round(quantile_cont(score, 0.05::DOUBLE), 6) AS thr FROM line_scores WHERE label = 1 GROUP BY model""")
def threshold_at_tpr(spark, sf):
    return rounded(M.threshold_at_tpr(A.line_scores(spark, sf), 0.95), "thr")


@query("fpr_at_tpr", f"""WITH {S}, t AS (
    SELECT model, quantile_cont(score, (1.0 - 0.95)::DOUBLE) AS thr FROM valid WHERE label = 1 GROUP BY model)
  SELECT model, round(thr, 6) AS thr, round(avg((score >= thr)::INT), 6) AS fpr
  FROM valid JOIN t USING (model) WHERE label = 0 GROUP BY model, thr""")
def fpr_at_tpr(spark, sf):
    return rounded(M.fpr_at_tpr(A.scores(spark, sf), 0.95), "thr", "fpr")


@query("recall_at_fpr", f"""WITH {S}, f AS (SELECT * FROM (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)) t(fpr)),
  q AS (SELECT model, quantile_cont(score, [0.99::DOUBLE, 0.95::DOUBLE, 0.9::DOUBLE]) AS qs
        FROM valid WHERE label = 0 GROUP BY model),
  t AS (SELECT model, fpr, CASE fpr WHEN 0.01::DOUBLE THEN qs[1] WHEN 0.05::DOUBLE THEN qs[2] ELSE qs[3] END AS thr
        FROM q, f)
  SELECT model, fpr, round(thr, 6) AS thr, round(avg((score >= thr)::INT), 6) AS recall
  FROM valid JOIN t USING (model) WHERE label = 1 GROUP BY model, fpr, thr""")
def recall_at_fpr(spark, sf):
    return rounded(M.recall_at_fpr(A.scores(spark, sf)), "thr", "recall")


@query("brier", f"WITH {L} SELECT model, round(avg((score - label) * (score - label)), 6) AS brier FROM line_scores GROUP BY model")
def brier(spark, sf):
    return rounded(M.brier(A.line_scores(spark, sf)), "brier")


WILSON = """round(greatest(0.0, (k::DOUBLE / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n)
    - 1.96 / (1 + 3.8416 / n) * sqrt((k::DOUBLE / n) * (1 - k::DOUBLE / n) / n + 3.8416 / (4.0 * n * n))), 6) AS wilson_low,
  round(least(1.0, (k::DOUBLE / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n)
    + 1.96 / (1 + 3.8416 / n) * sqrt((k::DOUBLE / n) * (1 - k::DOUBLE / n) / n + 3.8416 / (4.0 * n * n))), 6) AS wilson_high"""


@query("wilson_ci", f"""WITH {S}, c AS (
    SELECT cluster, count(*) AS n, count(*) FILTER (label = 1) AS k FROM valid WHERE model = 'a' GROUP BY cluster)
  SELECT cluster, k, n, {WILSON} FROM c""")
def wilson_ci(spark, sf):
    counts = (A.scores(spark, sf).filter("model = 'a'").groupBy("cluster")
              .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("k")))
    return rounded(M.wilson_ci(counts, "k", "n"), "wilson_low", "wilson_high")


@query("fpr_by_bin", f"""WITH {S}, t AS (
    SELECT model, quantile_cont(score, (1.0 - 0.95)::DOUBLE) AS thr FROM valid WHERE label = 1 GROUP BY model),
  c AS (SELECT model, bin, count(*) AS n, count(*) FILTER (score >= thr) AS k
        FROM valid JOIN t USING (model) WHERE label = 0 GROUP BY model, bin)
  SELECT model, bin, n, k, round(k::DOUBLE / n, 6) AS fpr, {WILSON} FROM c""")
def fpr_by_bin(spark, sf):
    sc = A.scores(spark, sf)
    return rounded(M.fpr_by_bin(sc, M.threshold_at_tpr(sc, 0.95)), "fpr", "wilson_low", "wilson_high")


def boot_sql(source: str) -> str:
    return f"""
  cl AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS cidx FROM (SELECT DISTINCT cluster FROM {source})),
  nc AS (SELECT count(*) AS k FROM cl),
  picks AS (SELECT b, ('0x' || substr(md5('{SEED}|' || b || '|' || i), 1, 8))::BIGINT % k AS cidx
            FROM nc, range({ROUNDS}) t(b), range(1000000) u(i) WHERE i < k),
  mult AS (SELECT b, cluster, count(*) AS m FROM picks JOIN cl USING (cidx) GROUP BY ALL)"""


@query("cluster_bootstrap_ci", f"""WITH {S}, pool AS (SELECT * FROM valid WHERE model = 'a'), {boot_sql('pool')},
  rows_b AS (SELECT b, label, score, m FROM pool JOIN mult USING (cluster)), {auc_sql('rows_b', 'b', 'm')}
  SELECT round(quantile_cont(auc, 0.025::DOUBLE), 4) AS ci_low, round(quantile_cont(auc, 0.975::DOUBLE), 4) AS ci_high,
         count(*) AS rounds_used FROM area WHERE auc IS NOT NULL""")
def cluster_bootstrap_ci(spark, sf):
    df = M.cluster_bootstrap_ci(A.scores(spark, sf).filter("model = 'a'"), "auc", ROUNDS, SEED)
    return rounded(df, "ci_low", "ci_high", places=4)


@query("paired_bootstrap_diff", f"""WITH {S}, pool AS (
    SELECT x.id, x.label, x.cluster, x.score AS sa, y.score AS sb FROM valid x JOIN valid y ON x.id = y.id
    WHERE x.model = 'a' AND y.model = 'c'), {boot_sql('pool')},
  ra AS (SELECT b, label, sa AS score, m FROM pool JOIN mult USING (cluster)),
  rb AS (SELECT b, label, sb AS score, m FROM pool JOIN mult USING (cluster)),
  {auc_sql('ra', 'b', 'm', '_a')}, {auc_sql('rb', 'b', 'm', '_b')},
  d AS (SELECT area_a.auc - area_b.auc AS v FROM area_a JOIN area_b USING (b))
  SELECT round(quantile_cont(v, 0.025::DOUBLE), 4) AS ci_low, round(quantile_cont(v, 0.975::DOUBLE), 4) AS ci_high,
         count(*) AS rounds_used FROM d WHERE v IS NOT NULL""")
def paired_bootstrap_diff(spark, sf):
    return rounded(M.paired_bootstrap_diff(A.scores(spark, sf), "a", "c", ROUNDS, SEED), "ci_low", "ci_high", places=4)


@query("paired_valid_set", f"""WITH {S}
  SELECT id, label, max(score) FILTER (model = 'a') AS score_a, max(score) FILTER (model = 'c') AS score_c
  FROM valid WHERE model IN ('a', 'c') GROUP BY id, label HAVING count(DISTINCT model) = 2""")
def paired_valid_set(spark, sf):
    return M.paired_valid_set(A.scores(spark, sf), ["a", "c"])


@query("stratum_auc", f"WITH {S}, {auc_sql('valid', 'model, bin')} SELECT model, bin, round(auc, 6) AS auc, n_pos, n_neg FROM area")
def stratum_auc(spark, sf):
    return rounded(M.stratum_auc(A.scores(spark, sf), "bin"), "auc")


@query("oriented_auc", f"""WITH d AS (SELECT n_chars::DOUBLE AS score, quality AS label, lang
    FROM documents JOIN labels USING (doc_id)), {auc_sql('d', 'lang')}
  SELECT lang, round(auc, 6) AS auc, n_pos, n_neg, round(greatest(auc, 1 - auc), 6) AS oriented_auc FROM area""")
def oriented_auc(spark, sf):
    df = M.oriented_auc(A.labelled(spark, sf), "n_chars", "quality", ["lang"])
    return rounded(df, "auc", "oriented_auc")


@query("mann_whitney_u", f"""WITH {S}, r AS (
    SELECT model, label, rank() OVER (PARTITION BY model ORDER BY score)
           + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS rk,
           count(*) OVER (PARTITION BY model, score) AS t FROM valid),
  a AS (SELECT model, sum(rk) FILTER (label = 1) AS r1, count(*) FILTER (label = 1)::DOUBLE AS n1,
        count(*) FILTER (label = 0)::DOUBLE AS n0, sum(t::DOUBLE * t - 1) AS ties FROM r GROUP BY model),
  u AS (SELECT model, r1 - n1 * (n1 + 1) / 2 AS u, n1, n0, ties, n1 + n0 AS n FROM a),
  zs AS (SELECT model, u, (u - n1 * n0 / 2) / sqrt(n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM u),
  -- the normal density, integrated from |z| in 40,000 steps by Simpson's rule
  tail AS (SELECT model, sum(exp(-x * x / 2) * CASE WHEN i IN (0, 40000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * 0.0005 / 3 / sqrt(2 * pi()) AS q
           FROM (SELECT model, i, abs(z) + i * 0.0005 AS x FROM zs, (SELECT unnest(range(40001)) AS i)) GROUP BY model)
  SELECT model, round(u, 6) AS u, round(z, 6) AS z, round(2 * q, 9) AS p_value FROM zs JOIN tail USING (model)""")
def mann_whitney_u(spark, sf):
    return rounded(rounded(M.mann_whitney_u(A.scores(spark, sf)), "u", "z"), "p_value", places=9)


@query("evaluation_report", f"""WITH {S}, t AS (
    SELECT model, quantile_cont(score, (1.0 - 0.95)::DOUBLE) AS thr FROM valid WHERE label = 1 AND id % 2 = 0 GROUP BY model),
  e AS (SELECT valid.*, thr, (score >= thr)::INT AS hit FROM valid JOIN t USING (model) WHERE id % 2 = 1),
  {auc_sql('e', 'model')},
  k AS (SELECT model, bin, max(thr) AS thr, count(*) FILTER (label = 0) AS n, count(*) FILTER (label = 0 AND hit = 1) AS k,
               avg(hit) FILTER (label = 1) AS recall, grouping(bin) AS whole FROM e GROUP BY GROUPING SETS ((model), (model, bin)))
  SELECT model, bin, round(thr, 6) AS thr, n AS n_neg, k AS n_hit, round(k::DOUBLE / n, 6) AS fpr, {{wilson}},
         CASE WHEN whole = 1 THEN round(recall, 6) END AS recall, CASE WHEN whole = 1 THEN round(auc, 6) END AS auc
  FROM k JOIN area USING (model) WHERE n > 0""".replace("{wilson}", WILSON))
def evaluation_report(spark, sf):
    rows = A.scores(spark, sf)
    report = M.evaluation_report(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), rounds=ROUNDS, seed=SEED)
    return rounded(report.drop("ci_low", "ci_high", "rounds_used"), "thr", "fpr", "wilson_low", "wilson_high", "recall", "auc")


@query("bootstrap_fpr_at_threshold", f"""WITH {S}, t AS (
    SELECT quantile_cont(score, (1.0 - 0.95)::DOUBLE) AS thr FROM valid WHERE model = 'a' AND label = 1 AND id % 2 = 0),
  pool AS (SELECT cluster, label, (score >= thr)::INT AS hit FROM valid, t WHERE model = 'a' AND id % 2 = 1), {boot_sql('pool')},
  v AS (SELECT b, sum(m * hit)::DOUBLE / sum(m) AS v FROM pool JOIN mult USING (cluster) WHERE label = 0 GROUP BY b)
  SELECT round(quantile_cont(v, 0.025::DOUBLE), 4) AS ci_low, round(quantile_cont(v, 0.975::DOUBLE), 4) AS ci_high, count(*) AS rounds_used FROM v""")
def bootstrap_fpr_at_threshold(spark, sf):
    rows = A.scores(spark, sf).filter("model = 'a'")
    report = M.evaluation_report(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), rounds=ROUNDS, seed=SEED)
    return rounded(report.filter("bin IS NULL AND rounds_used IS NOT NULL").select("ci_low", "ci_high", "rounds_used"), "ci_low", "ci_high", places=4)


@query("vendor_or_subset_metrics", f"""WITH {S}, tagged AS (
    SELECT model, 'cluster' AS key, cluster AS value, label, score FROM valid
    UNION ALL SELECT model, 'bin', bin, label, score FROM valid
    UNION ALL SELECT model, 'all', 'all', label, score FROM valid), {auc_sql('tagged', 'model, key, value')}
  SELECT model, key, value, round(auc, 6) AS auc, n_pos, n_neg FROM area""")
def vendor_or_subset_metrics(spark, sf):
    return rounded(M.vendor_or_subset_metrics(A.scores(spark, sf), ["cluster", "bin"]), "auc")


@query("ensemble_mean", f"""WITH {S}
  SELECT id, label, round(avg(score), 6) AS score, count(*) AS n_scores FROM valid GROUP BY id, label""")
def ensemble_mean(spark, sf):
    return rounded(M.ensemble_mean(A.scores(spark, sf)), "score")


@query("ensemble_mean_all_members", f"""WITH {S}
  SELECT id, label, round(avg(score), 6) AS score, count(*) AS n_scores FROM valid GROUP BY id, label
  HAVING count(*) = 3""")
def ensemble_mean_all_members(spark, sf):
    return rounded(M.ensemble_mean(A.scores(spark, sf), require_all=True), "score")
