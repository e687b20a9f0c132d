"""Evaluation metrics as grouped aggregates; scores never leave the executors.

Scores are ``(model, id, label, score, cluster, bin)``; rows without a finite score do
not take part.  ``by`` names the columns that separate independent evaluations.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.order import hash_index
from ..functions.rounds import dense_draws, slice_areas
from ..functions.stats import finite, ratio, wilson_bounds
from ..scale import Carry, exact_quantiles, keyed_join, materialize, may_broadcast, prefix_scan, ranked


def _pos() -> Column:
    return F.col("label") == 1


def _neg() -> Column:
    return F.col("label") == 0


def valid_scores(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", finite(F.col("score"))).filter(
        F.col("score").isNotNull() & F.col("label").isNotNull())


def _points(scores: DataFrame, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Positives and negatives per distinct score: the only thing curves need."""
    w = F.lit(1) if weight is None else weight
    return (valid_scores(scores).groupBy(*by, "score")
            .agg(F.sum(F.when(_pos(), w).otherwise(0)).cast("double").alias("pos"),
                 F.sum(F.when(_neg(), w).otherwise(0)).cast("double").alias("neg")))


def _auc_of_points(points: DataFrame, by: Sequence[str]) -> DataFrame:
    scan = prefix_scan(points, by, [F.col("score").asc()], below=Carry("sum", F.col("neg")))
    return (scan.groupBy(*by)
            .agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("area"),
                 F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
            .select(*by, ratio(F.col("area"), F.col("n_pos") * F.col("n_neg")).alias("auc"),
                    F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg")))


def roc_auc(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Tie-aware area under the ROC curve, NULL when a class is missing."""
    by = list(by)
    return _auc_of_points(_points(scores, by), by)


def pr_auc(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Average precision over distinct thresholds, NULL when a class is missing."""
    by = list(by)
    scan = prefix_scan(_points(scores, by), by, [F.col("score").desc()],
                       tp=Carry("sum", F.col("pos")), seen=Carry("sum", F.col("pos") + F.col("neg")))
    precision = ratio(F.col("tp") + F.col("pos"), F.col("seen") + F.col("pos") + F.col("neg"))
    return (scan.groupBy(*by)
            .agg(F.sum(F.col("pos") * precision).alias("area"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
            .select(*by, F.when(F.col("n") > 0, ratio(F.col("area"), F.col("p"))).alias("pr_auc")))


def balanced_accuracy(scores: DataFrame, thr: float, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean of the recalls of the classes that are present, predicting 1 at score >= thr."""
    hit = F.col("score") >= F.lit(float(thr))
    return (valid_scores(scores).groupBy(*by)
            .agg(F.avg(F.when(_pos(), hit.cast("double"))).alias("r1"),
                 F.avg(F.when(_neg(), (~hit).cast("double"))).alias("r0"))
            .select(*by, ((F.coalesce("r1", "r0") + F.coalesce("r0", "r1")) / 2).alias("balanced_accuracy")))


def accuracy_prf1(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; undefined ratios are 0."""
    t, p = F.col(truth) == 1, F.col(pred) == 1
    sums = df.groupBy(*by).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"),
        F.count_if(F.col(truth) == F.col(pred)).alias("ok"), F.count(F.lit(1)).alias("n"))
    zero = F.lit(0.0)
    return sums.select(
        *by, F.coalesce(ratio(F.col("ok"), F.col("n")), zero).alias("accuracy"),
        F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp")), zero).alias("precision"),
        F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fn")), zero).alias("recall"),
        F.coalesce(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero).alias("f1"))


def threshold_at_tpr(scores: DataFrame, tpr: float = 0.95, by: Sequence[str] = ("model",)) -> DataFrame:
    """Score that keeps ``tpr`` of the positives: their linear ``1 - tpr`` quantile."""
    return exact_quantiles(valid_scores(scores).filter(_pos()), by, "score", {"thr": 1.0 - tpr})


def _share_at(scores: DataFrame, thresholds: DataFrame, by: Sequence[str], cls: Column, name: str) -> DataFrame:
    rows = valid_scores(scores).filter(cls)
    joined = keyed_join(rows, thresholds, list(by)) if by else rows.withColumn("thr", thresholds.scalar())
    return joined.groupBy(*by).agg(F.max("thr").alias("thr"),
                                   F.avg((F.col("score") >= F.col("thr")).cast("double")).alias(name))


def fpr_at_tpr(scores: DataFrame, tpr: float = 0.95, by: Sequence[str] = ("model",)) -> DataFrame:
    """Threshold at the wanted recall and the share of negatives at or above it."""
    return _share_at(scores, threshold_at_tpr(scores, tpr, by), by, _neg(), "fpr")


def recall_at_fpr(scores: DataFrame, fprs: Sequence[float] = (0.01, 0.05, 0.10),
                  by: Sequence[str] = ("model",)) -> DataFrame:
    """Recall where the threshold is the ``1 - fpr`` quantile of the negatives, one row per fpr."""
    by = list(by)
    wide = exact_quantiles(valid_scores(scores).filter(_neg()), by, "score",
                           {f"q{i}": 1.0 - f for i, f in enumerate(fprs)})
    levels = F.array(*[F.struct(F.lit(float(f)).alias("fpr"), F.col(f"q{i}").alias("thr"))
                       for i, f in enumerate(fprs)])
    per = wide.select(*by, levels.alias("levels"))
    rows = valid_scores(scores).filter(_pos())
    joined = keyed_join(rows, per, by) if by else rows.withColumn("levels", per.scalar())
    return (joined.select(*by, "score", F.inline("levels"))
            .groupBy(*by, "fpr")
            .agg(F.avg((F.col("score") >= F.col("thr")).cast("double")).alias("recall"),
                 F.max("thr").alias("thr")))


def brier(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean squared difference of score and label."""
    err = F.col("score") - F.col("label").cast("double")
    return valid_scores(scores).groupBy(*by).agg(F.avg(err * err).alias("brier"))


def wilson_ci(df: DataFrame, k: str, n: str, z: float = 1.96) -> DataFrame:
    """Add the Wilson interval of k successes in n trials."""
    low, high = wilson_bounds(F.col(k), F.col(n), z)
    return df.withColumns({"wilson_low": low, "wilson_high": high})


def fpr_by_bin(scores: DataFrame, thr: DataFrame | float, by: Sequence[str] = ("model",)) -> DataFrame:
    """False-positive rate with interval per stratum; strata without negatives do not appear."""
    neg = valid_scores(scores).filter(_neg())
    if isinstance(thr, DataFrame):
        neg = keyed_join(neg, thr.select(*by, "thr"), list(by))
    else:
        neg = neg.withColumn("thr", F.lit(float(thr)))
    counts = neg.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"),
                                         F.count_if(F.col("score") >= F.col("thr")).alias("k"))
    return wilson_ci(counts.withColumn("fpr", ratio(F.col("k"), F.col("n"))), "k", "n")


# ------------------------------------------------------------------ cluster bootstrap


def _draws(clusters: DataFrame, n_clusters: int, rounds: int, seed: str) -> DataFrame:
    """Per cluster the rounds that drew it and how often: (cluster, draws array<b, m>)."""
    spark = clusters.sparkSession
    picks = spark.range(rounds * n_clusters).select(
        (F.col("id") / n_clusters).cast("long").alias("b"), (F.col("id") % n_clusters).alias("i"))
    drawn = (picks.withColumn("cidx", hash_index(seed, n_clusters, "b", "i"))
             .groupBy("cidx", "b").agg(F.count(F.lit(1)).alias("m")))
    # at most ``rounds`` entries per cluster
    per = drawn.groupBy("cidx").agg(F.collect_list(F.struct("b", "m")).alias("draws"))
    return clusters.join(per, "cidx").select("cluster", "draws")


def resampled(scores: DataFrame, rounds: int, seed: str, values: Sequence[str]) -> DataFrame:
    """Counts of (round, label, values) after drawing whole clusters with replacement.

    Rows are first counted per (cluster, label, values), so a huge cluster is small before
    it is repeated once per round that drew it.
    """
    compact = (scores.groupBy("cluster", "label", *values).agg(F.count(F.lit(1)).alias("n")))
    clusters = ranked(compact.select("cluster").distinct(), [], [F.col("cluster")], "cidx", 0)
    n_clusters = clusters.count()
    if n_clusters == 0:
        return compact.select(F.lit(0).cast("long").alias("b"), "label", *values, "n").limit(0)
    joined = keyed_join(compact, _draws(clusters, n_clusters, rounds, seed), ["cluster"])
    return (joined.select("label", *values, "n", F.inline("draws"))
            .groupBy("b", "label", *values).agg(F.sum(F.col("n") * F.col("m")).alias("n")))


def _boot_auc(weighted: DataFrame, score: str) -> DataFrame:
    points = _points(weighted.withColumn("score", F.col(score)), ["b"], F.col("n"))
    return _auc_of_points(points, ["b"]).select("b", F.col("auc").alias("value"))


def _round_aucs(scores: DataFrame, rounds: int, seed: str, names: Sequence[str]) -> list[DataFrame]:
    """(b, value) with the AUC of every round, for each of the named score columns, all on the same draws.

    Rows are not repeated per round: a cluster has one vector of its draws, and slices of the scores add these up for
    all rounds at once. A slice passes on one row; what lies below it is a running sum over the slices.
    """
    clusters = ranked(scores.select("cluster").distinct(), [], [F.col("cluster")], "cidx", 0)
    n_clusters = clusters.count()
    if n_clusters == 0:
        return [scores.select(F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("value")).limit(0) for _ in names]
    kind = dict(clusters.dtypes)["cluster"]
    draws = _draws(clusters, n_clusters, rounds, seed).select("cluster", F.col("draws.b").alias("b"), F.col("draws.m").alias("m"))
    times = materialize(draws.mapInPandas(dense_draws(rounds), f"cluster {kind}, times binary"))
    count = lambda cls: F.count_if(cls).alias
    out = []
    for name in names:
        points = scores.groupBy("cluster", F.col(name).alias("score")).agg(count(_pos())("pos"), count(_neg())("neg"))
        if may_broadcast(times):  # the vectors join after the rows are in place
            placed = points.repartitionByRange("score").join(F.broadcast(times), "cluster")
        else:
            placed = points.join(times, "cluster").repartitionByRange("score")
        slices = materialize(placed.select("score", "pos", "neg", "times").sortWithinPartitions("score").mapInPandas(
            slice_areas(rounds), "low double, area array<double>, pos array<double>, neg array<double>"))
        cells = slices.select("low", F.posexplode(F.arrays_zip("area", "pos", "neg")).alias("b", "x")).select("low", "b", "x.*")
        earlier = Window.partitionBy("b").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
        whole = cells.withColumn("below", F.coalesce(F.sum("neg").over(earlier), F.lit(0.0))).groupBy("b").agg(
            F.sum(F.col("area") + F.col("pos") * F.col("below")).alias("area"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
        out.append(whole.select(F.col("b").cast("long").alias("b"), ratio(F.col("area"), F.col("p") * F.col("n")).alias("value")))
    return out


def _boot_rate(weighted: DataFrame, hit: Column, cls: Column) -> DataFrame:
    return (weighted.filter(cls).groupBy("b")
            .agg(ratio(F.sum(F.when(hit, F.col("n")).otherwise(0)), F.sum("n")).alias("value")))


METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "auc": lambda w: _boot_auc(w, "score"),
    "fpr_at_half": lambda w: _boot_rate(w, F.col("score") >= 0.5, _neg()),
    "recall_at_half": lambda w: _boot_rate(w, F.col("score") >= 0.5, _pos()),
}


def _interval(values: DataFrame, lo: float, hi: float) -> DataFrame:
    # one value per round, so the buffer of percentile is bounded by the number of rounds
    ok = values.filter(F.col("value").isNotNull())
    return ok.agg(F.percentile("value", F.lit(lo)).alias("ci_low"), F.percentile("value", F.lit(hi)).alias("ci_high"),
                  F.count(F.lit(1)).alias("rounds_used"))


def cluster_bootstrap_ci(scores: DataFrame, metric: str | Callable[[DataFrame], DataFrame] = "auc",
                         B: int = 2000, seed: str = "1", lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Percentile interval of a metric over ``B`` draws of whole clusters; undefined rounds are left out."""
    if metric == "auc":
        return _interval(_round_aucs(valid_scores(scores), B, seed, ["score"])[0], lo, hi)
    fn = METRICS[metric] if isinstance(metric, str) else metric
    return _interval(fn(resampled(valid_scores(scores), B, seed, ["score"])), lo, hi)


def paired_bootstrap_diff(scores: DataFrame, a: str, b: str, B: int = 2000, seed: str = "1",
                          lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Interval of AUC(a) - AUC(b) on the same draws, over ids scored by both models."""
    wide = (valid_scores(scores).filter(F.col("model").isin(a, b)).groupBy("id", "label", "cluster")
            .agg(F.max(F.when(F.col("model") == a, F.col("score"))).alias("sa"),
                 F.max(F.when(F.col("model") == b, F.col("score"))).alias("sb")).dropna(subset=["sa", "sb"]))
    va, vb = _round_aucs(materialize(wide), B, seed, ["sa", "sb"])
    diff = va.withColumnRenamed("value", "va").join(vb.withColumnRenamed("value", "vb"), "b").select("b", (F.col("va") - F.col("vb")).alias("value"))
    return _interval(diff, lo, hi)


def paired_valid_set(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """Ids for which every named model has a finite score, one column per model."""
    picks = [F.max(F.when(F.col("model") == m, F.col("score"))).alias(f"score_{m}") for m in models]
    return (valid_scores(scores).filter(F.col("model").isin(*models)).groupBy("id", "label").agg(*picks)
            .dropna(subset=[f"score_{m}" for m in models]))


def stratum_auc(scores: DataFrame, stratum: str, by: Sequence[str] = ("model",)) -> DataFrame:
    """AUC inside each stratum with its class sizes."""
    return roc_auc(scores, [*by, stratum])


def oriented_auc(df: DataFrame, feature: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """AUC of one feature whichever way round separates better."""
    base = df.select(*by, F.col(feature).cast("double").alias("score"), F.col(label).alias("label"))
    return roc_auc(base, by).withColumn("oriented_auc", F.greatest(F.col("auc"), 1 - F.col("auc")))


def mann_whitney_u(scores: DataFrame, group: str = "label", by: Sequence[str] = ("model",)) -> DataFrame:
    """U of group 1 against group 0 and the two-sided normal p-value with tie correction."""
    by = list(by)
    points = _points(scores.withColumn("label", F.col(group)), by)
    scan = prefix_scan(points, by, [F.col("score").asc()], below=Carry("sum", F.col("neg")))
    t = F.col("pos") + F.col("neg")
    agg = scan.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"),
        F.sum("pos").alias("n1"), F.sum("neg").alias("n0"), F.sum(t * t * t - t).alias("ties"))
    n = F.col("n1") + F.col("n0")
    var = F.col("n1") * F.col("n0") / 12 * ((n + 1) - ratio(F.col("ties"), n * (n - 1)))
    z = ratio(F.col("u") - F.col("n1") * F.col("n0") / 2, F.sqrt(var))
    return agg.withColumn("z", z).select(*by, "u", "z", (2 * _upper_tail(F.abs(F.col("z")))).alias("p_value"))


def _upper_tail(x: Column) -> Column:
    """Upper tail of the standard normal for x >= 0, relative error below 1e-9.

    Up to 3 the series ``x + x^3/3 + x^5/(3*5) + ...`` times the density, beyond it the continued fraction
    ``1/(x + 1/(x + 2/(x + 3/(x + ...))))``; both are nested from their last term.
    """
    density = F.exp(-x * x / 2) / 2.5066282746310002
    inner, chain = F.lit(1.0), x
    for k in range(40, 0, -1):
        inner = 1 + x * x / (2 * k + 1) * inner
        chain = x + k / chain
    return F.when(x < 3, 0.5 - density * x * inner).otherwise(density / chain)


def evaluation_report(train: DataFrame, test: DataFrame, tpr: float = 0.95, rounds: int = 2000, seed: str = "42",
                      by: str = "model") -> DataFrame:
    """One table per model: a row for all of ``test`` (bin null) and one per bin.

    (model, bin, thr, n_neg, n_hit, fpr, wilson_low, wilson_high, recall, auc, ci_low, ci_high, rounds_used). The threshold
    is the score that keeps ``tpr`` of the positives of ``train``. Recall, AUC and the cluster-bootstrap interval
    of the false-positive rate at that threshold belong to the row for all. Models without positives in ``train`` have
    no threshold and no row. The intervals are made model by model; models are few.
    """
    thr = materialize(threshold_at_tpr(train, tpr, [by]))
    rows = keyed_join(valid_scores(test), thr, [by]).filter(F.col("thr").isNotNull())
    rows = materialize(rows.withColumn("hit", F.col("score") >= F.col("thr")))
    count = lambda keys: rows.groupBy(by, *keys).agg(
        F.max("thr").alias("thr"), F.count_if(_neg()).alias("n_neg"), F.count_if(_neg() & F.col("hit")).alias("n_hit"),
        F.avg(F.when(_pos(), F.col("hit").cast("double"))).alias("recall"))
    overall = count([]).withColumn("bin", F.lit(None).cast(rows.schema["bin"].dataType)).join(
        roc_auc(rows, [by]).select(by, "auc"), by, "left")
    boot = None
    for name in sorted(r[0] for r in thr.select(by).distinct().collect()):
        w = resampled(rows.filter(F.col(by) == name).withColumn("flag", F.col("hit").cast("double")), rounds, seed, ["flag"])
        one = _interval(_boot_rate(w, F.col("flag") == 1, _neg()), 0.025, 0.975).select(F.lit(name).alias(by), "*")
        boot = one if boot is None else boot.unionByName(one)
    if boot is not None:
        overall = overall.join(boot, by, "left")
    bins = count(["bin"]).filter("n_neg > 0").drop("recall")
    out = overall.unionByName(bins, allowMissingColumns=True)
    out = wilson_ci(out.withColumn("fpr", ratio(F.col("n_hit"), F.col("n_neg"))), "n_hit", "n_neg")
    return out.select(by, "bin", "thr", "n_neg", "n_hit", "fpr", "wilson_low", "wilson_high", "recall", "auc",
                      *[c for c in ("ci_low", "ci_high", "rounds_used") if c in out.columns])


def vendor_or_subset_metrics(scores: DataFrame, keys: Sequence[str], by: Sequence[str] = ("model",)) -> DataFrame:
    """AUC per value of each key column and over everything, as grouping sets."""
    tags = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys],
                   F.struct(F.lit("all").alias("key"), F.lit("all").alias("value")))
    return roc_auc(scores.withColumn("tag", F.explode(tags)).select("*", "tag.key", "tag.value"),
                   [*by, "key", "value"])


def ensemble_mean(scores: DataFrame, members: Sequence[str] | None = None, require_all: bool = False) -> DataFrame:
    """Mean of the finite member scores per id; ``require_all`` keeps ids every member scored."""
    rows = scores.withColumn("score", finite(F.col("score")))
    if members is not None:
        rows = rows.filter(F.col("model").isin(*members))
    agg = rows.groupBy("id", "label").agg(F.avg("score").alias("score"), F.count("score").alias("n_scores"))
    if not require_all:
        return agg.filter("n_scores > 0")
    wanted = F.lit(len(members)) if members is not None else rows.agg(F.count_distinct("model")).scalar()
    return agg.filter(F.col("n_scores") == wanted)


