"""Probe models on MLlib; fitting and scoring stay distributed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import ratio
from ..scale import first_rows, keyed_join, materialize
from .features import class_weights_balanced
from .grouped import group_logistic, verdict
from .links import PairNet, pair_scores
from .metrics import roc_auc
from .sampling import balance_per_group, stratified_split

Fit = Callable[[DataFrame, DataFrame], DataFrame]


def _score(model: PipelineModel, test: DataFrame) -> DataFrame:
    keep = [c for c in test.columns if c not in ("_x",)]
    return model.transform(test).withColumn("score", vector_to_array("probability")[1]).select(*keep, "score", "prediction")


def rf_probe(train: DataFrame, test: DataFrame, features: Sequence[str], trees: int = 100, weight: str | None = None,
             label: str = "label", seed: int = 42, with_model: bool = False, bootstrap: bool = True):
    """Random forest; P(class 1) of every test row.  Without a weight column classes are balanced.

    One tree without ``bootstrap`` is a plain decision tree on all rows.
    """
    if weight is None:
        train, weight = class_weights_balanced(train, label, "_w"), "_w"
    steps = [VectorAssembler(inputCols=list(features), outputCol="_x"),
             RandomForestClassifier(featuresCol="_x", labelCol=label, weightCol=weight, numTrees=trees, seed=seed,
                                    bootstrap=bootstrap)]
    model = Pipeline(stages=steps).fit(train)
    out = _score(model, test)
    return (out, model) if with_model else out


def logreg_probe(train: DataFrame, test: DataFrame, features: Sequence[str], label: str = "label",
                 weight: str | None = None) -> DataFrame:
    """Logistic regression on scaled features, multinomial when there are more than two classes."""
    logreg = LogisticRegression(featuresCol="_x", labelCol=label, maxIter=100)
    if weight is not None:
        logreg = logreg.setWeightCol(weight)
    steps = [VectorAssembler(inputCols=list(features), outputCol="_raw"),
             StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True), logreg]
    return _score(Pipeline(stages=steps).fit(train), test)


def oof_scores(df: DataFrame, folds: Sequence[int], fit: Fit, fold: str = "fold") -> DataFrame:
    """Out-of-fold scores: each fold is scored by a model of the others."""
    df = materialize(df)
    parts = [fit(df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)) for k in folds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cv_probe(df: DataFrame, folds: Sequence[int], fit: Fit, metric: Callable[[DataFrame, list[str]], DataFrame] = roc_auc,
             value: str = "auc", fold: str = "fold", label: str = "label") -> DataFrame:
    """Metric per fold with mean and population deviation; folds where it is undefined are left out."""
    scored = oof_scores(df, folds, fit, fold)
    per = metric(scored.withColumnRenamed(label, "label") if label != "label" else scored, [fold])
    ok = per.filter(F.col(value).isNotNull()).select(fold, F.col(value).alias("value"))
    stats = ok.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return ok.withColumns({"mean": stats.select("mean").scalar(), "std": stats.select("std").scalar()})


def feature_importance(model: PipelineModel, names: Sequence[str], spark) -> DataFrame:
    """Ranked importances of a fitted forest, one row per feature name."""
    values = model.stages[-1].featureImportances.toArray()
    rows = sorted(((n, float(v)) for n, v in zip(names, values)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(i + 1, n, v) for i, (n, v) in enumerate(rows)], "rank int, feature string, importance double")


def _group_rows(df: DataFrame, group: str, label: str, features: Sequence[str], min_samples: int, seed: str, key: str) -> DataFrame:
    """Per group its positives and as many negatives, with the features of each."""
    picked = balance_per_group(df, group, label, min_samples, seed, key)
    return materialize(keyed_join(picked, df.select(key, *features).dropDuplicates([key]), [key]))


def group_probe(df: DataFrame, group: str, label: str, features: Sequence[str], min_samples: int = 20, seed: str = "42",
                key: str = "id") -> DataFrame:
    """Accuracy and F1 of a logistic model per group against as many negatives, with a verdict.

    Groups that cannot reach ``min_samples`` are skipped. The models of any number of groups are fitted together.
    """
    rows = _group_rows(df, group, label, features, min_samples, seed, key)
    return group_logistic(stratified_split(rows, label, 0.8, seed, key, [group]), group, features, label)


def group_probe_forest(df: DataFrame, group: str, label: str, features: Sequence[str], min_samples: int = 20, seed: str = "42",
                       trees: int = 100, key: str = "id") -> DataFrame:
    """As ``group_probe``, with one forest per group.

    As many models are fitted as groups pass ``min_samples``; their names are what the
    driver loops over.
    """
    rows = _group_rows(df, group, label, features, min_samples, seed, key)
    out = None
    for g in [r[0] for r in rows.select(group).distinct().orderBy(group).collect()]:
        one = stratified_split(rows.filter(F.col(group) == g), label, 0.8, seed, key)
        scored = rf_probe(one.filter("split = 'train'"), one.filter("split = 'test'"), features, trees, label=label)
        hit = F.col("prediction") == F.col(label)
        tp = F.count_if((F.col("prediction") == 1) & (F.col(label) == 1))
        stats = scored.agg(F.avg(hit.cast("double")).alias("accuracy"),
                           F.coalesce(ratio(2 * tp, F.count_if(F.col("prediction") == 1) + F.count_if(F.col(label) == 1)),
                                      F.lit(0.0)).alias("f1"), F.count(F.lit(1)).alias("n_test"))
        stats = stats.select(F.lit(g).alias(group), "*")
        out = stats if out is None else out.unionByName(stats)
    if out is None:
        return df.sparkSession.createDataFrame([], f"{group} string, accuracy double, f1 double, n_test long, verdict string")
    return out.withColumn("verdict", verdict(F.col("accuracy")))


def majority_baseline(df: DataFrame, target: str) -> DataFrame:
    """Accuracy of always naming the most frequent class, ties to the smaller name."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by(target, F.struct(-F.col("n"), F.col(target))).alias("majority"),
                      ratio(F.max("n"), F.sum("n")).alias("accuracy"))


def majority_from_label(df: DataFrame, target: str, label: str) -> DataFrame:
    """Accuracy of naming each label's most frequent target: what the label alone gives away."""
    counts = df.groupBy(label, target).agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy(label).agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return per.agg(ratio(F.sum("best"), F.sum("n")).alias("accuracy"), F.count(F.lit(1)).alias("n_labels"))


def pair_net(vectors: DataFrame, pairs: DataFrame, dim: int, seed: int = 42, iterations: int = 30) -> PairNet:
    """A network fitted on labelled pairs: two hidden layers, of ``dim`` and half as many units.

    ``vectors`` is ``(graph, i, vector)``, ``pairs`` ``(graph, i, j, label)`` as given by ``negative_pair_sampling``.
    """
    a = vectors.select("graph", "i", F.col("vector").alias("va"))
    b = vectors.select("graph", F.col("i").alias("j"), F.col("vector").alias("vb"))
    rows = keyed_join(keyed_join(pairs, a, ["graph", "i"]), b, ["graph", "j"])
    rows = materialize(rows.select("label", F.concat("va", "vb").alias("x")))
    data = rows.withColumn("features", array_to_vector(F.col("x").cast("array<double>")))
    net = MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=[2 * dim, dim, max(dim // 2, 2), 2],
                                         seed=seed, maxIter=iterations)
    return PairNet.of(net.fit(data))


def pair_link_probe(vectors: DataFrame, pairs: DataFrame, candidates: DataFrame, dim: int, threshold: float = 0.5,
                    max_pairs: int | None = None, seed: int = 42, iterations: int = 30) -> DataFrame:
    """Links that a network, learned from weakly labelled ``pairs``, predicts among ``candidates`` (graph, i, j).

    All candidates above the threshold are returned, or the ``max_pairs`` best of each graph if that is given.
    """
    net = pair_net(vectors, pairs, dim, seed, iterations)
    links = pair_scores(vectors, candidates.select("graph", "i", "j"), net).filter(F.col("p") > threshold)
    if max_pairs is None:
        return links
    return first_rows(links, ["graph"], [F.col("p").desc(), F.col("i").asc(), F.col("j").asc()], max_pairs)
