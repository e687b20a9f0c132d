"""Logistic models of many groups, folds or feature sets, fitted together.

Single fits in a driver loop cost jobs per model. Here all models advance at once: a row of the training table belongs
to one model, a round sums gradient and Hessian per model in one aggregation, which is combined before its shuffle,
and the small systems are solved per model where they arrive. Rounds grow with the hardest model, not with their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import ratio
from ..scale import keyed_join, materialize
from .metrics import roc_auc

#: Weight of the squared coefficients per unit of row weight. It is there for models whose classes can be told apart
#: without error, or whose features are constant or collinear: their best coefficients are infinite or not unique.
RIDGE = 1e-8
#: A score up to 0.5 at this many places is class 0, so that ties do not hang on the last bit of a fit.
PLACES = 6


def _clean(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rows with a label and finite features."""
    ok = F.col(label).isNotNull()
    for f in features:
        x = F.col(f).cast("double")
        ok = ok & F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return df.filter(ok)


def _newton(n: int, by: Sequence[str], tolerance: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """One damped Newton step of every model of a batch.

    A step that made the loss worse is halved from the last good coefficients; else the next one is solved for.
    """
    upper = np.triu_indices(n)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if not len(df):
                continue
            beta, good = np.stack(df["beta"]), np.stack(df["good"])
            weight = df["weight"].to_numpy()
            ridge = np.where(np.arange(n) > 0, 1.0, 0.0)[None, :] * (RIDGE * weight)[:, None]
            grad = np.stack(df["grad"]) - ridge * beta
            hess = np.zeros((len(df), n, n))
            hess[:, upper[0], upper[1]] = np.stack(df["hess"])
            hess[:, upper[1], upper[0]] = hess[:, upper[0], upper[1]]
            hess += ridge[:, :, None] * np.eye(n) + 1e-12 * weight[:, None, None] * np.eye(n)
            loss = df["loss"].to_numpy() + 0.5 * (ridge * beta * beta).sum(axis=1)
            worse = loss > df["best"].to_numpy() * (1 + 1e-12) + 1e-12
            move = np.linalg.solve(hess, grad[:, :, None])[:, :, 0]
            gain = (move * grad).sum(axis=1)
            out = df[list(by)].copy()
            out["beta"] = list(np.where(worse[:, None], (beta + good) / 2, beta + move))
            out["good"] = list(np.where(worse[:, None], good, beta))
            out["best"] = np.where(worse, df["best"], loss)
            # halving ends where the step no longer changes anything
            still = np.abs(beta - good).max(axis=1) > 1e-9
            out["done"] = np.where(worse, ~still, gain <= tolerance * weight)
            out["rows"], out["rounds"] = df["rows"], df["rounds"] + 1
            yield out
    return step


def fit_logistic(train: DataFrame, by: Sequence[str], features: Sequence[str], label: str = "label", weight: str | None = None,
                 most_rounds: int = 60, tolerance: float = 1e-13) -> DataFrame:
    """(*by, intercept, coefficients, rows, rounds, converged): one logistic model per value of ``by``.

    ``train`` has one row per model and row; a row that trains many models comes once for each. Labels are 0 or 1.
    Rows without label or with a feature that is null or not finite are left out, and a model without rows does not exist.
    Features are centred and scaled over all rows for the arithmetic only. Sums are plain columns, so
    features may be a few dozen.
    """
    by, features = list(by), list(features)
    n = len(features) + 1
    rows = _clean(train, features, label)
    numbers = rows.select(*by, *[F.col(f).cast("double").alias(f"_f{j}") for j, f in enumerate(features)], F.col(label).cast("double").alias("_y"),
                          (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    numbers = materialize(numbers)
    spans = numbers.agg(F.count(F.lit(1)).alias("n"), *[f(f"_f{j}").alias(f"{k}{j}") for j in range(n - 1) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    centre = [float(spans[f"m{j}"] or 0.0) for j in range(n - 1)]
    scale = [float(spans[f"s{j}"] or 0.0) or 1.0 for j in range(n - 1)]

    x = [F.lit(1.0), *[(F.col(f"_f{j}") - F.lit(centre[j])) / F.lit(scale[j]) for j in range(n - 1)]]
    data = numbers.select(*by, *[c.alias(f"_x{j}") for j, c in enumerate(x)], "_y", "_w")
    x = [F.col(f"_x{j}") for j in range(n)]
    zero = F.array(*[F.lit(0.0)] * n)
    active = (numbers.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
              .select(*by, "rows", zero.alias("beta"), zero.alias("good"), F.lit(float("inf")).alias("best"), F.lit(0).alias("rounds")))
    active, finished = materialize(active), []
    types = {f.name: f.dataType.simpleString() for f in active.schema}
    state = ", ".join([*[f"`{b}` {types[b]}" for b in by], "beta array<double>", "good array<double>", "best double", "done boolean", "rows long", "rounds int"])

    for _ in range(most_rounds):
        joined = keyed_join(data, active.select(*by, "beta"), by)
        joined = joined.withColumn("_z", sum((F.col("beta")[j] * x[j] for j in range(1, n)), F.col("beta")[0]))
        joined = joined.withColumn("_p", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z"))))
        pull = F.col("_w") * (F.col("_y") - F.col("_p"))
        bend = F.col("_w") * F.col("_p") * (F.lit(1.0) - F.col("_p"))
        loss = F.col("_w") * (F.log1p(F.exp(-F.abs("_z"))) + F.greatest(F.col("_z"), F.lit(0.0)) - F.col("_y") * F.col("_z"))
        sums = joined.groupBy(*by).agg(
            F.sum("_w").alias("weight"), F.sum(loss).alias("loss"), *[F.sum(pull * x[j]).alias(f"_g{j}") for j in range(n)],
            *[F.sum(bend * x[i] * x[j]).alias(f"_h{i}_{j}") for i in range(n) for j in range(i, n)])
        sums = sums.select(*by, "weight", "loss", F.array(*[f"_g{j}" for j in range(n)]).alias("grad"),
                           F.array(*[f"_h{i}_{j}" for i in range(n) for j in range(i, n)]).alias("hess"))
        stepped = materialize(sums.join(active, by).mapInPandas(_newton(n, by, tolerance), state))
        finished.append(stepped.filter("done"))
        active = stepped.filter("NOT done").drop("done")
        if active.isEmpty():
            break
    out = active.withColumn("done", F.lit(False))
    for part in finished:
        out = out.unionByName(part)
    raw = [F.col("beta")[j + 1] / F.lit(scale[j]) for j in range(n - 1)]
    intercept = sum((-c * F.lit(m) for c, m in zip(raw, centre, strict=True)), F.col("beta")[0])
    return out.select(*by, intercept.alias("intercept"), F.array(*raw).cast("array<double>").alias("coefficients"), "rows", "rounds",
                      F.col("done").alias("converged"))


def score_logistic(df: DataFrame, models: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``df`` with ``score``, P(class 1) by the model of the row's group, null without one, and ``prediction``."""
    joined = keyed_join(df, models.select(*by, "intercept", "coefficients"), list(by), "left")
    z = sum((F.col("coefficients")[j] * F.col(f).cast("double") for j, f in enumerate(features)), F.col("intercept"))
    scored = joined.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).drop("intercept", "coefficients")
    return scored.withColumn("prediction", (F.round("score", PLACES) > 0.5).cast("int"))


def oof_logistic(df: DataFrame, features: Sequence[str], fold: str = "fold", label: str = "label") -> DataFrame:
    """Out-of-fold scores with all folds fitted together: a row trains the models of all other folds and is scored by its own."""
    df = materialize(df)
    folds = df.select(F.col(fold).alias("_model")).filter(F.col("_model").isNotNull()).distinct().agg(F.array_sort(F.collect_list("_model")))
    named = df.withColumn("_model", F.explode(folds.scalar()))
    train = named.filter(F.col("_model") != F.col(fold)).select("_model", label, *features)
    models = fit_logistic(train, ["_model"], features, label)
    return score_logistic(df, models.withColumnRenamed("_model", fold), [fold], features)


def cv_logistic(df: DataFrame, features: Sequence[str], fold: str = "fold", label: str = "label") -> DataFrame:
    """AUC per fold with mean and population deviation over the folds that have both classes."""
    scored = oof_logistic(df, features, fold, label).select(fold, F.col(label).alias("label"), "score")
    ok = roc_auc(scored, [fold]).filter(F.col("auc").isNotNull()).select(fold, F.col("auc").alias("value"))
    stats = ok.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return ok.withColumns({c: stats.select(c).scalar() for c in ("mean", "std")})


def ablation_logistic(train: DataFrame, test: DataFrame, features: Sequence[str], drop: dict[str, Sequence[str]], label: str = "label") -> DataFrame:
    """AUC on ``test`` with all features (``none``) and without each named set, all fitted together.

    A feature that a model does without is zero in all its rows, in training and in scoring.
    """
    sets = {"none": (), **drop}

    def under_all(df: DataFrame) -> DataFrame:
        named = df.select(label, *features).withColumn("dropped", F.explode(F.array(*[F.lit(s) for s in sets])))
        gone = {f: [s for s, fs in sets.items() if f in fs] for f in features}
        return named.withColumns({f: F.when(F.col("dropped").isin(names), F.lit(0.0)).otherwise(F.col(f).cast("double"))
                                  for f, names in gone.items() if names})
    models = fit_logistic(under_all(train), ["dropped"], features, label)
    scored = score_logistic(under_all(test), models, ["dropped"], features)
    return roc_auc(scored.select("dropped", F.col(label).alias("label"), "score"), ["dropped"]).select("dropped", F.col("auc").alias("value"))


def verdict(accuracy: Column) -> Column:
    return F.when(accuracy < 0.65, "weak").when(accuracy > 0.85, "strong").otherwise("fair")


def group_logistic(rows: DataFrame, group: str, features: Sequence[str], label: str = "label", split: str = "split") -> DataFrame:
    """(group, accuracy, f1, n_test, verdict): a model per group, fitted on its ``train`` rows and judged on its ``test`` rows.

    F1 is 0 if neither the test rows nor the predictions have a positive; groups without test rows are left out.
    """
    models = fit_logistic(rows.filter(F.col(split) == "train"), [group], features, label)
    scored = score_logistic(_clean(rows.filter(F.col(split) == "test"), features, label), models, [group], features)
    hit, called, positive = F.col("prediction") == F.col(label), F.col("prediction") == 1, F.col(label) == 1
    f1 = ratio(2 * F.count_if(called & positive), F.count_if(called) + F.count_if(positive))
    stats = scored.groupBy(group).agg(F.avg(hit.cast("double")).alias("accuracy"), F.coalesce(f1, F.lit(0.0)).alias("f1"), F.count(F.lit(1)).alias("n_test"))
    return stats.withColumn("verdict", verdict(F.col("accuracy")))
