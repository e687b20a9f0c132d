"""Models fitted together equal single fits, and closed forms where there are any."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import grouped as G, probes as B


def rows(seed, groups=4, n=300):
    rnd = random.Random(seed)
    out = []
    for i in range(n * groups):
        g, a, b = i % groups, rnd.gauss(50, 20), rnd.random()
        out.append((i, f"g{g}", a, b, int(rnd.random() < 1 / (1 + math.exp(-(0.05 * (a - 50) * (g - 1.5) + b - 0.5)))), rnd.randrange(5)))
    return out


SCHEMA = "id long, g string, a double, b double, label int, fold int"


def test_equals_single_fits(spark):
    df = spark.createDataFrame(rows(1), SCHEMA)
    models = G.fit_logistic(df, ["g"], ["a", "b"])
    assert all(r["converged"] and r["rows"] == 300 for r in models.collect())
    mine = {r["id"]: r["score"] for r in G.score_logistic(df, models, ["g"], ["a", "b"]).collect()}
    for g in ("g0", "g3"):
        one = df.filter(F.col("g") == g)
        for r in B.logreg_probe(one, one, ["a", "b"]).collect():
            assert abs(mine[r["id"]] - r["score"]) < 1e-3


def test_folds_and_feature_sets_equal_single_fits(spark):
    df = spark.createDataFrame(rows(2, 1), SCHEMA)
    mine = {r["id"]: r["score"] for r in G.oof_logistic(df, ["a", "b"]).collect()}
    alone = B.oof_scores(df, range(5), lambda train, test: B.logreg_probe(train, test, ["a", "b"])).collect()
    assert len(mine) == 300 and all(abs(mine[r["id"]] - r["score"]) < 1e-3 for r in alone)
    cv = G.cv_logistic(df, ["a", "b"]).collect()
    assert len(cv) == 5 and abs(cv[0]["mean"] - sum(r["value"] for r in cv) / 5) < 1e-12
    got = {r["dropped"]: r["value"] for r in G.ablation_logistic(df, df, ["a", "b"], {"without_a": ["a"], "nothing": ["a", "b"]}).collect()}
    for name, cols in (("none", ["a", "b"]), ("without_a", ["b"])):
        alone = B.roc_auc(B.logreg_probe(df, df, cols), []).first()["auc"]
        assert abs(got[name] - alone) < 2e-3
    assert got["nothing"] == 0.5


def test_hard_groups(spark):
    data = [(i, "separable", float(i), 1.0, int(i >= 20), 0) for i in range(40)]
    data += [(100 + i, "one class", float(i), 0.0, 1, 0) for i in range(10)]
    data += [(200 + i, "constant", 5.0, 5.0, int(i < 3), 0) for i in range(12)]
    data += [(300 + i, "collinear", float(i % 7), 2.0 * (i % 7) + 1, int(i % 3 == 0), 0) for i in range(50)]
    data += [(400, "no label", 1.0, 1.0, None, 0), (401, "null feature", None, 1.0, 1, 0), (402, "one class", float("nan"), 0.0, 0, 0), (403, None, 1.0, 2.0, 1, 0)]
    df = spark.createDataFrame(data, SCHEMA)
    models = G.fit_logistic(df, ["g"], ["a", "b"])
    by = {r["g"]: r for r in models.collect()}
    assert {"separable", "one class", "constant", "collinear"} <= set(by) and not {"no label", "null feature"} & set(by)
    assert all(r["converged"] for r in by.values()) and by["one class"]["rows"] == 10
    got = {r["id"]: r for r in G.score_logistic(df, models, ["g"], ["a", "b"]).collect()}
    assert all(got[i]["prediction"] == int(i >= 20) for i in range(40))
    assert got[100]["score"] > 0.999 and abs(got[200]["score"] - 0.25) < 1e-5
    assert got[400]["score"] is None and got[400]["prediction"] is None


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert G.fit_logistic(df, ["g"], ["a"]).count() == 0
    assert G.group_logistic(df.withColumn("split", F.lit("train")), "g", ["a"]).count() == 0


@pytest.mark.parametrize("groups", [60])
def test_many_groups_in_distributed_form(tight, groups):
    rnd = random.Random(9)
    data = [(i, f"g{i % groups}", float(rnd.random()), 0.0, rnd.randrange(2), 0) for i in range(groups * 12)]
    df = tight.createDataFrame(data, SCHEMA)
    models = G.fit_logistic(df, ["g"], ["a"])
    assert models.count() == groups and models.filter("converged").count() == groups
