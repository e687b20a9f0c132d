import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import metrics as M


def brute_auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return np.mean([[1.0 if p > n else 0.5 if p == n else 0.0 for n in neg] for p in pos])


@pytest.fixture
def scores(spark):
    rnd = np.random.default_rng(2)
    rows = [("m", i, int(rnd.random() < 0.4), float(rnd.integers(0, 12)) / 12, f"c{i % 9}", "x" if i % 3 else "y") for i in range(120)]
    rows += [("m", 900, 1, float("nan"), "c1", "x"), ("m", 901, 0, None, "c1", "x")]
    rows += [("one", i, 1, 0.5, "c0", "x") for i in range(3)]
    return spark.createDataFrame(rows, "model string, id long, label int, score double, cluster string, bin string"), rows[:120]


def test_auc_ties_missing_and_single_class(scores):
    df, rows = scores
    got = {r["model"]: r["auc"] for r in M.roc_auc(df).collect()}
    assert got["one"] is None
    assert got["m"] == pytest.approx(brute_auc([r[2] for r in rows], [r[3] for r in rows]))


def test_operating_point(scores):
    df, rows = scores
    pos = [r[3] for r in rows if r[2]]
    neg = np.array([r[3] for r in rows if not r[2]])
    got = M.fpr_at_tpr(df.filter("model = 'm'"), 0.95).first()
    thr = np.quantile(pos, 1 - 0.95)
    assert got["thr"] == pytest.approx(thr) and got["fpr"] == pytest.approx((neg >= thr).mean())


def test_bootstrap_brackets_the_estimate(scores):
    df, rows = scores
    m = df.filter("model = 'm'")
    ci = M.cluster_bootstrap_ci(m, "auc", 60, "3").first()
    assert ci["ci_low"] <= M.roc_auc(m).first()["auc"] <= ci["ci_high"] and ci["rounds_used"] == 60


def test_wilson_edges(spark):
    df = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (3, 20)], "k long, n long")
    rows = {(r["k"], r["n"]): (r["wilson_low"], r["wilson_high"]) for r in M.wilson_ci(df, "k", "n").collect()}
    assert rows[(0, 0)] == (None, None) and rows[(0, 10)][0] == 0.0 and rows[(10, 10)][1] == 1.0
    assert rows[(3, 20)] == pytest.approx((0.052367, 0.360418), abs=1e-4)


def test_p_value(spark):
    rows = [("m", i, i % 2, float(i)) for i in range(40)]
    r = M.mann_whitney_u(spark.createDataFrame(rows, "model string, id long, label int, score double")).first()
    assert r["u"] == 210.0 and r["p_value"] == pytest.approx(0.786762, abs=1e-4)


def test_normal_tail_is_that_of_erfc(spark):
    import math
    xs = [0.0, 0.3, 1.0, 1.96, 2.9999, 3.0, 4.5, 8.0, 20.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", M._upper_tail(F.col("x")).alias("q")).collect()
    for r in rows:
        want = math.erfc(r["x"] / math.sqrt(2)) / 2
        assert abs(r["q"] - want) <= 1e-9 * want


def test_registered_bootstraps_draw_all_rounds(spark):
    from tallyforge.plans import evaluation

    assert evaluation.ROUNDS == 2000
    row = evaluation.cluster_bootstrap_ci(spark, "/root/testdata/sf0.001").first()
    assert row["rounds_used"] == 2000


def test_rounds_at_once_equal_repeated_rows(tight):
    rng = np.random.default_rng(3)
    rows = [("m", i, int(rng.integers(2)), float(rng.integers(40)) / 8, float(rng.integers(9)), f"c{rng.integers(12)}") for i in range(900)]
    df = tight.createDataFrame(rows, "model string, id long, label int, score double, other double, cluster string")
    for name, got in zip(["score", "other"], M._round_aucs(df, 50, "3", ["score", "other"])):
        want = dict(map(tuple, M._boot_auc(M.resampled(df, 50, "3", [name]), name).collect()))
        assert dict(map(tuple, got.collect())) == pytest.approx(want) and len(want) == 50
    assert M.cluster_bootstrap_ci(df.limit(0), "auc", 5).first()["rounds_used"] == 0
    one = M.cluster_bootstrap_ci(df.filter("label = 1"), "auc", 5).first()  # a class is missing in every round
    assert one["rounds_used"] == 0 and one["ci_low"] is None
