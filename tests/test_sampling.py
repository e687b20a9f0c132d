import random

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tallyforge.operators import audits as Q, sampling as S


def greedy(sizes, k):
    loads, out = [0] * k, []
    for s in sizes:
        f = loads.index(min(loads))
        out.append(f)
        loads[f] += s
    return out


@settings(max_examples=200, suppress_health_check=list(HealthCheck), deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=40), st.integers(1, 6))
def test_runs_equal_one_by_one(sizes, k):
    import pandas as pd
    sizes = sorted(sizes, reverse=True)
    runs = pd.DataFrame(sorted({s: sizes.count(s) for s in sizes}.items()), columns=["size", "count"])
    plan = {int(r["size"]): r["stretches"] for _, r in S._greedy_runs(k)(runs).iterrows()}
    got, seen = [], {}
    for s in sizes:
        t = seen.get(s, 0)
        seen[s] = t + 1
        now = [x for x in plan[s] if x["begin"] <= t][-1]
        got.append(now["turn"][(t - now["begin"]) % len(now["turn"])])
    assert got == greedy(sizes, k)


def frame(spark, n=300):
    rnd = random.Random(5)
    return spark.createDataFrame([(i, rnd.choice("abcdefgh"), int(rnd.random() < 0.3), rnd.choice(["big"] * 3 + ["s1", "s2"]))
                                  for i in range(n)], "id long, grp string, label int, source string")


def test_splits_never_cut_a_group(spark):
    df = frame(spark)
    for out, col in ((S.group_kfold(df, "grp", 3), "fold"), (S.group_kfold(df, "grp", 3, "snake"), "fold"),
                     (S.group_shuffle_split(df, "grp", 0.8, "1"), "split"),
                     (S.carve_validation(df, "grp", "label"), "split")):
        assert out.count() == 300
        assert out.groupBy("grp").agg(F.count_distinct(col).alias("n")).filter("n > 1").count() == 0
    leak = Q.group_leakage(S.group_shuffle_split(df, "grp", 0.8, "1"), "split", "grp").first()
    assert leak["leaked_groups"] == 0


def test_order_of_input_does_not_matter(spark):
    df = frame(spark)
    other = df.repartition(5, "label").orderBy(F.col("id").desc())
    for fn in (lambda d: S.balance_classes(d, "label", "s"), lambda d: S.random_subset(d, 40, "s"),
               lambda d: S.source_cap(d, "source", "big", 20, "s"),
               lambda d: S.vendor_fraction_cap(d, "source", "big", 0.35)):
        assert sorted(map(tuple, fn(df).collect())) == sorted(map(tuple, fn(other).collect()))


def test_caps_hold(spark):
    df = frame(spark)
    assert S.vendor_fraction_cap(df, "source", "big", 0.35).filter("source = 'big'").count() == 105
    out = S.bin_fraction_cap(df, F.col("source") == "s1", 0.1, "holdout", "s")
    train = out.filter("split = 'train'")
    assert train.filter("source = 's1'").count() <= 0.1 * train.count()
    assert out.count() == 300


def test_negative_pairs(spark):
    sizes = spark.createDataFrame([(1, 1), (2, 2), (3, 30)], "graph long, n long")
    pos = spark.createDataFrame([(3, 0, 1), (3, 4, 99)], "graph long, i long, j long")
    got = S.negative_pair_sampling(sizes, pos, 3, "x").collect()
    assert not [r for r in got if r["graph"] == 1]
    assert len([r for r in got if r["graph"] == 3 and r["label"] == 1]) == 1
    neg = [r for r in got if r["label"] == 0]
    assert len([r for r in neg if r["graph"] == 3]) == 3 and all(r["i"] != r["j"] for r in neg)
    assert all((r["i"], r["j"]) != (0, 1) for r in neg if r["graph"] == 3)


def test_density_counts_a_units_own_calls(spark):
    nodes = spark.createDataFrame([("a", "func_70", "x")] * 3 + [("b", "func_70", None), ("b", "func_80", "x")], "sample string, unit string, api string")
    units = nodes.select("sample", "unit").distinct()
    got = {(r["sample"], r["unit"], r["n_calls"]) for r in S.density_top_k(units, nodes, 1).collect()}
    assert got == {("a", "func_70", 3), ("b", "func_80", 1)}


def test_dense_graphs_get_all_their_negatives(spark):
    sizes = spark.createDataFrame([("g", 3), ("full", 2), ("none", 5)], "graph string, n long")
    taken = [(i, j) for i in range(3) for j in range(3) if i != j][:5]
    pos = spark.createDataFrame([("g", i, j) for i, j in taken] + [("full", 0, 1), ("full", 1, 0)], "graph string, i long, j long")
    got = S.negative_pair_sampling(sizes, pos, 3, "x").filter("label = 0").groupBy("graph").count().collect()
    assert {r["graph"]: r["count"] for r in got} == {"g": 15, "none": 4}
