import math
import random
import struct

import numpy as np
from pyspark.sql import functions as F

from tallyforge import scale
from tallyforge.functions.bits import key_value, order_key
from tallyforge.scale import Carry, exact_quantiles, keyed_join, prefix_scan, ranked


def table(spark, n=200, groups=3):
    rnd = random.Random(1)
    rows = [(rnd.choice([0] * 5 + list(range(groups))), i, rnd.choice([None, 1.0, 2.5, 7.0])) for i in range(n)]
    return spark.createDataFrame(rows, "g long, i long, x double").repartition(7)


def scan(df):
    out = prefix_scan(df, ["g"], [F.col("i").asc()], n=Carry("count"), s=Carry("sum", F.coalesce("x", F.lit(0.0))),
                      m=Carry("max", F.col("x")), last=Carry("last", F.col("x")), prev=Carry("prev", F.col("x")))
    return sorted(tuple(r) for r in out.collect())


def test_sliced_scan_equals_window(tight):
    sliced = scan(table(tight))
    for k in ("tallyforge.smallBytes", "tallyforge.hotRows"):
        tight.conf.set(k, str(1 << 40))
    assert sliced == scan(table(tight))


def test_descending_global_rank(tight):
    got = {r["i"]: r["rank"] for r in ranked(table(tight), [], [F.col("i").desc()]).collect()}
    assert got == {i: 200 - i for i in range(200)}


def test_keyed_join_hot_keys(tight):
    left = table(tight)
    right = tight.createDataFrame([(0, "a"), (2, "c")], "g long, name string")
    for how in ("inner", "left"):
        got = sorted(map(str, keyed_join(left, right, ["g"], how).select("g", "i", "name").collect()))
        want = sorted(map(str, left.join(right, "g", how).select("g", "i", "name").collect()))
        assert got == want


def test_quantiles_match_numpy(tight):
    rnd = np.random.default_rng(3)
    values = [(int(g), float(v)) for g, v in zip(rnd.integers(0, 2, 300), rnd.integers(0, 40, 300) / 7)]
    df = tight.createDataFrame(values, "g long, v double")
    for r in exact_quantiles(df, ["g"], "v", {"lo": 0.05, "mid": 0.5, "hi": 0.975}).collect():
        mine = [v for g, v in values if g == r["g"]]
        assert np.allclose([r["lo"], r["mid"], r["hi"]], np.quantile(mine, [0.05, 0.5, 0.975]))


def edge_doubles():
    rnd = random.Random(4)
    anything = [struct.unpack("d", rnd.randbytes(8))[0] for _ in range(3000)]
    powers = [s * 2.0 ** e for e in range(-1074, 1024) for s in (1, -1)]
    beside = [math.nextafter(x, t) for x in powers for t in (-math.inf, math.inf)]
    return [*(x for x in anything if not math.isnan(x)), *powers, *beside, 0.0, -0.0, math.inf, -math.inf]


def test_order_key_is_the_bits_of_a_double(spark):
    values = edge_doubles()
    df = spark.createDataFrame([(x,) for x in [*values, None, math.nan]], "x double").withColumn("k", order_key(F.col("x")))
    for r in df.withColumn("back", key_value(F.col("k"))).collect():
        if r["x"] is None:
            assert r["k"] is None and r["back"] is None
        elif math.isnan(r["x"]):
            assert r["k"] > 2047 << 52 and math.isnan(r["back"])
        else:
            bits = struct.unpack("q", struct.pack("d", abs(r["x"])))[0]
            assert r["k"] == (-bits if r["x"] < 0 else bits) and r["back"] == r["x"]


def test_quantiles_of_any_doubles(tight):
    rnd = random.Random(6)
    values = [x for x in edge_doubles() if abs(x) < 1e300]
    rows = [(rnd.choice("aab"), rnd.choice(values)) for _ in range(4000)] + [("c", 5.0), ("d", None), (None, 1.0)]
    rows += [("hot", 0.25)] * 500 + [("hot", 0.5)] * 499
    wanted = {"min": 0.0, "low": 0.01, "mid": 0.5, "high": 0.999, "max": 1.0}
    df = tight.createDataFrame(rows, "g string, v double").withColumn("_key", F.lit("clash")).repartition(6)
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", wanted).collect()}
    assert set(got) == {"a", "b", "c", "hot"}
    for g, r in got.items():
        mine = sorted(v for k, v in rows if k == g)
        for name, q in wanted.items():
            at = (len(mine) - 1) * q
            low, high = mine[math.floor(at)], mine[math.ceil(at)]
            assert r[name] == (low if at == int(at) else low + (high - low) * (at - int(at)))
    tight.conf.set("tallyforge.smallBytes", str(1 << 40))
    for r in exact_quantiles(df, ["g"], "v", wanted).collect():  # Spark's own, for small inputs
        assert all(math.isclose(r[n], got[r["g"]][n], rel_tol=1e-12) for n in wanted)
    tight.conf.set("tallyforge.smallBytes", "0")
    whole = exact_quantiles(df, [], "v", {"mid": 0.5}).collect()
    mine = sorted(v for _, v in rows if v is not None)
    assert len(whole) == 1 and whole[0]["mid"] == (mine[(len(mine) - 1) // 2] + mine[len(mine) // 2]) / 2
    assert exact_quantiles(df.limit(0), [], "v", {"mid": 0.5}).collect() == [(None,)]
    assert exact_quantiles(df.limit(0), ["g"], "v", {"mid": 0.5}).collect() == []


def test_quantiles_sort_no_rows(tight, monkeypatch):
    plans, write = [], scale.materialize

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(scale, "materialize", noted)
    df = tight.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") / 7).alias("v"))
    exact_quantiles(df, ["g"], "v", {"mid": 0.5})
    assert len(plans) == 8  # the keys, a state per round, the hot keys of the last three
    assert not any("Window" in p or "rangepartitioning" in p for p in plans)


def test_counts_of_documents_shuffle_texts_only(spark, tmp_path):
    """Texts are dealt out by document once, at any size; their tokens are counted and weighed where they are."""
    from tallyforge.operators import vocab as V
    from tallyforge.plans import adapters as A

    spark.createDataFrame([(i, f"a b{i} c{i} a\nd") for i in range(40)] + [(3, "a z")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("tallyforge.smallBytes", "0")
    try:
        counts = V.token_counts(A.document_nodes(spark, str(tmp_path))).withColumnRenamed("token", "term")
        weights = V.tfidf(counts, spark.createDataFrame([(i,) for i in range(9)], "sample long"), 1)
        for df in (counts, weights):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1
        got = {(r["sample"], r["term"]): r["n"] for r in counts.collect()}
        assert got[(3, "a")] == 3 and got[(5, "a")] == 2 and len(got) == 40 * 4 + 1
    finally:
        spark.conf.unset("tallyforge.smallBytes")
