"""The cap per bin and vendor against an exhaustive search for the largest part that obeys."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import sampling as S


def best_limit(counts, frac):
    return max((k for k in range(max(counts) + 1) if k <= frac * sum(min(c, k) for c in counts) + 1e-9), default=0)


def table(spark, seed, n=700):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        b = rnd.choice([None, "x", "y", "few"])
        v = rnd.choice(["a"] * 12 + ["b"] * 5 + ["c", "d", "e", None]) if b != "few" else rnd.choice("ab")
        rows.append((i, b, v))
    rows += [(n + i, "even", v) for i, v in enumerate("abcdef" * 4)]
    return rows, spark.createDataFrame(rows, "id long, bin string, vendor string").withColumn("_cap", F.lit(1))


@pytest.mark.parametrize("frac", [0.35, 0.2, 0.5])
@pytest.mark.parametrize("seed", [1, 2])
def test_largest_part_that_obeys(spark, frac, seed):
    rows, df = table(spark, seed)
    df = df.drop("_cap")
    got = [tuple(r) for r in S.vendor_cap_per_bin(df, "bin", "vendor", frac, "7").collect()]
    assert len(set(got)) == len(got) and set(got) <= set(rows)
    per, kept = Counter((b, v) for _, b, v in rows), Counter((b, v) for _, b, v in got)
    for b in {b for _, b, _ in rows}:
        counts = [c for (x, _), c in per.items() if x == b]
        limit = best_limit(counts, frac)
        assert {v: kept[b, v] for (x, v) in per if x == b} == {v: min(c, limit) for (x, v), c in per.items() if x == b}
        total = sum(n for (x, _), n in kept.items() if x == b)
        assert all(n <= frac * total + 1e-9 for (x, _), n in kept.items() if x == b)


def test_bins_that_cannot_obey(spark):
    rows, df = table(spark, 3)
    few = [r for r in rows if r[1] == "few"]
    kept = S.vendor_cap_per_bin(df.drop("_cap"), "bin", "vendor", 0.35, "7", short="keep").filter("bin = 'few'").count()
    assert kept == len(few) and S.vendor_cap_per_bin(df.drop("_cap"), "bin", "vendor", 0.35, "7").filter("bin = 'few'").count() == 0
    assert S.vendor_cap_per_bin(df.drop("_cap").limit(0), "bin", "vendor", 0.35, "7").count() == 0


def test_distributed_form(tight):
    rows, df = table(tight, 4)
    limits = {r["_bin"]: r["_limit"] for r in S.vendor_limits(df, "bin", "vendor", 0.35).collect()}
    per = Counter((b, v) for _, b, v in rows)
    limits = {b: min(k, max(c for (x, _), c in per.items() if b == ("=" + x if x else ""))) for b, k in limits.items()}
    assert limits == {("=" + b if b else ""): best_limit([c for (x, _), c in per.items() if x == b], 0.35) for b in {b for _, b, _ in rows}}
