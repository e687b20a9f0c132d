"""Stored hash trees: roots equal the fingerprint, differences equal a plain count, and equal subtrees stay unread."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import dedup as D, versions as V

SCHEMA = "a long, b string"


def frozen(spark, tmp_path, name, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return V.freeze(df, f"{tmp_path}/{name}"), df


def changes(spark, old, new):
    return sorted(((r["change"], r["row"]["a"], r["row"]["b"], r["n_old"], r["n_new"]) for r in V.fingerprint_diff(spark, old, new).collect()), key=repr)


def plain(old, new):
    a, b = Counter(old), Counter(new)
    return sorted((("added" if not a[r] else "removed" if not b[r] else "repeated", *r, a[r], b[r]) for r in {*a, *b} if a[r] != b[r]), key=repr)


@pytest.fixture(params=[4096, 3])
def named(request, monkeypatch):
    monkeypatch.setattr(V, "NAMED", request.param)


def test_diff_and_root(spark, tmp_path, named):
    rnd = random.Random(5)
    old = [(rnd.randrange(300), rnd.choice([None, "", "x", "y|z"])) for _ in range(900)]
    new = [r for r in old if r[0] % 37] + [(i, "new") for i in range(20)] + old[:30] + [(None, None)]
    (a, da), (b, db) = frozen(spark, tmp_path, "old", old), frozen(spark, tmp_path, "new", new)
    for version, df in ((a, da), (b, db)):
        assert V.root(spark, version).collect() == D.dataset_fingerprint(df).collect()
    assert changes(spark, a, b) == plain(old, new)
    assert changes(spark, a, a) == []


def test_empty_versions(spark, tmp_path):
    (none, _), (some, _) = frozen(spark, tmp_path, "none", []), frozen(spark, tmp_path, "some", [(1, "x"), (1, "x")])
    assert V.root(spark, none).count() == 0 and changes(spark, none, none) == []
    assert changes(spark, none, some) == [("added", 1, "x", 0, 2)] and changes(spark, some, none) == [("removed", 1, "x", 2, 0)]


def test_equal_subtrees_are_not_read(spark, tmp_path):
    rows = [(i, "r") for i in range(3000)]
    (a, _), (b, _) = frozen(spark, tmp_path, "a", rows), frozen(spark, tmp_path, "b", [*rows, (-1, "one more")])
    upper = V._unequal(a.table(spark, "upper"), b.table(spark, "upper"), ["digest"])
    lower = V._unequal(*[V._below(v.table(spark, "lower"), upper, V.UPPER) for v in (a, b)], ["digest"])
    leaves = V._below(b.table(spark, "leaves"), lower, V.LOWER)
    (row,) = leaves.collect()
    plan = leaves._jdf.queryExecution().executedPlan().toString()
    assert row["row"]["a"] == -1 and f"(folder#" in plan.split("PartitionFilters:")[1] and "GreaterThanOrEqual(h," in plan.split("PushedFilters:")[1]
    assert leaves.select(F.input_file_name()).distinct().count() == 1
    equal = V._unequal(a.table(spark, "upper"), a.table(spark, "upper"), ["digest"])
    assert V._below(a.table(spark, "leaves"), equal, V.UPPER).count() == 0


def test_ranges():
    assert V._ranges(["00a1", "00a2", "00a3", "00b0"]) == [("00a1", "00a3g"), ("00b0", "00b0g")]
    names = [f"{i:08x}" for i in range(0, 4000, 10)]
    spans = V._ranges(names)
    assert len(spans) <= 64 and all(any(lo <= n + "ff" <= hi for lo, hi in spans) for n in names)


def test_nodes_stay_fewer_than_leaves(spark, tmp_path):
    """A level with a node per leaf would double the disk; hashes are bytes, and a freeze shuffles rows once."""
    a, _ = frozen(spark, tmp_path, "a", [(i, "r") for i in range(40_000)])
    lower = a.table(spark, "lower")
    assert {len(r["h"]) for r in lower.select("h").distinct().collect()} == {6}
    assert lower.agg(F.sum("n")).first()[0] == 40_000 and lower.count() < 40_000
    assert {r["k"] for r in a.table(spark, "leaves").select(F.octet_length("h").alias("k")).distinct().collect()} == {32}


def test_nodes_need_no_second_shuffle(spark, tmp_path, monkeypatch):
    plans, store = [], V.materialize

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df)
    monkeypatch.setattr(V, "materialize", kept)
    a, df = frozen(spark, tmp_path, "a", [(i, "r") for i in range(2_000)])
    assert len(plans) == 1 and "Aggregate" in plans[0] and "Exchange" not in plans[0]
    assert V.root(spark, a).collect() == D.dataset_fingerprint(df).collect() and not spark.catalog.listTables()


def test_many_copies_are_counted_before_they_meet(tight, tmp_path):
    old, new = [(1, "x")] * 400 + [(2, None)], [(1, "x")] * 401 + [(3, None)]
    (a, da), (b, _) = frozen(tight, tmp_path, "a", old), frozen(tight, tmp_path, "b", new)
    assert V.root(tight, a).collect() == D.dataset_fingerprint(da).collect()
    assert changes(tight, a, b) == plain(old, new)
