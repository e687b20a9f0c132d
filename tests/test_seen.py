"""Keys stored in buckets behind filters: batches give what one DISTINCT gives."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge.streaming import seen as S


def digests(keys):
    import hashlib
    return pd.Series([hashlib.sha256(str(k).encode()).digest() for k in keys])


def test_filter_knows_its_keys_and_few_others():
    bits = bytearray(2000 * S.BITS_PER_KEY // 8)
    for at in S.places(digests(range(2000)), len(bits) * 8).ravel():
        bits[int(at) >> 3] |= 1 << (int(at) & 7)
    bits = S.np.frombuffer(bytes(bits), S.np.uint8)
    assert S.contains(bits, digests(range(2000))).all()
    assert S.contains(bits, digests(range(2000, 12000))).mean() < 0.005


def batches(spark, tmp_path, count=4):
    rnd = random.Random(9)
    schema = "k string, _digest long, v double"
    for i in range(count):
        rows = [(rnd.choice([None, "hot", "hot", f"k{rnd.randrange(60 * (i + 1))}"]), rnd.randrange(3), None) for _ in range(120)]
        spark.createDataFrame(rows if i != 2 else [], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema("k string, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_batches_equal_distinct_and_run_again(spark, tmp_path):
    stream = batches(spark, tmp_path)
    table = S.SeenTable(str(tmp_path / "out"), buckets=3, first_capacity=16)
    S.stream_first_rows(stream, "k", str(tmp_path / "out"), table)
    want = sorted(str(r[0]) for r in spark.read.parquet(str(tmp_path / "in")).select("k").distinct().collect())
    got = lambda: sorted(str(r["k"]) for r in spark.read.schema("k string, v double").parquet(str(tmp_path / "out" / "data")).collect())
    assert got() == want
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "data").glob("batch=*"))
    assert last >= 2
    rows = spark.read.schema("k string, v double").parquet(str(tmp_path / "out" / "data" / f"batch={last}"))
    again = spark.createDataFrame(rows.collect() + [("hot", 1.0)], "k string, v double")
    table.add(again, "k", last, str(tmp_path / "out" / "data"))  # a batch that is run again
    assert got() == want
    sizes = table.filters(spark, last + 1).groupBy("bucket").agg(F.sum("used").alias("n"), F.count("part").alias("parts")).collect()
    assert all(r["parts"] > 1 for r in sizes)  # filters were added as buckets grew


@pytest.mark.parametrize("known", [[], ["a", None, "a"], ["a", "b", "zz"]])
def test_unseen_keeps_repeats(spark, tmp_path, known):
    table = S.SeenTable(str(tmp_path / "t"), buckets=2, first_capacity=1)
    table.add(spark.createDataFrame([(k,) for k in known], "k string"), "k", 0)
    rows = [("a", 1), ("b", 2), ("b", 2), (None, 3), ("", 4)]
    got = table.unseen(spark.createDataFrame(rows, "k string, digest int"), "k", 1)
    assert got.columns == ["k", "digest"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(r) for r in rows if r[0] not in known)
