"""Streams fed in several batches give what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import patterns as P, vocab as V
from tallyforge.operators.rules import CHAIN, FAMILY, SET, Rule, rule_table
from tallyforge.scale import ranked
from tallyforge.streaming import jobs as J


def feed(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_vocab_grows_without_renumbering(spark, tmp_path):
    rnd = random.Random(4)
    pool = [f"t{i:03d}" for i in range(120)]
    for i in range(4):
        spark.createDataFrame([(rnd.choice(pool),) for _ in range(25)], "token string").coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "in"))
    J.stream_update_vocab(feed(spark, str(tmp_path / "in"), "token string"), str(tmp_path / "out"))
    versions = [dict(map(tuple, J.vocab_version(spark, str(tmp_path / "out"), v).collect())) for v in range(5)]
    for old, new in zip(versions, versions[1:]):
        assert all(new[t] == i for t, i in old.items())
    assert V.vocab_valid(J.vocab_version(spark, str(tmp_path / "out"), 4)).first() == (True, True, True)
    seen = {r[0] for r in spark.read.parquet(str(tmp_path / "in")).collect()}
    assert set(versions[-1]) == seen | {"<UNK>"}


@pytest.mark.parametrize("batches", [1, 4])
def test_rules_equal_batch_with_disorder(spark, tmp_path, batches):
    rnd = random.Random(8)
    rows = []
    for unit in range(12):
        for i in range(30):
            rows.append((unit % 3, f"u{unit}", f"{unit:02d}-{i:03d}", rnd.choice("abcxyz"), unit * 86400 + i * 600))
    rows.append((9, "tail", "z", "a", 40 * 86400))
    rows.sort(key=lambda r: r[4] + rnd.random() * 3000)  # late by less than the watermark
    schema = "sample long, unit string, node_id string, api string, s long"
    step = len(rows) // batches + 1
    for i in range(0, len(rows), step):
        part = spark.createDataFrame(rows[i:i + step], schema).withColumn("ts", F.timestamp_seconds("s"))
        part.withColumn("unit_end", F.date_trunc("day", "ts") + F.expr("interval 1 day")).coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "in"))
    full = spark.read.parquet(str(tmp_path / "in"))
    rules = [Rule("R", "r", CHAIN, apis=("a", "b", "c")), Rule("Q", "q", CHAIN, apis=("x", "y")), Rule("S", "s", SET, apis=("y", "z")), Rule("F", "f", FAMILY, prefixes=("c",))]
    J.stream_ordered_chain(feed(spark, str(tmp_path / "in"), full.schema), rules, str(tmp_path / "out"), 8, "1 hour")
    got = sorted(map(tuple, J.appended(spark, str(tmp_path / "out"), J.CHAIN_OUT).collect()))
    calls = ranked(full.filter("unit <> 'tail'"), ["sample", "unit"], [F.col("ts"), F.col("node_id")], "position", 0)
    want = sorted((str(r["sample"]), r["unit"], r["src"], r["dst"], r["technique_id"], r["confidence"])
                  for r in P.seed_edges(calls, rule_table(spark, rules), 8).collect())
    assert {r[4] for r in want} == {"R", "Q", "S", "F"} and got == want
    # the state has forgotten every closed unit; the last one is still open
    left = spark.read.format("statestore").option("path", f"{tmp_path}/out/checkpoint").option("stateVarName", "rows").load()
    assert [r["unit"] for r in left.select("list_element.unit").collect()] == ["tail"]


def test_restarted_stream_goes_on(spark, tmp_path):
    schema = "sample long, unit string, node_id string, api string, ts timestamp, unit_end timestamp"
    rules = [Rule("R", "r", CHAIN, apis=("a", "b"))]
    for part in ([("u", "n1", "a", 10)], [("u", "n2", "b", 20)], [("v", "n3", "a", 90_000), ("w", "n4", "a", 300_000)]):
        df = spark.createDataFrame(part, "unit string, node_id string, api string, s long").withColumn("ts", F.timestamp_seconds("s"))
        df.select(F.lit(1).cast("long").alias("sample"), "unit", "node_id", "api", "ts", (F.date_trunc("day", "ts") + F.expr("interval 1 day")).alias("unit_end")) \
            .coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        J.stream_ordered_chain(feed(spark, str(tmp_path / "in"), schema), rules, str(tmp_path / "out"), 8, "1 hour")
    assert [(r["unit"], r["src"], r["dst"]) for r in J.appended(spark, str(tmp_path / "out"), J.CHAIN_OUT).collect()] == [("u", "n1", "n2")]


def test_state_keeps_rows_in_blocks(spark, tmp_path):
    rows = [("u", f"n{i:05d}", "ab"[i % 2] if i else None, i, 86_400) for i in range(9_000)] + [("end", "z", "a", 400_000, 500_000)]
    times = {"ts": F.timestamp_seconds("s"), "unit_end": F.timestamp_seconds("e")}
    full = spark.createDataFrame(rows, "unit string, node_id string, api string, s long, e long").withColumns(times).withColumn("sample", F.lit(1).cast("long"))
    for part in (full.filter("unit = 'u'"), full.filter("unit = 'end'")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        J.stream_ordered_chain(feed(spark, str(tmp_path / "in"), full.schema), [Rule("S", "s", SET, apis=("a", "b"))], str(tmp_path / "out"), 8, "1 hour")
        # a batch of a unit takes an entry per 4,096 rows, not one per row
        state = spark.read.format("statestore").option("path", f"{tmp_path}/out/checkpoint").option("stateVarName", "rows").load()
        assert [r["unit"] for r in state.select("list_element.unit").collect()] == (["u"] * 3 if part.first()["unit"] == "u" else ["end"])
    got = sorted((r["src"], r["dst"]) for r in J.appended(spark, str(tmp_path / "out"), J.CHAIN_OUT).collect())
    assert got == [(f"n{i:05d}", f"n{i + 1:05d}") for i in range(1, 8_999)]


def test_units_stay_open_till_their_end_in_any_time_zone(spark, tmp_path):
    schema = "sample long, unit string, node_id string, api string, ts timestamp, unit_end timestamp"
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for unit, node, api, s in (("u", "n1", "a", 80_000), ("v", "n3", "x", 90_000), ("v", "n5", "x", 91_000), ("u", "n2", "b", 95_000), ("w", "n4", "a", 300_000)):
            df = spark.createDataFrame([(1, unit, node, api, s)], "sample long, unit string, node_id string, api string, s long")
            df.select("sample", "unit", "node_id", "api", F.timestamp_seconds("s").alias("ts"), F.timestamp_seconds(F.lit(100_000 if s < 100_000 else 400_000)).alias("unit_end")) \
                .coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        J.stream_ordered_chain(feed(spark, str(tmp_path / "in"), schema), [Rule("R", "r", CHAIN, apis=("a", "b"))], str(tmp_path / "out"), 8, "1 hour")
        assert [(r["unit"], r["src"], r["dst"]) for r in J.appended(spark, str(tmp_path / "out"), J.CHAIN_OUT).collect()] == [("u", "n1", "n2")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_funnel_and_dedup_over_batches(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([("kept", f"k{j}") for j in range(i, i + 3)], "step string, key string").coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "in"))
    src = feed(spark, str(tmp_path / "in"), "step string, key string")
    J.run_batches(J.stream_funnel(src), str(tmp_path / "f"), "update")
    assert J.latest(spark, str(tmp_path / "f"), "step string, n long", ["step"]).collect() == [("kept", 9)]
    J.run_batches(J.stream_exact_dedup(src, "key").select("key"), str(tmp_path / "d"), "append")
    assert sorted(r[0] for r in J.appended(spark, str(tmp_path / "d"), "key string").collect()) == ["k0", "k1", "k2", "k3", "k4"]
