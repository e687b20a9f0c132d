"""Structured Streaming forms of the append-only jobs.

Each batch writes under its own batch id, so a batch that is run again replaces its own
output.  State is bounded by a small key set or by a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.patterns import seed_edges
from ..operators.rules import rule_table
from ..operators.vocab import UNK, update_vocab
from ..scale import materialize, ranked


def stream_funnel(stream: DataFrame) -> DataFrame:
    """Running counts per step (update mode); the keys are the fixed steps of a log."""
    return stream.groupBy("step").agg(F.count(F.lit(1)).alias("n"))


def stream_hourly_activity(stream: DataFrame, watermark: str = "2 hours", time: str = "ts", value: str = "value",
                           high: float = 95.0) -> DataFrame:
    """Events, peak value and values at or above ``high`` per tumbling hour."""
    return (stream.withWatermark(time, watermark).groupBy(F.window(time, "1 hour").alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("peak"), F.count_if(F.col(value) >= high).alias("n_high"))
            .select(F.col("w.start").alias("hour"), "n", "peak", "n_high"))


def stream_exact_dedup(stream: DataFrame, key: str, watermark: str | None = None, time: str = "ts") -> DataFrame:
    """First row per content key; with a watermark the state forgets keys older than it."""
    if watermark is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])


def run_batches(stream: DataFrame, folder: str, mode: str) -> None:
    """Drain what is there into ``folder/data`` with one partition per batch."""
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/data/batch={batch}")
    query = (stream.writeStream.outputMode(mode).foreachBatch(write)
             .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()


def latest(spark: SparkSession, folder: str, schema: str, keys: list[str]) -> DataFrame:
    """Current value per key of update-mode output: the row of its last batch."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/data")
    cols = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("v")).select(*keys, "v.*")


def appended(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/data").drop("batch")


def stream_update_vocab(stream: DataFrame, folder: str) -> None:
    """Grow a vocabulary: batch n writes its new ``(token, id)`` rows only, to ``folder/vocab/v=<n+1>``.

    Ids never change and the writer is single, as batches run one after another; running a
    batch again starts from the version before it and gives the same ids.
    """
    spark = stream.sparkSession

    def grow(df: DataFrame, batch: int) -> None:
        old = vocab_version(spark, folder, batch)
        new = update_vocab(old, df).join(old.select("token"), "token", "left_anti")
        new.write.mode("overwrite").parquet(f"{folder}/vocab/v={batch + 1}")
    query = (stream.writeStream.foreachBatch(grow).option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()


def vocab_version(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(token, id) after ``version`` batches; after all of them by default."""
    base = spark.createDataFrame([(UNK, 0)], "token string, id long")
    if version == 0:
        return base
    rows = spark.read.schema("token string, id long, v long").parquet(f"{folder}/vocab")
    if version is not None:
        rows = rows.filter(F.col("v") <= version)
    return base.unionByName(rows.select("token", "id"))


CHAIN_OUT = "sample string, unit string, src string, dst string, technique_id string, confidence string"
CLOSED = "sample string, unit string, node_id string, api string, at long"
BLOCK = "unit string, rows binary"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Buffer(StatefulProcessor):
    """Keeps the rows of the units of one slot and end until the watermark passes that end, then gives them out and forgets them.

    Rows are kept as blocks, Arrow bytes named by their first unit: a state entry per row costs far more than the row.
    """

    most = 4_096  # rows of a block
    chunk = 10_000  # rows given out together, at least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.schema = pa.schema([(c, pa.int64() if kind == "long" else pa.string()) for c, kind in (x.split() for x in CLOSED.split(", "))])
        self.rows = handle.getListState("rows", BLOCK)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.handle.registerTimer(int(key[1]))  # naming the same time again changes nothing
        for chunk in rows:
            got = pa.RecordBatch.from_pandas(chunk[self.schema.names], self.schema, preserve_index=False)
            parts = [got.slice(i, self.most) for i in range(0, got.num_rows, self.most)]
            self.rows.appendList([(p.column("unit")[0].as_py(), p.serialize().to_pybytes()) for p in parts])
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for _, block in self.rows.get():
            held.append(pa.ipc.read_record_batch(pa.py_buffer(bytes(block)), self.schema))
            n += held[-1].num_rows
            if n >= self.chunk:
                yield pa.Table.from_batches(held).to_pandas()
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).to_pandas()
        self.rows.clear()

    def close(self) -> None:
        pass


def closed_units(stream: DataFrame, watermark: str = "1 day", slots: int = 64) -> DataFrame:
    """The rows (sample, unit, node_id, api, ts) of each unit, all at once, when it closes.

    A unit closes when the watermark, which trails the latest ``ts`` seen by ``watermark``, has passed its ``unit_end``.
    Till then its rows are kept as keyed state, and a timer gives them out and drops them, so the state holds open units
    only. Units of one end are dealt to ``slots`` keys, as a key and a timer per unit cost more than its rows; a
    key's rows are kept in blocks and come out in chunks. Times go through the state as numbers, whatever the session's time zone.
    Rows may come in any order; those older than the watermark, or without an end, are left out.
    """
    rows = stream.select(F.coalesce(F.col("sample").cast("string"), F.lit("")).alias("sample"), F.coalesce(F.col("unit").cast("string"), F.lit("")).alias("unit"),
                         F.col("node_id").cast("string").alias("node_id"), "api", "ts", F.unix_micros("ts").alias("at"),
                         (F.unix_millis("unit_end") + 1).alias("closes"))  # a timer fires once the watermark is past the end, not at it
    rows = rows.filter(F.col("closes").isNotNull()).withColumn("slot", F.pmod(F.xxhash64("sample", "unit"), F.lit(slots)))
    out = (rows.withWatermark("ts", watermark).groupBy("slot", "closes")
           .transformWithStateInPandas(_Buffer(), outputStructType=CLOSED, outputMode="Append", timeMode="EventTime"))
    return out.select("sample", "unit", "node_id", "api", F.timestamp_micros("at").alias("ts"))


def stream_ordered_chain(stream: DataFrame, rules: Sequence, folder: str, window: int = 8, watermark: str = "1 day") -> None:
    """Edges of all rules, chains, sets and families, per unit, once ``closed_units`` gives the unit out.

    ``stream`` is ``(sample, unit, node_id, api, ts, unit_end)``. Units come whole, so they are put in (ts, node_id)
    order and matched by the batch operator, ``seed_edges``, and the result does not depend on how rows fall into batches as long as none is
    later than the watermark. Output goes to ``folder/data``, one partition per batch; a batch that closes no unit matches nothing.
    """
    spark = stream.sparkSession

    def step(df: DataFrame, batch: int) -> None:
        rows = materialize(df)
        if rows.isEmpty():
            found = spark.createDataFrame([], CHAIN_OUT)
        else:
            calls = ranked(rows, ["sample", "unit"], [F.col("ts"), F.col("node_id")], "position", 0)
            found = seed_edges(calls, rule_table(spark, list(rules)), window)
        (found.select("sample", "unit", "src", "dst", "technique_id", "confidence").write.mode("overwrite")
         .parquet(f"{folder}/data/batch={batch}"))

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)  # keyed state of this kind needs it; a query keeps what it was started with
    try:
        query = (closed_units(stream, watermark).writeStream.outputMode("append").foreachBatch(step)
                 .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    finally:
        spark.conf.set(key, before)
    query.awaitTermination()
