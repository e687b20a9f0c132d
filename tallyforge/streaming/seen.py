"""A table of keys that were seen, in hash buckets behind Bloom filters, that grows batch by batch.

    <folder>/seen/batch=<n>/bucket=<b>   digests of the keys that batch n brought
    <folder>/bloom/v=<n>                 filters of every bucket before batch n

A batch reads what earlier batches wrote and overwrites its own output, so it may run again. Batches are numbered
from 0 without gaps, one writer at a time. A false hit of a filter costs a look-up, never a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..scale import keyed_join, materialize

SEEN = "digest binary, batch long, bucket int"
BLOOM = "bucket int, part int, capacity long, used long, bits binary"
PROBES = 11
BITS_PER_KEY = 16  # with 11 probes about one false hit in 2,000 keys and filter


@dataclass(frozen=True)
class SeenTable:
    """``buckets`` bounds what a task holds: a batch's keys of one bucket and that bucket's filters, 2 to 4 bytes a key."""

    folder: str
    buckets: int = 64
    first_capacity: int = 4096

    def digest(self, key: Column) -> Column:
        """SHA-256 of a key; NULL is a key of its own."""
        return F.unhex(F.sha2(F.coalesce(F.concat(F.lit("v"), key.cast("string")), F.lit("n")), 256))

    def seen(self, spark, batch: int) -> DataFrame:
        """(digest, batch, bucket) of all batches before ``batch``."""
        if batch == 0:
            return spark.createDataFrame([], SEEN)
        return spark.read.schema(SEEN).parquet(f"{self.folder}/seen").filter(F.col("batch") < batch)

    def filters(self, spark, batch: int) -> DataFrame:
        """The filters of all batches before ``batch``."""
        if batch == 0:
            return spark.createDataFrame([], BLOOM)
        return spark.read.schema(BLOOM).parquet(f"{self.folder}/bloom/v={batch}")

    def unseen(self, rows: DataFrame, key: str, batch: int) -> DataFrame:
        """Rows whose key no batch before ``batch`` brought, repeated rows included.

        A key that its bucket's filters do not know is new without a look at the table. The others are looked up, in
        their buckets only.
        """
        keyed = rows.withColumn("_digest", self.digest(F.col(key)))
        new = materialize(self._new(self._keys(keyed), batch).select(F.col("digest").alias("_digest")))
        return keyed_join(keyed, new, ["_digest"]).select(*rows.columns)

    def add(self, rows: DataFrame, key: str, batch: int, out: str | None = None) -> None:
        """Record the keys of a batch; with ``out`` write one row of each new key to ``<out>/batch=<batch>``.

        Of several rows with one key in a batch that with the smallest row hash is kept.
        """
        keyed = rows.withColumn("_digest", self.digest(F.col(key)))
        keys = self._keys(keyed)
        new = materialize(self._new(keys, batch))
        if out is not None:
            once = keyed.groupBy("_digest").agg(F.min_by(F.struct(*rows.columns), F.xxhash64(*rows.columns)).alias("_row"))
            first = once.join(new.select(F.col("digest").alias("_digest")), "_digest", "left_semi").select("_row.*")
            first.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        (new.repartition("bucket").sortWithinPartitions("bucket", "digest")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/seen/batch={batch}"))
        self._grown(keys, batch).write.mode("overwrite").parquet(f"{self.folder}/bloom/v={batch + 1}")

    def _keys(self, keyed: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64("digest"), F.lit(self.buckets)).cast("int")
        return materialize(keyed.select(F.col("_digest").alias("digest")).distinct().withColumn("bucket", bucket))

    def _new(self, keys: DataFrame, batch: int) -> DataFrame:
        spark = keys.sparkSession

        def test(pdf: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            hits = np.zeros(len(pdf), bool)
            for bits in filters["bits"]:
                hits |= contains(np.frombuffer(bits, np.uint8), pdf["digest"])
            return pdf.assign(hit=hits)

        if batch == 0:
            return keys
        tested = materialize(keys.groupBy("bucket").cogroup(self.filters(spark, batch).groupBy("bucket"))
                             .applyInPandas(test, "digest binary, bucket int, hit boolean"))
        maybe = tested.filter("hit").drop("hit")
        hit_buckets = [r[0] for r in maybe.select("bucket").distinct().collect()]  # no more than there are buckets
        looked_up = self.seen(spark, batch).filter(F.col("bucket").isin(hit_buckets)).select("bucket", "digest")
        return tested.filter("NOT hit").drop("hit").unionByName(maybe.join(looked_up, ["bucket", "digest"], "left_anti"))

    def _grown(self, keys: DataFrame, batch: int) -> DataFrame:
        first = self.first_capacity

        def grow(pdf: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            """The bucket's filters with the batch's keys in the last one, or in a new one of twice its size or more."""
            kept = filters.sort_values("part").to_dict("records")
            if len(pdf):
                last = kept[-1] if kept else None
                if last is None or last["used"] + len(pdf) > last["capacity"]:
                    capacity = max(first, 2 * last["capacity"] if last else 0, len(pdf))
                    last = {"bucket": int(pdf["bucket"].iloc[0]), "part": len(kept), "capacity": capacity, "used": 0,
                            "bits": bytes(capacity * BITS_PER_KEY // 8)}
                    kept.append(last)
                bits = np.frombuffer(last["bits"], np.uint8).copy()
                at = places(pdf["digest"], len(bits) * 8).ravel()
                np.bitwise_or.at(bits, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))
                last.update(bits=bits.tobytes(), used=last["used"] + len(pdf))
            return pd.DataFrame(kept, columns=["bucket", "part", "capacity", "used", "bits"])

        return (keys.groupBy("bucket").cogroup(self.filters(keys.sparkSession, batch).groupBy("bucket"))
                .applyInPandas(grow, BLOOM))


def places(digests: pd.Series, size: int) -> np.ndarray:
    """Keys x probes: the bits of a filter of ``size`` bits that a digest sets."""
    words = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)
    step = words[:, 1] | np.uint64(1)
    return (words[:, :1] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(size)


def contains(bits: np.ndarray, digests: pd.Series) -> np.ndarray:
    at = places(digests, len(bits) * 8)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def stream_first_rows(stream: DataFrame, key: str, folder: str, table: SeenTable | None = None) -> None:
    """One row per key over all batches, to ``<folder>/data``; Spark's stream keeps no state, the table does."""
    table = table or SeenTable(folder)

    def write(df: DataFrame, batch: int) -> None:
        table.add(df, key, batch, f"{folder}/data")

    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
