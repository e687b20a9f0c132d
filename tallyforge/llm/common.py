"""Helpers of this subpackage: scratch tables in the shared folder, word counts and distributed running sums."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..scale import shared_dir

#: ASCII white space; a word is a run of anything else.
BLANK_WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables of one run, written to the folder that the cluster shares.

    ``drop`` deletes a table that nothing reads any more; the rest goes when the session ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/tallyforge-llm-{uuid.uuid4().hex}"
        self._fs().mkdirs(self._path(self.base))
        self._fs().deleteOnExit(self._path(self.base))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.base).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write and read back: short lineage that survives lost executors."""
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables, and let Spark remove the shuffle files of finished steps, which it does when garbage is collected."""
        for name in names:
            self._fs().delete(self._path(self.path(name)), True)
        gc.collect()
        self.spark._jvm.System.gc()


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send whole texts to Python in batches of at most ``rows``, so that a worker's memory stays bounded.

    Arrow's usual 10,000 rows are made for numbers. The setting is the session's; a smaller one is left alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def blank_words(text: Column | str) -> Column:
    """Number of blank-separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(BLANK_WORD)), F.lit(0)).cast("long")


def utf8_bytes(text: Column | str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def running_sums(df: DataFrame, scratch: Scratch, name: str, by: Sequence[str], order: Sequence[str],
                 **sums: str) -> DataFrame:
    """Add, per row, the sum of a column over the earlier rows of its group: ``new=column``.

    Rows are dealt to tasks by ranges of (group, order), so a group of any size is spread. Each slice
    is summed by itself; what earlier slices of the same group hold is one row per (group, slice),
    and those rows, not the data, meet in a window. ``order`` has to be total up to equal rows.
    """
    by, order = list(by), list(order)
    keys = [F.col(c) for c in (*by, *order)]
    sliced = scratch.write(df.repartitionByRange(*keys).withColumn("_slice", F.spark_partition_id()), name)
    local = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = (sliced.groupBy(*by, "_slice").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
              .select(*[F.col(b).alias(f"_k_{b}") for b in by], F.col("_slice").alias("_k_slice"),
                      *[F.coalesce(F.sum(f"_t_{n}").over(across), F.lit(0)).alias(f"_c_{n}") for n in sums]))
    on = F.col("_slice") == F.col("_k_slice")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    return (sliced.withColumns({n: F.coalesce(F.sum(c).over(local), F.lit(0)) for n, c in sums.items()})
            .join(totals, on, "left")
            .withColumns({n: (F.col(n) + F.col(f"_c_{n}")).cast("long") for n in sums})
            .drop("_slice", "_k_slice", *[f"_k_{b}" for b in by], *[f"_c_{n}" for n in sums]))
