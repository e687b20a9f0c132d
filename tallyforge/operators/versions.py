"""Frozen versions of a table: a stored hash tree, and the rows by which two versions differ.

The tree is that of ``dedup.dataset_fingerprint``: leaves are distinct row hashes with their counts, nodes cover four hex
digits more each. Kept on disk are its nodes of four digits, digests of what lies under six digits, and the leaves with their
rows, hashes as bytes; files are sorted by the hash and lie in one folder per first digit. A comparison starts at the roots,
goes down only where digests differ, and so reads row groups of leaves in proportion to what changed. Nodes of six digits are
16.7 million at most, however many leaves there are: eight digits would have a node for almost every leaf.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, StructType

from ..scale import is_small, largest_group, materialize, may_broadcast, setting
from .dedup import _row_text, tree_levels

#: Digits of the hash: folders, and the stored node levels.
FOLDER, UPPER, LOWER = 1, 4, 6
#: Differing nodes up to which a scan is told their names, so that files and row groups without them are skipped;
#: beyond it they are joined.
NAMED = 4096


@dataclass(frozen=True)
class Version:
    """Where a version's tree lies."""

    path: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """``upper`` and ``lower`` (h, digest, n), ``leaves`` (h as bytes, n, row); those in folders also have ``folder``.

        The schema is given, as an empty table has no file to take it from, and folders such as 1 are text.
        """
        columns = f"h string, digest {'binary' if name == 'lower' else 'string'}, n long"
        if name == "leaves":
            row = StructType.fromJson(json.loads(spark.read.text(f"{self.path}/schema", wholetext=True).first()[0]))
            columns = f"h binary, n long, row {row.simpleString()}"
        return spark.read.schema(columns if name == "upper" else f"{columns}, folder string").parquet(f"{self.path}/{name}")


def _digits(h: Column, n: int) -> Column:
    """The first digits of a hash in bytes."""
    return F.substring(F.lower(F.hex(F.substring(h, 1, (n + 1) // 2))), 1, n)


def _write(df: DataFrame, folder: Column, path: str) -> None:
    """Sorted files in a folder per first digit, so that row groups hold neighbours."""
    df.withColumn("folder", folder).sortWithinPartitions("folder", "h").write.partitionBy("folder").parquet(path)


def freeze(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> Version:
    """Write the hash tree of ``df`` below ``path``, which must not exist.

    A row is its ``columns`` (all by default) as text. Rows may repeat; nulls are values. An empty table has a root
    without nodes. Rows are shuffled once, without their hashes, which are made again behind the shuffle; leaves are bucketed
    by the first two bytes of the hash, so the nodes are made of them without another one.
    """
    columns = list(columns or df.columns)
    spark = df.sparkSession
    rows = df.select(*columns)
    spark.range(1).select(F.lit(rows.schema.json()).alias("value")).write.text(f"{path}/schema")
    digest, row = F.unhex(F.sha2(_row_text(columns), 256)), F.struct(*columns).alias("row")
    top, parts = F.substring(digest, 1, 2), int(spark.conf.get("spark.sql.shuffle.partitions"))
    if is_small(rows):
        parts = min(parts, spark.sparkContext.defaultParallelism)
    counted = rows.withColumn("_n", F.lit(1).cast("long"))
    if not is_small(rows) and largest_group(rows.select(top.alias("_top")), ["_top"]) > setting(rows, "tallyforge.hotRows"):
        # many copies of a row would go to one task
        copies = rows.select(digest.alias("_h"), row).groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), F.any_value("row").alias("row"))
        counted = copies.select("row.*", "_n")
    leaves = (counted.repartition(parts, top).select(top.alias("_top"), digest.alias("h"), row, "_n").groupBy("_top", "h")
              .agg(F.sum("_n").alias("n"), F.any_value("row").alias("row")).withColumn("folder", _digits(F.col("h"), FOLDER)))
    name = f"tallyforge_{uuid.uuid4().hex}"
    leaves.write.partitionBy("folder").bucketBy(parts, "_top").sortBy("h").option("path", f"{path}/leaves").format("parquet").saveAsTable(name)
    (eight,) = tree_levels(spark.table(name).select("_top", "h", "n"), (8,), top=True, dealt=True)
    under = eight.groupBy("_top", F.substring("h", 1, LOWER).alias("h")).agg(
        F.sort_array(F.collect_list("digest")).alias("digests"), F.sum("n").alias("n"))
    # a node of four digits has at most 256 parts of six
    parts = F.collect_list(F.struct("h", F.unhex(F.substring(F.sha2(F.array_join("digests", ","), 256), 1, 32)).alias("digest"), "n"))
    nodes = materialize(under.groupBy("_top").agg(
        F.sha2(F.array_join(F.array_sort(F.flatten(F.collect_list("digests"))), ","), 256).alias("digest"),
        F.sum("n").alias("n"), parts.alias("parts")).select(F.lower(F.hex("_top")).alias("h"), "digest", "n", "parts"))
    _write(nodes.select(F.inline("parts")), F.substring("h", 1, FOLDER), f"{path}/lower")
    nodes.select("h", "digest", "n").write.parquet(f"{path}/upper")
    spark.sql(f"DROP TABLE {name}")  # the files are read by path from here on
    return Version(path)


def root(spark: SparkSession, version: Version) -> DataFrame:
    """One row (fingerprint, n_rows), the same as ``dataset_fingerprint`` of the rows; none for an empty version."""
    (top,) = tree_levels(version.table(spark, "upper").select("h", "digest", "n"), (0,), nodes=True)
    return top.select(F.col("digest").alias("fingerprint"), F.col("n").alias("n_rows"))


def _unequal(old: DataFrame, new: DataFrame, values: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """(h, old_*, new_*) where one side lacks the hash or has another value."""
    cols = [*values, *extra]
    a = old.select("h", *[F.col(c).alias(f"old_{c}") for c in cols])
    b = new.select("h", *[F.col(c).alias(f"new_{c}") for c in cols])
    differ = F.lit(False)
    for v in values:
        differ = differ | ~F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    return a.join(b, "h", "full").filter(differ)


def _below(table: DataFrame, parents: DataFrame, digits: int) -> DataFrame:
    """The rows of a level under ``parents`` (h of so many digits)."""
    names = [r["h"] for r in parents.select("h").limit(NAMED + 1).collect()]
    raw = isinstance(table.schema["h"].dataType, BinaryType)
    if len(names) <= NAMED:
        near = table.filter(F.col("folder").isin(sorted({n[:FOLDER] for n in names})))
        # the ends of a node's range let row groups be skipped
        ends = [(f"X'{lo}'", f"X'{hi[:-1]:f<64}'") if raw else (f"'{lo}'", f"'{hi}'") for lo, hi in _ranges(names)]
        return near.filter(" OR ".join(f"h BETWEEN {lo} AND {hi}" for lo, hi in ends) or "false")
    keys = parents.select(F.substring("h", 1, FOLDER).alias("folder"), F.col("h").alias("_node"))
    node = _digits(F.col("h"), digits) if raw else F.substring("h", 1, digits)
    keys = F.broadcast(keys) if may_broadcast(keys) else keys
    return table.withColumn("_node", node).join(keys, ["folder", "_node"], "left_semi").drop("_node")


def _ranges(names: Sequence[str], most: int = 64) -> list[tuple[str, str]]:
    """Neighbouring nodes as one range of hashes; at most ``most`` ranges, joined at their nearest ends beyond that.

    What lies between is equal on both sides, or it would be among the names, and drops out of the comparison again.
    """
    spans: list[list[str]] = []
    for n in sorted(names):
        if spans and int(n, 16) - int(spans[-1][1], 16) <= 1:
            spans[-1][1] = n
        else:
            spans.append([n, n])
    while len(spans) > most:
        gaps = [int(b[0], 16) - int(a[1], 16) for a, b in zip(spans, spans[1:])]
        limit = sorted(gaps)[len(spans) - most - 1]
        merged = [spans[0]]
        for gap, span in zip(gaps, spans[1:]):
            if gap <= limit:
                merged[-1][1] = span[1]
            else:
                merged.append(span)
        spans = merged
    return [(a, b + "g") for a, b in spans]  # "g" comes after every hex digit


def fingerprint_diff(spark: SparkSession, old: Version, new: Version) -> DataFrame:
    """(change, row, n_old, n_new): rows that are ``added``, ``removed``, or ``repeated`` another number of times.

    Roots and upper nodes are compared first; of the next level only what lies under differing nodes is read, and of the
    leaves only what lies under differing nodes of that. Equal versions read no leaf.
    """
    upper = materialize(_unequal(old.table(spark, "upper"), new.table(spark, "upper"), ["digest"]).select("h"))
    lower = materialize(_unequal(*[_below(v.table(spark, "lower"), upper, UPPER) for v in (old, new)], ["digest"]).select("h"))
    leaves = _unequal(*[_below(v.table(spark, "leaves"), lower, LOWER) for v in (old, new)], ["n"], ["row"])
    n_old, n_new = (F.coalesce(c, F.lit(0)).cast("long") for c in ("old_n", "new_n"))
    change = F.when(F.col("old_n").isNull(), "added").when(F.col("new_n").isNull(), "removed").otherwise("repeated")
    return leaves.select(change.alias("change"), F.coalesce("new_row", "old_row").alias("row"), n_old.alias("n_old"), n_new.alias("n_new"))
