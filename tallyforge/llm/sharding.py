"""Sharding by longest processing time first: groups that stay together, largest first, to the lightest shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from .common import Scratch, running_sums, utf8_bytes


def lightest_first(items: Iterable[tuple[int, int]], shards: int) -> dict[int, int]:
    """item -> shard for (item, bytes) pairs: the largest item goes to the shard with the fewest bytes so far."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def shard_by_size(docs: DataFrame, shards: int = 40, parts: int = 64, overhead: int = 16,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot, group_bytes) per row; equal texts share a shard.

    A row's size is the UTF-8 bytes of its text plus ``overhead``. Groups stand by size, largest first, and running
    sums over them cut that order into items: a group above ``total / (shards * parts)`` bytes is an item of its
    own, smaller neighbours are dealt as one item of about that many bytes. So at most ``2 * shards * parts + 1``
    items, whatever the number of groups, meet in the heap on the driver, and a shard ends at most one item above
    the mean unless a single group is larger than that. ``slot`` numbers the rows of a shard without gaps from 0.

    Null and empty texts form one group each. Repeated rows stay and get slots of their own; rows alike in id and
    text are interchangeable. An empty table gives an empty result.
    """
    if shards < 1 or parts < 1:
        raise ValueError("shards and parts have to be positive")
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(docs.select(
        F.col(id_col).alias("_id"), (utf8_bytes(text_col) + overhead).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.unhex(F.sha2(text_col, 256)).alias("_group")), "rows")
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_bytes")).withColumn("_largest", -F.col("_bytes"))
    groups = groups.withColumn("_all", F.lit(0))
    before = scratch.write(running_sums(groups, scratch, "groups", ["_all"], ["_largest", "_group"], _before="_bytes"), "order")
    total = before.agg(F.sum("_bytes")).first()[0] or 0
    quantum = max(1, total // (shards * parts))
    # one item per group above the quantum, else per quantum-wide stretch of the running sum
    item = F.when(F.col("_bytes") > quantum, -1 - F.floor(F.col("_before") / quantum)).otherwise(F.floor(F.col("_before") / quantum))
    dealt = before.withColumn("_item", item.cast("long"))
    items = dealt.groupBy("_item").agg(F.sum("_bytes").alias("_bytes")).collect()
    placed = lightest_first(((r["_item"], r["_bytes"]) for r in items), shards)
    pairs = docs.sparkSession.createDataFrame(sorted(placed.items()) or [(0, 0)], "_item long, shard int")
    shard = dealt.join(F.broadcast(pairs), "_item").select(F.col("_group").alias("_g"), F.col("_bytes").alias("group_bytes"), "shard")
    joined = (rows.join(shard, F.col("_group").eqNullSafe(F.col("_g"))).drop("_g")
              .withColumn("_one", F.lit(1)))
    slots = running_sums(joined, scratch, "slots", ["shard"], ["_id", "_group"], slot="_one")
    return slots.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot", "group_bytes")
