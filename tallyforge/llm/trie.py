"""Prefix trie of conversations: which openings are shared, and what storing them once would save.

A node is a distinct sequence of first turns. Its identity is a sum over (position, role, text) digests, so that
running sums name all prefixes of a conversation of any length, spread over tasks if need be. Totals over subtrees
come from depth bands: nodes explode only to their ancestors inside a band of fixed height; the band roots, with
what their bands hold, are a tree of a height less by that factor, which is treated alike, and completed
root totals then go to the ancestors in the band above. A level explodes each node at most ``height`` times, and
there are as many levels as the depth has digits to that base.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..scale import Carry, keyed_join, prefix_scan, ranked
from .common import Scratch, utf8_bytes

#: Digits of a turn's digest that go into one of its summed words: 32 bits, so that 2^31 of them fit a long.
WORD = 8
WORDS = [f"_w{i}" for i in range(4)]


@dataclass(frozen=True)
class Trie:
    """``nodes`` (node, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) and
    ``ends`` (node, conv_id): the conversations that end at each node."""

    nodes: DataFrame
    ends: DataFrame


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): positions from 1 by turn, null first, then role and text; null role or text is empty.

    Rows without conv_id belong to no conversation and are left out. Equal rows are turns of their own.
    """
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    return ranked(turns, ["conv_id"], order, "pos").select("conv_id", "pos", "role", "text")


def with_openings(turns: DataFrame, plan: DataFrame, longest: int) -> DataFrame:
    """Conversations whose first turns are another's: (conv_id, pos, role, text).

    ``turns`` is as ``ordered_turns`` gives it, ``plan`` has one row per conversation: conv_id, donor, take (0 to
    ``longest``). A conversation gets the first ``take`` turns of ``donor`` (all, if fewer; none, if it is absent),
    then its own after its first ``take``. Openings are gathered per donor, at most ``longest`` turns each,
    so any number of conversations may share one.
    """
    heads = (turns.filter(F.col("pos") <= longest).groupBy(F.col("conv_id").alias("donor"))
             .agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("head")))
    heads = keyed_join(plan.select("conv_id", "donor", "take"), heads, ["donor"], "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,role:string,text:string>>")), F.lit(1), F.col("take").cast("int"))
    heads = heads.select("conv_id", "take", head.alias("head"))
    opening = heads.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.role", "t.text")
    offsets = heads.select("conv_id", "take", (F.size("head") - F.col("take")).alias("shift"))
    rest = keyed_join(turns, offsets, ["conv_id"]).filter(F.col("pos") > F.col("take"))
    return opening.unionByName(rest.select("conv_id", (F.col("pos") + F.col("shift")).cast("long").alias("pos"), "role", "text"))


def _node(depth: Column, words: list[Column]) -> Column:
    return F.md5(F.concat_ws(",", depth, *words))


def _paths(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, bytes): the nodes along each conversation, the root included."""
    digest = F.md5(F.concat_ws("|", "pos", F.md5("role"), F.md5("text")))
    words = {w: F.conv(F.substring(digest, 1 + WORD * i, WORD), 16, 10).cast("long") for i, w in enumerate(WORDS)}
    hashed = turns.select("conv_id", "pos", utf8_bytes("text").alias("bytes"), *[c.alias(w) for w, c in words.items()])
    summed = prefix_scan(hashed, ["conv_id"], [F.col("pos").asc()], **{f"{w}_before": Carry("sum", F.col(w)) for w in WORDS})
    before = [F.col(f"{w}_before").cast("long") for w in WORDS]
    upto = [b + F.col(w) for b, w in zip(before, WORDS, strict=True)]
    root = _node(F.lit(0), [F.lit(0) for _ in WORDS])
    roots = convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), root.alias("node"),
                         F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("bytes"))
    inner = summed.select("conv_id", F.col("pos").cast("long").alias("depth"), _node(F.col("pos"), upto).alias("node"),
                          _node(F.col("pos") - 1, before).alias("parent"), "bytes")
    return roots.unionByName(inner)


def subtree_sums(paths: DataFrame, nodes: DataFrame, values: list[str], height: int, scratch: Scratch, level: int = 0) -> DataFrame:
    """(node, *values): each value summed over a node's subtree, the node included.

    ``nodes`` (node, conv_id, depth, *values) names for each node one conversation through it, ``paths``
    (conv_id, depth, node) has the nodes along these conversations. Per (conversation, band) both have at most
    ``height`` rows.
    """
    band = F.floor(F.col("depth") / height).alias("band")
    steps = paths.select("conv_id", F.col("node").alias("top"), F.col("depth").alias("top_depth"), band)
    total = lambda df: df.groupBy(F.col("top").alias("node")).agg(*[F.sum(v).alias(v) for v in values])
    inside = nodes.select("conv_id", "depth", *values, band).join(steps, ["conv_id", "band"]).filter(F.col("top_depth") <= F.col("depth"))
    within = total(inside)
    if (nodes.agg(F.max("depth")).first()[0] or 0) < height:
        return within
    within = scratch.write(within, f"within{level}")
    at_root = F.col("depth") % height == 0
    up = F.floor(F.col("depth") / height).cast("long").alias("depth")
    roots = nodes.filter(at_root).select("node", "conv_id", up).join(within, "node")
    roots = scratch.write(roots, f"roots{level}")
    above = subtree_sums(paths.filter(at_root).select("conv_id", up, "node"), roots, values, height, scratch, level + 1)
    done = roots.filter(F.col("depth") > 0).select("node", "conv_id", (F.col("depth") - 1).alias("band")).join(above, "node")
    passed = total(done.drop("node").join(steps, ["conv_id", "band"]))
    return within.unionByName(passed).groupBy("node").agg(*[F.sum(v).alias(v) for v in values])


def prefix_trie(convs: DataFrame, turns: DataFrame, height: int = 8) -> Trie:
    """The trie of ``turns`` (conv_id, pos from 1 without gaps, role, text) and of ``convs`` (conv_id), which may be turnless.

    Conversations are told apart by conv_id, which is not null and occurs once in ``convs``; equal ones share all
    their nodes. ``conv_id`` of a node is its smallest member, ``n_convs`` the number of members, ``n_leaves`` the
    number of childless nodes in the subtree, and ``saved_tokens`` the sum over the subtree of (n_convs - 1) times
    the UTF-8 bytes of a node's last text. The root has depth 0 and no parent; without conversations there is
    no node. Other columns are ignored. Texts and conversations may be of any length.
    """
    scratch = Scratch(convs.sparkSession)
    paths = scratch.write(_paths(convs, turns), "paths")
    nodes = paths.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"),
                                      F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"))
    nodes = scratch.write(nodes, "nodes")
    children = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    valued = counted.select("node", "conv_id", "depth", "parent", "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                            ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    valued = scratch.write(valued, "valued")
    values = ["n_leaves", "saved_tokens"]
    sums = subtree_sums(paths.select("conv_id", "depth", "node"), valued.select("node", "conv_id", "depth", *values), values, height, scratch)
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = keyed_join(valued.drop(*values), parents, ["parent"], "left").join(sums, "node")
    ends = paths.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    return Trie(out.select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *values), ends.select("node", "conv_id"))


# ------------------------------------------------------------------ digests of long id lists


def _chunks(batches: Iterator[pd.DataFrame], size: int = 4096) -> Iterator[pd.DataFrame]:
    """Rows in order of (key, id) to (key, first, ids): at most ``size`` ids, comma-joined."""
    for batch in batches:
        part = (batch["key"] != batch["key"].shift()).cumsum() * len(batch) + pd.RangeIndex(len(batch)) // size
        groups = batch.assign(text=batch["id"].astype(str)).groupby(part, sort=False)
        yield pd.DataFrame({"key": groups["key"].first(), "first": groups["id"].first(), "ids": groups["text"].agg(",".join)})


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks in order of (key, first) to (key, sha256): one running digest at a time."""
    key, running = None, None
    for batch in batches:
        out = []
        for k, ids in zip(batch["key"], batch["ids"], strict=True):
            if running is not None and k == key:
                running.update(b"," + ids.encode())
            else:
                if running is not None:
                    out.append((key, running.hexdigest()))
                key, running = k, hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=["key", "sha256"])
    if running is not None:
        yield pd.DataFrame([(key, running.hexdigest())], columns=["key", "sha256"])


def id_digests(ids: DataFrame, key: str, value: str) -> DataFrame:
    """(key, sha256): lowercase SHA-256 of each key's long values, ascending and comma-joined.

    A digest has to see its text in order. Values are sorted by ranges over all tasks and joined there to pieces of a few
    thousand; the pieces of one key then pass through one digest, as a stream, so even a key with a third of all
    rows needs no memory and few rows.
    """
    pairs = ids.select(F.col(key).alias("key"), F.col(value).cast("long").alias("id"))
    pieces = pairs.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInPandas(_chunks, "key string, first long, ids string")
    whole = pieces.repartition("key").sortWithinPartitions("key", "first").mapInPandas(_digests, "key string, sha256 string")
    return whole.withColumnRenamed("key", key)
