"""Near copies by the Jaccard similarity of their word n-grams, with prefix filters under several token orders.

Two sets with enough in common share a token among the first few of each, whatever order all tokens are put in.
So a pair has to pass under every order, and the filters are intersected before any set is compared:

1. By hash order, with a longer prefix: documents whose prefix has too few tokens that any other document's prefix
   has as well cannot have a partner. Only these prefixes, a quarter of all tokens, are counted.
2. For what is left, three orders by document frequency, rare tokens first, that break ties differently. Tokens of one
   document only cannot match and take up prefix places; a document whose prefix is full of them is out.
3. Pairs meet through a shared prefix token of one order, have to share one under the other orders too, and are
   then verified on their whole sets.

Large families are not expanded into all pairs: every prefix token's documents first meet a few hubs, central ones;
what is then connected needs no further look, and only pairs across components are enumerated, if both have enough
tokens that any other document has. No link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.graph import connected_components
from ..scale import may_broadcast
from .common import Scratch, text_batches

NOT_BLANK = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Settings:
    """Two texts link when ``100 * |A and B| >= percent * |A or B|`` over their ``words``-word shingles."""

    words: int = 4
    percent: int = 85
    hubs: int = 3

    def least_overlap(self, n):
        """Tokens a set of ``n`` has to share with any partner."""
        return (self.percent * n + 99) // 100


class _WordHashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()
_M1, _M2, _S29, _S32 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29), np.uint64(32)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; a shorter text is one token; no words, no token."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), seed=len(parts))], np.uint64)
    ids = np.fromiter(map(_HASHES.__getitem__, parts), np.uint64, len(parts))
    h = ids[:len(ids) - words + 1].copy()
    for j in range(1, words):
        h ^= h >> _S29
        h *= _M1
        h += ids[j:len(ids) - words + 1 + j]
    h ^= h >> _S32
    h *= _M2
    h ^= h >> _S29
    return np.unique(h)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(offsets, values)


def _key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _sketch(settings: Settings):
    """(rid, id, text) -> (rid, id, key, n, need, prefix): the hash-ordered prefix and how much of it has to be shared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, needs, prefixes = [], [], [], []
            for text in batch.column("text"):
                tokens = shingles(text.as_py(), settings.words)
                n = len(tokens)
                more = n // 10  # places beyond the plain prefix; as many more tokens have to be shared
                keys.append(_key(tokens))
                sizes.append(n)
                needs.append(1 + settings.least_overlap(n) // 10)
                prefixes.append(tokens[:n - settings.least_overlap(n) + 1 + more] if n else tokens)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(needs, pa.int64()), _lists(prefixes)], names=["rid", "id", "key", "n", "need", "prefix"])
    return run


def _tokens(settings: Settings):
    """(id, text) -> (id, key, tokens)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py(), settings.words) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([_key(s) for s in sets], pa.binary()), _lists(sets)],
                                             names=["id", "key", "tokens"])
    return run


def _survivors(sketch: DataFrame, reps: DataFrame) -> DataFrame:
    """Representatives with enough prefix tokens that another representative's prefix has too."""
    chosen = reps.select("rid")
    entries = (sketch.join(F.broadcast(chosen) if may_broadcast(chosen) else chosen, "rid", "left_semi")
               .select("rid", "need", F.explode("prefix").alias("token")))
    shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("token")
    return (entries.join(shared, "token").groupBy("rid").agg(F.count(F.lit(1)).alias("c"), F.max("need").alias("need"))
            .filter("c >= need").select("rid"))


def _ordered(tokens: DataFrame, settings: Settings) -> DataFrame:
    """(rid, n, m, centre, tokens, p1, p2, p3): the tokens that several documents have, and the prefixes under three orders.

    ``m`` counts these tokens and ``centre`` tells how common they are.
    """
    entries = tokens.select("rid", "n", F.explode("tokens").alias("token"))
    frequent = entries.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    lists = (entries.join(frequent, "token").groupBy("rid")
             .agg(F.max("n").alias("n"), F.avg(F.log2("df")).alias("centre"), F.collect_list(F.struct("df", "token")).alias("t")))
    least = F.floor((settings.percent * F.col("n") + 99) / 100)
    # tokens of this document only stand first under every order
    room = (F.col("n") - least + 1) - (F.col("n") - F.size("t"))
    level = lambda x: F.floor(F.log2(x["df"].cast("double")))

    def prefix(order) -> Column:
        ranked = F.array_sort(F.transform("t", lambda x: F.struct(*order(x), x["token"].alias("token"))))
        return F.transform(F.slice(ranked, F.lit(1), F.col("room").cast("int")), lambda x: x["token"])

    return (lists.withColumn("room", room).filter("room > 0")
            .select("rid", "n", F.size("t").cast("long").alias("m"), "centre", F.transform("t", lambda x: x["token"]).alias("tokens"),
                    prefix(lambda x: [x["df"].alias("a")]).alias("p1"),
                    prefix(lambda x: [level(x).alias("a"), F.xxhash64(x["token"]).alias("b")]).alias("p2"),
                    prefix(lambda x: [level(x).alias("a"), F.xxhash64(x["token"], F.lit(1)).alias("b")]).alias("p3")))


def _possible(settings: Settings, x: str, y: str) -> Column:
    """Sizes near enough, and enough tokens on both sides that any other document has."""
    p = settings.percent
    return ((100 * F.col(f"{x}n") >= p * F.col(f"{y}n")) & (100 * F.col(f"{y}n") >= p * F.col(f"{x}n"))
            & ((100 + p) * F.least(f"{x}m", f"{y}m") >= p * (F.col(f"{x}n") + F.col(f"{y}n"))))


def _verified(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) that share a prefix token under the other orders as well and are as similar as asked."""
    side = lambda x: sets.select(F.col("rid").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "tokens", "p2", "p3")])
    both = (pairs.join(side("a"), "a").join(side("b"), "b")
            .filter(F.arrays_overlap("a_p2", "b_p2") & F.arrays_overlap("a_p3", "b_p3")))
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return (both.withColumn("common", common)
            .filter(100 * F.col("common") >= settings.percent * (F.col("a_n") + F.col("b_n") - F.col("common")))
            .select("a", "b"))


def _hub_pairs(entries: DataFrame, settings: Settings) -> DataFrame:
    """Each document with a few hubs of each of its prefix tokens: linear in the number of entries.

    Hubs are the document with the largest share of tokens that others have, the one whose tokens are the most
    common, and further ones by hash.
    """
    orders = [-F.col("m") / F.col("n"), -F.col("centre"), *[F.xxhash64("rid", F.lit(i)).cast("double") for i in range(settings.hubs)]]
    hubs = entries.groupBy("token").agg(
        F.count(F.lit(1)).alias("c"),
        *[F.min(F.struct(o.alias("o"), "rid", "n", "m")).alias(f"h{i}") for i, o in enumerate(orders[:settings.hubs])])
    hubs = hubs.filter("c > 1").select("token", F.explode(F.array_distinct(F.array(
        *[F.struct(F.col(f"h{i}.rid").alias("hub"), F.col(f"h{i}.n").alias("h_n"), F.col(f"h{i}.m").alias("h_m")) for i in range(settings.hubs)]))).alias("x"))
    hubs = hubs.select("token", "x.hub", "x.h_n", "x.h_m")
    met = entries.select("token", "rid", F.col("n").alias("d_n"), F.col("m").alias("d_m")).join(hubs, "token")
    met = met.filter((F.col("rid") != F.col("hub")) & _possible(settings, "d_", "h_"))
    return met.select(F.least("rid", "hub").alias("a"), F.greatest("rid", "hub").alias("b")).distinct()


#: Prefixes up to this size travel with the entries of open tokens, so a pair is told once and tested early.
CARRIED = 64


def _cross_pairs(entries: DataFrame, sets: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of documents that share a prefix token and lie in different components.

    A token is open if it has documents of several components. Documents that have too few shared tokens even for
    the smallest document of a token leave it. A pair that meets at several tokens is told at the first of them, and
    only if it meets under the other orders too, where the prefixes are short enough to be carried; the rest is
    tested later in the same way.
    """
    p = settings.percent
    placed = (entries.join(labels.withColumnRenamed("id", "rid"), "rid", "left")
              .withColumn("component", F.coalesce("component", "rid")))
    several = (placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least"))
               .filter("lo < hi").select("token", "least"))
    smallest = F.greatest(F.col("least"), F.floor((p * F.col("n") + 99) / 100))
    open_ = placed.join(several, "token").filter((100 + p) * F.col("m") >= p * (F.col("n") + smallest))
    short = lambda c: F.when(F.size("p1") <= CARRIED, F.col(c)).alias(c)
    open_ = open_.select("token", "rid", "n", "m", "component").join(sets.select("rid", short("p1"), short("p2"), short("p3")), "rid")
    side = lambda x: open_.select("token", *[F.col(c).alias(f"{x}_{c}") for c in ("rid", "n", "m", "component", "p1", "p2", "p3")])
    first = F.array_min(F.array_intersect("x_p1", "y_p1"))
    meets = F.coalesce((first == F.col("token")) & F.arrays_overlap("x_p2", "y_p2") & F.arrays_overlap("x_p3", "y_p3"), F.lit(True))
    on = (F.col("x_component") < F.col("y_component")) & _possible(settings, "x_", "y_") & meets
    met = side("x").join(side("y"), "token").filter(on)
    return met.select(F.least("x_rid", "y_rid").alias("a"), F.greatest("x_rid", "y_rid").alias("b")).distinct()


def _linked(docs: DataFrame, scratch: Scratch, s: Settings, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and per set (key, rid, id, low, component): the set's first row and its component."""
    text_batches(docs.sparkSession)
    kind = docs.select(id_col).dtypes[0][1]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = scratch.write(rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(
        _sketch(s), f"rid long, id {kind}, key binary, n long, need long, prefix array<long>"), "sketch")
    reps = scratch.write(sketch.filter("n > 0").groupBy("key").agg(
        F.min(F.struct("rid", "id")).alias("first"), F.min("id").alias("low"), F.max("n").alias("n"))
        .select("key", "first.rid", F.col("first.id").alias("id"), "low", "n"), "classes")
    kept = scratch.write(reps.join(_survivors(sketch, reps), "rid").select("rid", "id", "key", "n"), "survivors")
    sketch = scratch.write(sketch.select("id", "key", "n"), "rows")
    scratch.drop("sketch")
    wanted = kept.select(F.col("id").alias("_id")).distinct()
    again = rows.join(wanted, F.col("id").eqNullSafe(F.col("_id")), "left_semi").mapInArrow(
        _tokens(s), f"id {kind}, key binary, tokens array<long>")
    chosen = kept.select("rid", F.col("id").alias("_id"), F.col("key").alias("_key"), "n")
    tokens = (again.join(chosen, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")))
              .groupBy("rid").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")))
    sets = scratch.write(_ordered(scratch.write(tokens, "tokens"), s), "sets")
    scratch.drop("tokens", "survivors")
    entries = scratch.write(sets.select("rid", "n", "m", "centre", F.explode("p1").alias("token")), "entries")
    links = scratch.write(_verified(_hub_pairs(entries, s), sets, s), "hub_links")
    labels = connected_components(links, src="a", dst="b")
    across = scratch.write(_verified(_cross_pairs(entries, sets, labels, s), sets, s), "cross_links")
    if not across.isEmpty():
        labels = connected_components(links.unionByName(across), src="a", dst="b")
    scratch.drop("sets", "entries")
    named = (reps.join(labels.select(F.col("id").alias("_rid"), "component"), F.col("rid") == F.col("_rid"), "left")
             .withColumn("component", F.coalesce("component", "rid")).select("key", "rid", "id", "low", "component"))
    return sketch, named


def near_copies(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) per row: the smallest id that its text is linked with, through any chain.

    A text's set are its distinct ``words``-word shingles over lower-cased blank-separated words; a shorter text is one
    token as a whole; null, empty and blank texts have none and keep their own id. Rows with equal sets always
    link. Ids need not be unique: links belong to texts, and every row gets its text's component. Null ids do not
    count as smallest unless a component has no other. Further columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    sketch, named = _linked(docs, scratch, settings, id_col, text_col)
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = named.join(lowest, "component").select(F.col("key").alias("_key"), "component_id")
    return (sketch.select("id", "key", "n").join(classes, (F.col("key") == F.col("_key")) & (F.col("n") > 0), "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")))


def keep_one(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, one with its smallest id; columns unchanged.

    Texts without words are linked with nothing and stay. Where several rows have the chosen id, one whose text
    has the chosen set stays.
    """
    scratch = Scratch(docs.sparkSession)
    sketch, named = _linked(docs, scratch, settings, id_col, text_col)
    first = (named.groupBy("component").agg(F.min(F.struct(F.col("low").isNull().alias("no"), "low", "key")).alias("m"))
             .select(F.col("m.low").alias("__join_id"), F.col("m.key").alias("__join_key")))
    often = sketch.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("id").alias("__join_often"))
    once = first.join(often, F.col("__join_id").eqNullSafe(F.col("__join_often")), "left_anti")
    several = scratch.write(first.join(often, F.col("__join_id").eqNullSafe(F.col("__join_often")), "left_semi"), "several")
    full = docs.filter(F.coalesce(F.col(text_col).rlike(NOT_BLANK), F.lit(False)))
    blank = docs.filter(~F.coalesce(F.col(text_col).rlike(NOT_BLANK), F.lit(False)))
    same = lambda: F.col(id_col).eqNullSafe(F.col("__join_id"))

    @F.pandas_udf("binary")
    def key(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _key(shingles(t, settings.words)))

    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = full.join(once.select("__join_id"), same(), "left_semi").unionByName(blank)
    if several.isEmpty():  # ids are unique, as they should be
        return kept
    rows = scratch.write(full.join(several.select("__join_id").distinct(), same(), "left_semi"), "repeated")
    repeated = (rows.withColumn("__join_set", key(F.col(text_col)))
                .join(several, same() & (F.col("__join_set") == F.col("__join_key")))
                .dropDuplicates(["__join_id", "__join_key"]).select(*columns))
    return kept.unionByName(repeated)
