"""Line dedup: repeated lines go everywhere but in one document.

Lines are exploded with their positions, their normalised keys hashed, distinct documents counted per hash, and the
lines over the threshold dropped; what stays is put together again by position. Everything is built-in expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..scale import may_broadcast
from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space.
BLANK = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Settings:
    """What a repeated line is: a key of ``least_chars`` code points or more in ``least_docs`` documents or more.

    Keys in more than ``hot_docs`` documents are broadcast, at most lines / hot_docs of them; of all
    others, a task of the join by key meets at most ``hot_docs`` documents.
    """

    least_chars: int = 40
    least_docs: int = 5
    hot_docs: int = 1_000_000


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    bare = F.trim(line, F.lit(BLANK))
    # plain ASCII has a much faster way that comes to the same
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keyed(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc, row, pos, key): the long enough lines, with a 128-bit hash of their key."""
    lines = docs.select("doc", "row", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    # lower case changes no length, so it waits for the lines that are long enough
    long = F.char_length(F.trim("line", F.lit(BLANK))) >= settings.least_chars
    return lines.filter(long).select("doc", "row", "pos", F.unhex(F.md5(line_key(F.col("line")))).alias("key"))


def repeated_keys(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(key, n_docs, keeper): hashes of keys in enough documents, and the largest doc_id that holds each.

    ``docs`` has doc_id and text. Counts are distinct documents: first one row per (key, document), which
    spreads a key that is everywhere, then counts that are combined before they are shuffled.
    """
    return _repeated(_named(docs), settings)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("row"), "text")


def _repeated(docs: DataFrame, settings: Settings) -> DataFrame:
    once = _keyed(docs, settings).select("key", "doc").distinct()
    counts = once.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("keeper"))
    return counts.filter(F.col("n_docs") >= settings.least_docs)


def drop_repeated_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every row of ``docs`` (doc_id, text), less its repeated lines.

    A text is split at line feeds; null or empty is one empty line, and comes back as the empty string. A line's
    key is ``line_key``. If a key is repeated, all its lines go, but for those of the largest doc_id that holds
    it, which keeps all of them. ``n_lines`` counts lines before dropping.

    Rows of one doc_id are one document, also equal rows, and all rows without doc_id are one that comes before
    all others: each row is judged and comes back. Texts and lines may be of any length. An empty table gives
    none. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    rows = _named(docs)
    repeated = scratch.write(_repeated(rows, settings), "repeated")
    lines = _keyed(rows, settings)
    if may_broadcast(repeated):
        hits = lines.join(F.broadcast(repeated), "key")
    else:
        hot = repeated.filter(F.col("n_docs") > settings.hot_docs)
        cold = lines.join(F.broadcast(hot.select("key")), "key", "left_anti").join(repeated, "key")
        hits = lines.join(F.broadcast(hot), "key").unionByName(cold)
    dropped = (hits.filter(~F.col("doc").eqNullSafe(F.col("keeper"))).groupBy("doc", "row")
               .agg(F.sort_array(F.collect_set("pos")).alias("gone")).withColumnsRenamed({"doc": "_doc", "row": "_row"}))
    joined = rows.join(dropped, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row")), "left")
    lines = _lines(F.col("text"))
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    return joined.select(F.col("doc").alias("doc_id"),
                         F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(_without(lines, F.col("gone"))).alias("text"),
                         F.size(lines).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"))


def _without(lines: Column, gone: Column) -> Column:
    """The lines at other positions than ``gone`` (ascending), joined: the slices between two dropped lines, so linear.

    A lambda over one struct binds both arrays, which would else be built again for each slice.
    """
    def kept(x: Column) -> Column:
        cuts = F.arrays_zip(F.concat(F.array(F.lit(-1)), x["gone"]).alias("after"), F.concat(x["gone"], F.array(F.size(x["lines"]))).alias("until"))
        return F.flatten(F.transform(cuts, lambda c: F.slice(x["lines"], c["after"] + F.lit(2), c["until"] - c["after"] - F.lit(1))))
    return F.array_join(F.transform(F.array(F.struct(lines.alias("lines"), gone.alias("gone"))), kept)[0], "\n")
