"""Cross-tokenizer alignment by external spill counting.

Two tokenizers read the same bytes; where tokens of both end, the text is cut into groups, and the two tokens that end
together are linked. What a link is worth depends on how often its pair of ids is linked in the whole corpus, so pairs
are counted outside memory:

1. Each task encodes its texts and gathers (pair, document) records. Every few million records are sorted by pair, second
   id first, radix-partitioned by the second id, and written as runs of zstd blocks into one table.
2. The blocks of a partition come to a task in order of their first pair. A heap of open blocks merges the k runs:
   whatever lies before the next block's first pair is complete and counted. Partitions with many records are dealt to
   several tasks by run, and their partial counts, one per pair, are added up.
3. Order by the second id gives each id's highest count. The runs are merged once more beside the counts, and what each
   document's records are worth streams back to the documents.

Nothing holds all pairs or all records: a task has at most one open block per run it merges.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, text_batches


@dataclass(frozen=True)
class Settings:
    """Where the tokenizers lie, and how records are spilled.

    ``run_records`` records are gathered before a run is written, in blocks of ``block_records`` at most;
    second ids are dealt to ``partitions`` by their low bits' remainder, and a partition with more than
    ``task_records`` records to as many tasks as that takes.
    """

    first: str
    second: str
    run_records: int = 2_000_000
    block_records: int = 16_384
    partitions: int = 16
    task_records: int = 2_000_000


# ------------------------------------------------------------------ tokens


def _unicode_bytes() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


#: How byte-level vocabularies of this kind cut a text into stretches that no token crosses.
STRETCHES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that only newer Unicode tables may class otherwise; the two libraries need not have the same ones.
LATER = re.compile("[^\x00-\u024f]")


@lru_cache(maxsize=2)
def _first(path: str):
    """Encoder of a byte-level vocabulary, and the bytes of each id.

    Where the file's ids are in the order of its merges, as ranks, a library for ranks gives the same ids in a third of
    the time; texts with characters beyond the first Latin blocks, and files of another build, go to the file's own.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    table, vocab = _unicode_bytes(), tokenizer.get_vocab()
    entries = [b""] * (max(vocab.values()) + 1)
    for entry, i in vocab.items():
        entries[i] = bytes(table[c] for c in entry) if all(c in table for c in entry) else entry.encode()
    ranks = _ranks(path, entries)

    def encode(texts: list[str]) -> list[list[int]]:
        wide = [i for i, t in enumerate(texts) if ranks is None or LATER.search(t)]
        rest = dict(zip(wide, tokenizer.encode_batch_fast([" " + texts[i] for i in wide], add_special_tokens=False), strict=True))
        return [rest[i].ids if i in rest else ranks.encode_ordinary(" " + t) for i, t in enumerate(texts)]
    return encode, entries


def _ranks(path: str, entries: list[bytes]):
    """The encoding of a file whose ids are merge ranks and whose stretches are the usual ones, else None."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and spec["normalizer"] is None
             and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")))
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
    if not plain or any(model["vocab"].get(m) != 256 + i for i, m in enumerate(merged)):
        return None
    return tiktoken.Encoding(path, pat_str=STRETCHES, mergeable_ranks={entries[i]: i for i in model["vocab"].values() if i < 256 + len(merged)}, special_tokens={})


@lru_cache(maxsize=2)
def _second(path: str):
    """Encoder of a piece vocabulary, and the bytes of each id."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = []
    for i in range(pieces.get_piece_size()):
        name = pieces.id_to_piece(i)
        entries.append(bytes([int(name[3:-1], 16)]) if pieces.is_byte(i) else name.replace("▁", " ").encode())

    def encode(texts: list[str]) -> list[list[int]]:
        return pieces.encode(texts, num_threads=1)
    return encode, entries


@lru_cache(maxsize=4)
def _lengths(path: str, kind) -> np.ndarray:
    return np.array([len(b) for b in kind(path)[1]], dtype=np.int64)


@dataclass
class Aligned:
    """Tokens and cuts of a batch of texts; ``docs`` are the places of those that have tokens.

    ``a``, ``b`` are the ids of all texts in a row, ``doc_a``, ``doc_b`` say where each text starts, ``cut_a``, ``cut_b``
    are the places of the tokens that end together, and ``doc_cut`` where each text's cuts start.
    """

    docs: list[int]
    a: np.ndarray
    b: np.ndarray
    doc_a: np.ndarray
    doc_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    doc_cut: np.ndarray


def align(texts: list[str | None], first: str, second: str) -> Aligned:
    """Tokens of both sides and the byte offsets where both end.

    A text has no tokens if it is null or empty, or if the bytes of either side, joined, are not a blank and
    the text. No token is empty, so at a cut exactly one token of each side ends.
    """
    (encode_a, bytes_a), (encode_b, bytes_b) = _first(first), _second(second)
    docs = [i for i, t in enumerate(texts) if t]
    ids_a, ids_b = encode_a([texts[i] for i in docs]), encode_b([texts[i] for i in docs])
    kept = []
    for k, i in enumerate(docs):
        want = b" " + texts[i].encode()
        if b"".join([bytes_a[x] for x in ids_a[k]]) == want and b"".join([bytes_b[x] for x in ids_b[k]]) == want:
            kept.append(k)
    starts = lambda lists: np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    flat = lambda lists: np.array(list(chain.from_iterable(lists)), dtype=np.int64)
    ids_a, ids_b = [ids_a[k] for k in kept], [ids_b[k] for k in kept]
    a, b, doc_a, doc_b = flat(ids_a), flat(ids_b), starts(ids_a), starts(ids_b)
    # both sides of a text have the same bytes, so offsets can run on over all texts
    end_a, end_b = np.cumsum(_lengths(first, _first)[a]), np.cumsum(_lengths(second, _second)[b])
    place = np.searchsorted(end_b, end_a)
    cut_a = np.flatnonzero(end_b[place] == end_a) if len(a) else np.zeros(0, np.int64)
    return Aligned([docs[k] for k in kept], a, b, doc_a, doc_b, cut_a, place[cut_a], np.searchsorted(cut_a, doc_a))


def groups_text(x: Aligned, k: int) -> str:
    """The groups of the k-th text with tokens: ``a1,a2|b1;a3|b2,b3``."""
    a = list(map(str, x.a[x.doc_a[k]:x.doc_a[k + 1]].tolist()))
    b = list(map(str, x.b[x.doc_b[k]:x.doc_b[k + 1]].tolist()))
    out, i, j = [], 0, 0
    cuts = slice(x.doc_cut[k], x.doc_cut[k + 1])
    for p, q in zip((x.cut_a[cuts] - x.doc_a[k] + 1).tolist(), (x.cut_b[cuts] - x.doc_b[k] + 1).tolist(), strict=True):
        out.append(f"{a[i] if p == i + 1 else ','.join(a[i:p])}|{b[j] if q == j + 1 else ','.join(b[j:q])}")
        i, j = p, q
    return ";".join(out)


# ------------------------------------------------------------------ runs of blocks


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one block: the first, ascending, as differences."""
    key, *rest = columns
    deltas = np.diff(key, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.uint32(len(key)).tobytes(), deltas.tobytes(), *[c.tobytes() for c in rest]]))


def _unpack(payload: bytes, *types: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n, at, out = int(np.frombuffer(raw, np.uint32, 1)[0]), 4, []
    for t in (np.uint64, *types):
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order by second id, then first."""
    return (b.astype(np.uint64) << np.uint64(32)) | a.astype(np.uint64)


def _runs(key: np.ndarray) -> np.ndarray:
    """Where each stretch of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


ROW = "doc boolean, id long, row long, n_a long, n_b long, n_groups long, groups string, part int, run long, first long, records long, payload binary"


def _base(run: int) -> int:
    """The first row number of the task that wrote a run: blocks hold 32-bit numbers from there."""
    return run >> 33 << 33


def _spill(key: np.ndarray, row: np.ndarray, run: int, settings: Settings) -> Iterator[tuple]:
    """One run: records in order of (pair, row), equal ones counted, as blocks per partition."""
    order = np.argsort(key, kind="stable")  # rows ascend already
    key, row = key[order], row[order]
    at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]))
    times = np.diff(at, append=len(key)).astype(np.uint32)
    key, row = key[at], row[at]
    part = ((key >> np.uint64(32)) % np.uint64(settings.partitions)).astype(np.int64)
    for p in np.unique(part):
        mine = np.flatnonzero(part == p)
        for i in range(0, len(mine), settings.block_records):
            block = mine[i:i + settings.block_records]
            yield int(p), run, int(key[block[0]]), len(block), _pack(key[block], (row[block] - _base(run)).astype(np.uint32), times[block])


def _encoder(settings: Settings):
    schema = pa.schema([("doc", pa.bool_()), ("id", pa.int64()), ("row", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                        ("groups", pa.string()), ("part", pa.int32()), ("run", pa.int64()), ("first", pa.int64()), ("records", pa.int64()), ("payload", pa.binary())])

    def emit(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def blocks(keys: list, rows: list, run: int) -> Iterator[pa.RecordBatch]:
        for p, r, first, n, payload in _spill(np.concatenate(keys), np.concatenate(rows), run, settings):
            yield emit(doc=[False], part=[p], run=[r], first=[first], records=[n], payload=[payload])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        row, run, keys, rows, held = base, base, [], [], 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            # few texts at a time, by their size: tokens are lists of Python numbers
            for lo, hi in _slices(texts.is_valid().to_numpy(zero_copy_only=False) * _sizes(texts), 1 << 21):
                x = align(texts[lo:hi].to_pylist(), settings.first, settings.second)
                n_a, n_b, n_cut, groups = (np.zeros(hi - lo, np.int64) for _ in range(4))
                n_a[x.docs], n_b[x.docs], n_cut[x.docs] = np.diff(x.doc_a), np.diff(x.doc_b), np.diff(x.doc_cut)
                groups = [""] * (hi - lo)
                for k, i in enumerate(x.docs):
                    groups[i] = groups_text(x, k)
                yield emit(doc=[True] * (hi - lo), id=ids[lo:hi], row=np.arange(row, row + hi - lo), n_a=n_a, n_b=n_b, n_groups=n_cut, groups=groups)
                keys.append(_pair(x.a[x.cut_a], x.b[x.cut_b]))
                rows.append(np.repeat(np.array(x.docs, np.int64) + row, np.diff(x.doc_cut)))
                row, held = row + hi - lo, held + len(x.cut_a)
                if held >= settings.run_records:
                    yield from blocks(keys, rows, run)
                    run, keys, rows, held = run + 1, [], [], 0
        if held:
            yield from blocks(keys, rows, run)
    return encode


def _sizes(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours with at most ``most`` bytes together, or of one that is larger."""
    lo, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if len(sizes) > lo:
        yield lo, len(sizes)


# ------------------------------------------------------------------ merging


def _merged(blocks: Iterator[dict], gather: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    """Blocks in order of their first pair to (pair, row, times) in order of the pair.

    The heap has the open blocks by their next pair. All that lies before the first pair of the next block to come is
    complete: once ``gather`` records are open it is taken from them, and sorted. A pair always comes in one piece.
    """
    heap: list[tuple[int, int, list[np.ndarray]]] = []
    count = held = 0

    def upto(bound: int | None) -> list[np.ndarray] | None:
        taken = []
        while heap and (bound is None or heap[0][0] < bound):
            _, i, columns = heapq.heappop(heap)
            cut = len(columns[0]) if bound is None else int(np.searchsorted(columns[0], np.uint64(bound)))
            taken.append([c[:cut] for c in columns])
            if cut < len(columns[0]):
                rest = [c[cut:] for c in columns]
                heapq.heappush(heap, (int(rest[0][0]), i, rest))
        if not taken:
            return None
        columns = [np.concatenate(c) for c in zip(*taken, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        return [c[order] for c in columns]

    for r in blocks:
        if held >= gather and (done := upto(r["first"])) is not None:
            held -= len(done[0])
            yield done
        pair, row, times = _unpack(r["payload"], np.uint32, np.uint32)
        heapq.heappush(heap, (r["first"], count, [pair, row.astype(np.int64) + _base(r["run"]), times]))
        count, held = count + 1, held + len(pair)
    if (done := upto(None)) is not None:
        yield done


def _by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[dict]]]:
    """Rows in order of (part, task) as one stream per task."""
    stream = (r for batch in batches for r in batch.to_pylist())
    yield from groupby(stream, key=lambda r: (r["part"], r["task"]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to (pair, n): how many links of this task hold the pair."""
    for _, blocks in _by_task(batches):
        for key, _, times in _merged(blocks):
            at = _runs(key)
            yield pa.RecordBatch.from_arrays([pa.array(key[at].astype(np.int64)), pa.array(np.add.reduceat(times.astype(np.int64), at))], names=["pair", "n"])


def _pack_counts(settings: Settings):
    """(pair, n, best), in order of the pair, to blocks beside those of the runs."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, settings.block_records):
                b = batch.slice(i, settings.block_records)
                key = b.column(0).to_numpy().astype(np.uint64)
                part = ((key >> np.uint64(32)) % np.uint64(settings.partitions)).astype(np.int64)
                out = []
                for p in np.unique(part):
                    mine = np.flatnonzero(part == p)
                    out.append((int(p), int(key[mine[0]]), _pack(key[mine], b.column(1).to_numpy()[mine], b.column(2).to_numpy(zero_copy_only=False)[mine].astype(np.uint8))))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()),
                                                  pa.array([o[2] for o in out], pa.binary())], names=["part", "first", "payload"])
    return pack


def _contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of runs and of counts to (row, n_best, count_sum): what a document's records in this task are worth."""
    for _, blocks in _by_task(batches):
        rows, best, worth = [], [], []
        for steps in _beside(blocks):
            (key, row, times), (pair, n, top) = steps
            at = np.searchsorted(pair, key)
            rows.append(row)
            worth.append(times * n[at])
            best.append(times * top[at].astype(np.int64))
        if rows:
            row = np.concatenate(rows)
            order = np.argsort(row, kind="stable")
            at = _runs(row[order])
            yield pa.RecordBatch.from_arrays([pa.array(row[order][at]), pa.array(np.add.reduceat(np.concatenate(best)[order], at)),
                                              pa.array(np.add.reduceat(np.concatenate(worth)[order], at))], names=["row", "n_best", "count_sum"])


def _beside(blocks: Iterator[dict]) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """Merged records, each step with the counts of its pairs. Both kinds of block come in one stream, by first key."""
    counts: list[list[np.ndarray]] = []

    def records() -> Iterator[dict]:
        for r in blocks:
            if r["run"] is None:
                counts.append(_unpack(r["payload"], np.int64, np.uint8))
            else:
                yield r

    for step in _merged(records()):
        low = step[0][0]
        while len(counts) > 1 and counts[0][0][-1] < low:
            counts.pop(0)
        yield step, [np.concatenate(c) for c in zip(*counts, strict=True)]


# ------------------------------------------------------------------ the operator


def aligned_documents(docs: DataFrame, settings: Settings, keep: dict | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, *keep): one row per row of ``docs`` (doc_id, text).

    ``keep`` names columns made from ``groups``, the groups as ``a1,a2|b1;a3|b2,b3``, and the other columns so far;
    they alone are stored beside the numbers. Default: ``groups`` itself.

    ``n_links`` counts pairs of tokens that end together, ``count_sum`` adds up how many links of all
    documents have the same pair of ids, and ``n_best`` counts links whose pair is the most frequent of its second id, ties
    included. Texts that are null or empty, or that a tokenizer does not give back to the byte, have no tokens: zeros and
    empty groups. Repeated rows, also of one or of no doc_id, are documents of their own and all count. An empty table
    gives none. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text_batches(spark, 500)
    keep = {"groups": F.col("groups")} if keep is None else keep
    named = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    encoded = named.mapInArrow(_encoder(settings), ROW)
    stored = ["doc", "id", "row", "n_a", "n_b", "n_groups", *[e.alias(f"_keep{i}") for i, e in enumerate(keep.values())], "part", "run", "first", "records", "payload"]
    table = scratch.write(encoded.select(*stored), "runs")
    rows = table.filter("doc")
    blocks = table.filter("NOT doc").select("part", "run", "first", "records", "payload")
    # one number per partition: how many tasks its records are dealt to
    sizes = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("records").alias("n")).collect()}
    tasks = F.element_at(F.array(*[F.lit(-(-sizes.get(p, 1) // settings.task_records)) for p in range(settings.partitions)]), F.col("part") + 1)
    blocks = blocks.withColumn("task", F.pmod(F.hash("run"), tasks).cast("int"))
    ordered = lambda df: df.repartition("part", "task").sortWithinPartitions("part", "task", "first", F.col("run").isNotNull())
    partial = ordered(blocks).select("part", "task", "run", "first", "payload").mapInArrow(_count, "pair long, n long")
    counts = scratch.write(partial.groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    top = counts.groupBy(F.shiftright("pair", 32).alias("second")).agg(F.max("n").alias("best"))
    judged = (counts.withColumn("second", F.shiftright("pair", 32)).join(top, "second")
              .select("pair", "n", (F.col("n") == F.col("best")).alias("best")))
    packed = judged.repartitionByRange("pair").sortWithinPartitions("pair").mapInArrow(_pack_counts(settings), "part int, first long, payload binary")
    beside = packed.select("part", F.lit(None).cast("long").alias("run"), "first", "payload",
                           F.explode(F.sequence(F.lit(0), (tasks - 1).cast("int"))).alias("task"))
    both = ordered(blocks.select("part", "run", "first", "payload", "task").unionByName(beside)).select("part", "task", "run", "first", "payload")
    worth = (both.mapInArrow(_contribute, "row long, n_best long, count_sum long").groupBy("row")
             .agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    return rows.join(worth, "row", "left").select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")],
        *[F.col(f"_keep{i}").alias(name) for i, name in enumerate(keep)])
