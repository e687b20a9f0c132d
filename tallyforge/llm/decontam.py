"""Benchmark decontamination: one Aho-Corasick automaton over all windows of the test items, one scan of each text."""

from __future__ import annotations

import hashlib

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import text_batches

#: Bytes that belong to a word after lower-casing: digits, a-z, and every byte of a sign beyond ASCII.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
               for b in range(256))
RESULT = ("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, "
          "spans array<struct<start:int,stop:int>>")


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8; other ASCII signs separate them."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Windows:
    """The automaton, and which items each of its patterns stands for."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int) -> None:
        import ahocorasick
        owners: dict[tuple[bytes, ...], set[str | None]] = {}
        for item, text in items:
            words = normal_words(text)
            for i in range(max(1, len(words) - size + 1) if words else 0):
                owners.setdefault(tuple(words[i:i + size]), set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for words, named in owners.items():
            # a blank on both sides: whole words only; latin-1 keeps one sign per byte
            self.automaton.add_word(f" {b' '.join(words).decode('latin-1')} ", (len(words), frozenset(named)))
        self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str | None]]:
        """Which words lie inside an occurrence, and the items that occur."""
        hit, found = np.zeros(len(words), bool), set()
        if self.empty or not words:
            return hit, found
        line = f" {b' '.join(words).decode('latin-1')} "
        matches = list(self.automaton.iter(line))
        if matches:
            blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
            lasts = np.searchsorted(blanks, [end for end, _ in matches])
            for stop, (_, (n, named)) in zip(lasts, matches):
                hit[stop - n:stop] = True
                found |= named
        return hit, found


@lru_cache(maxsize=2)
def _windows(items: tuple, size: int) -> Windows:
    return Windows(list(items), size)


def original_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) in characters of the original text for each run of hit words."""
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(raw.translate(_TABLE), np.uint8) != 0x20
    edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    runs = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    first, last = np.flatnonzero(runs == 1), np.flatnonzero(runs == -1) - 1
    # bytes to characters: a character begins at every byte that does not continue one
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(chars[starts[a]]), int(chars[stops[b]])) for a, b in zip(first, last)]


def bounded_items(items: DataFrame, item_col: str, text_col: str, most_bytes: int) -> list[tuple[str | None, str | None]]:
    """All test items, after a check that they fit in every executor's memory."""
    chosen = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).distinct()
    size = chosen.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"the test items hold {size} bytes; one automaton takes at most {most_bytes}")
    return sorted((tuple(r) for r in chosen.collect()), key=repr)


def contamination(items: DataFrame, size: int = 13, share: int = 20, item_col: str = "item_id",
                  item_text_col: str = "text", most_bytes: int = 64 << 20):
    """A column function: text -> struct with ``RESULT``.

    A window is ``size`` consecutive words of an item, or the whole item if that is shorter; an item without words
    has none. A word is hit inside any occurrence of a window. ``n_items`` and ``items`` name the items with an
    occurring window, ``items_sha256`` is the digest of their ids, sorted as strings and joined with commas.
    ``contaminated``: some word is hit and ``share * n_hit >= n_words``. ``spans`` are the runs of hit words in
    characters of the original text.

    Null and empty texts have no words and are clean. Items with equal id count once; one without id hits words but
    has no name. Test items are bounded: above ``most_bytes`` bytes of text this raises.
    """
    text_batches(items.sparkSession)
    sc = items.sparkSession.sparkContext
    shared = sc.broadcast(tuple(bounded_items(items, item_col, item_text_col, most_bytes)))

    @F.pandas_udf(RESULT)
    def judge(texts: pd.Series) -> pd.DataFrame:
        windows = _windows(shared.value, size)
        rows = []
        for text in texts:
            words = normal_words(text)
            hit, found = windows.scan(words)
            n_hit = int(hit.sum())
            named = sorted(x for x in found if x is not None)
            rows.append((len(words), n_hit, len(named), hashlib.sha256(",".join(named).encode()).hexdigest(),
                         n_hit > 0 and share * n_hit >= len(words), named,
                         [{"start": a, "stop": b} for a, b in original_spans(text, hit)] if n_hit else []))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])

    return judge


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns unchanged."""
    judge = contamination(items, **options)
    return docs.filter(~judge(F.col(text_col))["contaminated"])
