"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Weights are learned by follow-the-regularised-leader with L1 and L2 penalties, one step per document and class, and
the scores are then calibrated with one temperature. N-grams are hashed to a fixed number of features. The term
frequency is an n-gram's share of all n-grams of the text, so a score is a mean of ``idf * weight`` over the text
and needs no table of counts per document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import text_batches

UNKNOWN = "und"
MOST_CLASSES = 2000
RESULT = "lang string, score double"
_PIECE = 1 << 18


@dataclass(frozen=True)
class Settings:
    """``fit_rows`` is the bound of the fitting sample (whole texts); a fifth of it calibrates the temperature."""

    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 16
    fit_rows: int = 4000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-5
    scale: float = 30.0
    seed: int = 7


@dataclass(frozen=True)
class Model:
    settings: Settings
    classes: tuple[str, ...]
    weights: np.ndarray  # features x classes, idf and scale included
    bias: np.ndarray
    temperature: float


def pieces(text: str, orders: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Hashed n-grams of the whole lower-cased text, in pieces of bounded size that overlap by the longest n-gram.

    A run of anything but letters counts as one blank, so digits and signs tell nothing.
    """
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters(codes)
    codes = np.where(letter, codes, np.uint32(0x20))
    keep = letter | np.concatenate(([True], letter[:-1]))  # the first blank of a run
    codes = codes[keep].astype(np.uint64)
    shift = np.uint64(64 - bits)
    for at in range(0, len(codes), _PIECE):
        stop = min(len(codes), at + _PIECE)
        for n in orders:
            last = min(stop, len(codes) - n + 1)
            if last <= at:
                continue
            h = codes[at:last].copy()
            for j in range(1, n):
                h *= np.uint64(0x100000001B3)
                h += codes[at + j:last + j]
            h += np.uint64(n * 0x632BE5AB)
            h *= np.uint64(0x9E3779B97F4A7C15)
            yield (h >> shift).astype(np.int64)


_LETTER_TABLE: np.ndarray | None = None


def _letters(codes: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter, by a table over all of Unicode made once per process."""
    global _LETTER_TABLE
    if _LETTER_TABLE is None:
        _LETTER_TABLE = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER_TABLE[codes]


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(_letters(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)).any())


def _counts(text: str, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(features, share of all n-grams) of one text."""
    total = np.zeros(1 << s.bits, np.int64)
    for h in pieces(text, s.orders, s.bits):
        total += np.bincount(h, minlength=1 << s.bits)
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] / max(1, total.sum())).astype(np.float32)


def document_frequencies(labelled: DataFrame, s: Settings) -> tuple[np.ndarray, int]:
    """Documents with each feature, over all labelled texts; one row of counts per task reaches the driver's sum."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(1 << s.bits, np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                if not has_letter(text):
                    continue
                here = np.zeros(1 << s.bits, bool)
                for h in pieces(text, s.orders, s.bits):
                    here[h] = True
                seen += here
                n += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"feature": np.concatenate(([-1], at)), "n": np.concatenate(([n], seen[at]))})

    rows = (labelled.select("text").mapInPandas(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
            .toPandas())
    df = np.zeros(1 << s.bits, np.int64)
    known = rows[rows["feature"] >= 0]
    df[known["feature"].to_numpy()] = known["n"].to_numpy()
    return df, int(rows.loc[rows["feature"] == -1, "n"].sum())


def ftrl(features: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and bias of a softmax model, learned per coordinate by FTRL-proximal."""
    d = 1 << s.bits
    z, n = np.zeros((d + 1, k)), np.zeros((d + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        za, na = z[at], n[at]
        w = -(za - np.sign(za) * s.l1) / ((s.beta + np.sqrt(na)) / s.alpha + s.l2)
        return np.where(np.abs(za) <= s.l1, 0.0, w)

    order = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for i in order.permutation(len(features)):
            at, x = features[i]
            w = weights(at)
            score = x @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(d + 1))
    return w[:d], w[d]


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section over its logarithm.

    Targets are smoothed by one case in as many as there are, so scores without an error do not become certain.
    """
    n, k = scores.shape
    target = np.full((n, k), 1.0 / (n + 2) / max(1, k - 1))
    target[np.arange(n), y] = 1.0 - 1.0 / (n + 2) if k > 1 else 1.0

    def loss(log_t: float) -> float:
        a = scores / math.exp(log_t)
        a = a - a.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(a).sum(axis=1)) - (a * target).sum(axis=1)))

    lo, hi, g = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def fit(labelled: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "lang") -> Model | None:
    """Learn from the rows with a label and a letter in the text; None if there are none.

    Document frequencies come from all of these rows. The weights are fitted on a sample of at most ``fit_rows``
    whole texts, the first in the order of the hash of the id within each class, in equal parts per class, so the
    fit costs the same at any size. With one class only, everything is that class.
    """
    s = settings
    text_batches(labelled.sparkSession)
    rows = (labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
            .filter("label IS NOT NULL AND text IS NOT NULL"))
    classes = [r["label"] for r in rows.select("label").distinct().orderBy("label").limit(MOST_CLASSES + 1).collect()]
    if not classes:
        return None
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"a model takes at most {MOST_CLASSES} labels")
    df, docs = document_frequencies(rows, s)
    if not docs:
        return None
    idf = np.log((1.0 + docs) / (1.0 + df)) + 1.0
    each = max(1, s.fit_rows // len(classes))
    sample = _sample(rows, each)
    features, y = [], []
    while sample:  # texts go as their features come
        text, label = sample.pop()
        if has_letter(text):
            at, share = _counts(text, s)
            features.append((np.append(at, np.int32(1 << s.bits)), np.append((share * idf[at] * s.scale).astype(np.float32), np.float32(1))))
            y.append(classes.index(label))
    y, classes = np.array(y, np.int64), tuple(classes)
    held = np.arange(len(y)) % 5 == 4
    learn = np.flatnonzero(~held) if held.any() else np.arange(len(y))
    w, bias = ftrl([features[i] for i in learn], y[learn], len(classes), s)
    scores = np.array([f[1][:-1] @ w[f[0][:-1]] + bias for f in (features[i] for i in np.flatnonzero(held))])
    t = temperature(scores, y[held]) if held.any() else 1.0
    return Model(s, classes, (w * idf[:, None] * s.scale).astype(np.float32), bias, t)


def _sample(rows: DataFrame, each: int) -> list[tuple[str, str]]:
    """The first ``each`` distinct texts of every class in hash order: keys first, then only their texts."""
    key = F.xxhash64("id", F.xxhash64("text"))
    first = Window.partitionBy("label").orderBy("key")
    tops = (rows.select("label", key.alias("key")).distinct().withColumn("n", F.row_number().over(first))
            .filter(F.col("n") <= each).groupBy("label").agg(F.max("key").alias("top")).collect())
    cut = F.lit(False)
    for r in tops:
        cut = cut | ((F.col("label") == r["label"]) & (key <= r["top"]))
    # rows with one key are copies; they are merged where they are read
    got = rows.filter(cut).groupBy(key.alias("key"), "label").agg(F.max("text").alias("text")).collect()
    return [(r["text"], r["label"]) for r in sorted(got, key=lambda r: (r["key"], r["label"]))]


def classify(model: Model | None, spark):
    """A column function: text -> struct ``(lang, score)``.

    ``lang`` is a learned label, or ``und`` with score 0 if the text is null or has no letter, or if nothing was
    learned. ``score`` is the calibrated probability of ``lang``. Whole texts count, of any length; ties go to the
    first label in order.
    """
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        out = []
        for text in texts:
            if m is None or not has_letter(text):
                out.append((UNKNOWN, 0.0))
                continue
            total, n = np.zeros(len(m.classes)), 0
            for h in pieces(text, m.settings.orders, m.settings.bits):
                total += m.weights[h].sum(axis=0, dtype=np.float64)
                n += len(h)
            a = (total / max(1, n) + m.bias) / m.temperature
            p = np.exp(a - a.max())
            p /= p.sum()
            best = int(p.argmax())
            out.append((m.classes[best], float(p[best])))
        return pd.DataFrame(out, columns=["lang", "score"])

    return predict


def in_training(id_col: Column) -> Column:
    """Rows that may be learned from: crc32 of the id as text, mod 4, is not 2. Rows without an id are not learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def held_out(id_col: Column) -> Column:
    """Rows kept for measuring: the remainder is 2; false without an id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, least: float = 0.35, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of at least ``least``; columns unchanged.

    Texts that are null or have no letter go. Where no row has a label, nothing can be told and no row stays.
    """
    model = fit(docs.filter(in_training(F.col("doc_id"))), settings)
    return docs.filter(classify(model, docs.sparkSession)(F.col("text"))["score"] >= least)
