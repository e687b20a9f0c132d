"""Nearest neighbours by inner product with randomly rotated one-bit codes and error bounds.

A vector is turned by a random rotation and kept as the signs of its coordinates, one bit each, with two scalars:
its length, and how well the signs stand for it (the inner product of the unit vector with its code). From these
the inner product with a query is estimated, with an error bound that holds with a probability set by ``epsilon``.
Only vectors whose upper bound reaches the best exact values so far are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

MOST_TASKS = 50_000
CHUNK = 4096
FOUND = "query_id long, dim int, query_block int, query_row int, times long, vec_id long, score double, copies long"
BLOCK = "dim int, block int, ids binary, known binary, copies binary, vectors binary, codes binary, scalars binary"


@dataclass(frozen=True)
class Settings:
    """``epsilon`` widens the error bound; block sizes bound what a task holds at a time."""

    k: int = 20
    epsilon: float = 4.0
    seed: int = 11
    rows_per_block: int = 8192
    queries_per_block: int = 2048


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths of the rows, without overflow of the squares."""
    most = np.abs(vectors).max(axis=1, initial=0.0)
    return most * np.linalg.norm(vectors / np.where(most > 0, most, 1.0)[:, None], axis=1)


def encode(vectors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, [length, agreement] per vector) of the rows of a float64 matrix."""
    dim = vectors.shape[1]
    length = lengths(vectors)
    turned = (vectors / length[:, None]) @ rotation(dim, seed)
    agreement = np.abs(turned).sum(axis=1) / np.sqrt(dim)
    return np.packbits(turned >= 0, axis=1), np.stack([length, agreement], axis=1)


def estimate(codes: np.ndarray, scalars: np.ndarray, queries: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products, their error bounds), queries x vectors, from bits and scalars only."""
    dim = queries.shape[1]
    turned = (queries @ rotation(dim, settings.seed)).astype(np.float32)
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    length, agreement = scalars[:, 0], scalars[:, 1]
    found = turned @ signs.T
    found *= (length / (agreement * np.sqrt(dim))).astype(np.float32)
    spread = length * np.sqrt(np.maximum(0.0, 1 - agreement**2)) / agreement * settings.epsilon / np.sqrt(max(1, dim - 1))
    return found, (np.linalg.norm(queries, axis=1)[:, None] * spread[None, :]).astype(np.float32)


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the dimensions, whatever the row's place."""
    total = np.zeros(len(vectors))
    for d in range(len(query)):
        total += vectors[:, d] * query[d]
    return total


def search_block(ids: np.ndarray, known: np.ndarray, copies: np.ndarray, vectors: np.ndarray, codes: np.ndarray,
                 scalars: np.ndarray, query_ids: np.ndarray, query_known: np.ndarray, queries: np.ndarray,
                 settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, scores, copies) per query: the best rows of a block by bounds and reranking, ``k`` of them or more than all.

    A query's own row is one copy of the row with its id and its vector; further copies stay candidates.
    """
    k = settings.k
    # bounds and first sums are in units of the longest vector and of the query's length: single precision will do
    longest = scalars[:, 0].max(initial=0.0) or 1.0
    light = (vectors / longest).astype(np.float32)
    scalars = scalars / np.array([longest, 1.0])
    units = queries / lengths(queries)[:, None]
    slack = 2e-5
    for at in range(0, len(queries), 256):
        part = queries[at:at + 256]
        found, bound = estimate(codes, scalars, units[at:at + 256], settings)
        for i, query in enumerate(part):
            unit = units[at + i].astype(np.float32)
            same = np.flatnonzero((ids == query_ids[at + i]) & (known == query_known[at + i]))
            own = same[(vectors[same] == query).all(axis=1)]  # one row at most: rows are distinct
            left = copies.copy()
            left[own] -= 1
            gone = left == 0
            guess, upper = found[i], found[i] + bound[i]
            guess[gone], upper[gone] = -np.inf, -np.inf
            others = len(ids) - int(gone.sum())
            if others <= 8 * k:
                chosen = np.flatnonzero(~gone)
            else:
                likely = np.argpartition(-guess, 4 * k)[:4 * k]
                near = light[likely] @ unit
                least = np.partition(near, -k)[-k]  # k vectors reach this, so an upper bound below it is out
                upper[likely] = np.inf
                chosen = np.flatnonzero(upper >= least - slack)
            near = light[chosen] @ unit
            if len(chosen) > k:  # single precision and a margin for its rounding; then the defined sum decides
                chosen = chosen[near >= np.partition(near, -k)[-k] - slack]
            score = exact(vectors[chosen], query)
            best = np.lexsort((ids[chosen], ~known[chosen], -score))[:k]
            yield chosen[best], score[best], left[chosen[best]]


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, copies, dim): the distinct finite, non-zero rows and how often each occurs."""
    v = F.col("v")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .filter(v.isNotNull()).filter(fine)
            .groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("v")))


def _blocks(rows: DataFrame, count: int, settings: Settings) -> DataFrame:
    """Distinct rows dealt by their hash to ``count`` blocks per dimension, each one row of packed arrays in a fixed order."""
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf["known"].to_numpy(bool)
        ids = pdf["id"].to_numpy(np.int64)
        matrix = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        order = np.lexsort((*matrix.T[::-1], ids, ~known))  # a task that runs again numbers its rows alike
        known, ids, matrix = known[order], ids[order], matrix[order]
        codes, scalars = encode(matrix, settings.seed)
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "ids": [ids.tobytes()], "known": [known.tobytes()],
                             "copies": [pdf["copies"].to_numpy(np.int64)[order].tobytes()], "vectors": [matrix.tobytes()],
                             "codes": [codes.tobytes()], "scalars": [scalars.tobytes()]})

    return (rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(count)).cast("int"))
            .select("dim", "block", F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().alias("known"), "v", "copies")
            .groupBy("dim", "block").applyInPandas(pack, BLOCK))


def nearest(vectors: DataFrame, queries: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest inner products, ties to the smaller id.

    All vectors are indexed, and each query meets every block of the index once; no pair of rows is ever formed in
    Spark. Blocks of queries and blocks of vectors are bounded, and a block pair returns at most ``k`` rows per query.
    Scores are exact, on the vectors as given. A vector is missed only if its error bound fails, the rarer the
    larger ``epsilon`` is.

    Vectors that are null, empty, zero or hold a null or a non-finite component take no part. Every other row does,
    repeated rows and repeated ids included, but for the query's own row; rows without id are candidates whose
    ``vec_id`` is null, last among ties. Equal rows are searched once and counted. A query row that is repeated has its
    neighbours repeated; several rows of ``queries`` with one id are queries of their own. Vectors of another length
    than the query's are no candidates. A query with fewer than ``k`` candidates gets them all. Empty tables give an
    empty result; further columns are ignored.
    """
    rows, asked = _usable(vectors, id_col, vector_col), _usable(queries, id_col, vector_col)
    n_rows = vectors.count()
    n_asked = queries.count()
    row_blocks = max(1, -(-n_rows // settings.rows_per_block))
    query_blocks = max(1, -(-n_asked // settings.queries_per_block))
    index = _blocks(rows, row_blocks, settings)
    wanted = (_blocks(asked, query_blocks, settings)
              .select("dim", F.col("block").alias("query_block"), *[F.col(c).alias(f"query_{c}") for c in ("ids", "known", "copies", "vectors")]))
    # every block of vectors meets every block of queries of its dimension
    left = index.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = wanted.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                dim, ids, known = int(r.dim), np.frombuffer(r.ids, np.int64), np.frombuffer(r.known, bool)
                copies = np.frombuffer(r.copies, np.int64)
                matrix = np.frombuffer(r.vectors, np.float64).reshape(-1, dim)
                codes = np.frombuffer(r.codes, np.uint8).reshape(len(ids), -1)
                scalars = np.frombuffer(r.scalars, np.float64).reshape(-1, 2)
                q_ids, q_known = np.frombuffer(r.query_ids, np.int64), np.frombuffer(r.query_known, bool)
                q_copies = np.frombuffer(r.query_copies, np.int64)
                q = np.frombuffer(r.query_vectors, np.float64).reshape(-1, dim)
                found = list(search_block(ids, known, copies, matrix, codes, scalars, q_ids, q_known, q, settings))
                row = np.repeat(np.arange(len(q)), [len(x[0]) for x in found])
                hits = np.concatenate([x[0] for x in found])
                yield pd.DataFrame({"query_id": pd.arrays.IntegerArray(q_ids[row], ~q_known[row]), "dim": np.full(len(row), dim, np.int32),
                                    "query_block": np.full(len(row), r.query_block, np.int32), "query_row": row.astype(np.int32), "times": q_copies[row],
                                    "vec_id": pd.arrays.IntegerArray(ids[hits], ~known[hits]),
                                    "score": np.concatenate([x[1] for x in found]), "copies": np.concatenate([x[2] for x in found])})

    on = ["dim", "block", "query_block"]
    tasks = min(row_blocks * query_blocks, MOST_TASKS)  # a pair of blocks is megabytes: few to a task
    pairs = left.repartition(tasks, *on).join(right.repartition(tasks, *on).hint("shuffle_hash"), on)
    found = pairs.mapInPandas(search, FOUND)
    # a row with copies fills as many ranks; a query with copies is answered as often, in chunks of bounded arrays
    best = Window.partitionBy("dim", "query_block", "query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    before = F.coalesce(F.sum("copies").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = (found.withColumn("before", before).filter(F.col("before") < settings.k)
              .withColumn("rank", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("copies"), F.lit(settings.k))))))
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / CHUNK)))
    answered = (ranked.withColumn("chunk", chunk)
                .withColumn("time", F.explode(F.sequence(F.lit(1), F.least(F.lit(CHUNK), F.col("times") - F.col("chunk") * CHUNK)))))
    return answered.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
