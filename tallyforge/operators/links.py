"""Scores of node pairs by a small network whose first layer is split into two halves.

On the concatenation of two vectors the first layer is ``Wa a + Wb b + bias``. Both products are taken once per node, and a
pair only adds them: a node in many pairs costs its multiplications once, and what travels with a pair is two short
vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.order import hash_index
from ..scale import keyed_join, materialize, plan_bytes, setting


@dataclass(frozen=True)
class PairNet:
    """A network on two vectors of ``dim`` numbers: layers of (weights out x in, bias), sigmoid between them.

    The first layer takes ``2 * dim`` numbers. The last gives one number, the logit of a link, or two, the logits of no
    link and of a link.
    """

    dim: int
    layers: tuple[tuple[np.ndarray, np.ndarray], ...]

    @classmethod
    def of(cls, model) -> PairNet:
        """The weights of a fitted ``MultilayerPerceptronClassificationModel``: per layer a matrix by columns, then the bias."""
        sizes, flat, at, layers = [int(n) for n in model.getLayers()], model.weights.toArray(), 0, []
        for n_in, n_out in zip(sizes, sizes[1:]):
            w = flat[at:at + n_in * n_out].reshape(n_in, n_out).T
            at += n_in * n_out
            layers.append((w, flat[at:at + n_out]))
            at += n_out
        return cls(sizes[0] // 2, tuple(layers))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _rows(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def halves(vectors: DataFrame, net: PairNet) -> DataFrame:
    """(graph, i, left, right): what a node adds to the first layer as the first and as the second of a pair.

    Vectors that are null, of another length, or hold nulls or numbers that are not finite take no part.
    """
    weights, _ = net.layers[0]
    left, right = weights[:, :net.dim].T.copy(), weights[:, net.dim:].T.copy()

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                x = _rows(df.pop("x"))
                yield df.assign(left=list(x @ left), right=list(x @ right))
    x = F.col("vector").cast("array<double>")
    usable = (F.size(x) == net.dim) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = vectors.filter(F.coalesce(usable, F.lit(False))).select("graph", "i", x.alias("x"))
    kinds = dict(rows.dtypes)
    return rows.mapInPandas(multiply, f"graph {kinds['graph']}, i {kinds['i']}, left array<double>, right array<double>")


def pair_scores(vectors: DataFrame, pairs: DataFrame, net: PairNet) -> DataFrame:
    """``pairs`` (graph, i, j, ...) with ``p``, the network's probability of a link.

    ``vectors`` is (graph, i, vector), one row per node; pairs with a node that has no usable vector are left out.
    """
    parts = materialize(halves(vectors, net))
    bias, rest = net.layers[0][1], net.layers[1:]

    @F.pandas_udf("double")
    def finish(left: pd.Series, right: pd.Series) -> pd.Series:
        x = _rows(left) + _rows(right) + bias if len(left) else np.zeros((0, len(bias)))
        for w, b in rest:
            x = _sigmoid(x) @ w.T + b
        return pd.Series(_sigmoid(x[:, -1] - x[:, 0] if x.shape[1] == 2 else x[:, 0]))

    first = parts.select("graph", "i", F.col("left").alias("_left"))
    second = parts.select("graph", F.col("i").alias("j"), F.col("right").alias("_right"))
    met = keyed_join(keyed_join(pairs, first, ["graph", "i"]), second, ["graph", "j"])
    return met.select(*pairs.columns, finish("_left", "_right").alias("p"))


def link_candidates(sizes: DataFrame, per_node: int, labelled: DataFrame | None = None, seed: str = "0") -> DataFrame:
    """(graph, i, j): node pairs to be judged, ``per_node`` numbered hash draws for each node of a graph, each pair once.

    ``sizes`` is (graph, n); no graph draws more often than it has pairs. Draws of a node with itself and pairs of
    ``labelled`` (graph, i, j) are left out. Draws are expanded in chunks, so one large graph is spread over tasks.
    """
    chunk = 100_000
    draws = F.least(F.col("n") * per_node, F.col("n") * (F.col("n") - 1))
    chunks = sizes.filter(F.col("n") >= 2).withColumn("_k", draws).withColumn("_c", F.explode(F.sequence(F.lit(0), F.floor((F.col("_k") - 1) / chunk))))
    if plan_bytes(sizes) > setting(sizes, "tallyforge.smallBytes"):
        chunks = chunks.repartition("graph", "_c")
    tries = chunks.withColumn("t", F.explode(F.sequence(F.col("_c") * chunk, F.least(F.col("_k"), (F.col("_c") + 1) * chunk) - 1)))
    pairs = tries.select("graph", *[hash_index(seed, F.col("n"), "graph", "t", F.lit(side)).alias(side) for side in ("i", "j")])
    pairs = pairs.filter("i <> j").distinct()
    return pairs if labelled is None else pairs.join(labelled.select("graph", "i", "j"), ["graph", "i", "j"], "left_anti")
