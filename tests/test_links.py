"""Pair scores by halves equal the whole network; candidates are what the draws say."""

import math
import random

import numpy as np
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tallyforge.operators import links as K, probes as B


def graphs(spark, seed=3, dim=6):
    rnd = random.Random(seed)
    rows = [(g, i, [rnd.gauss(0, 1) for _ in range(dim)]) for g in range(3) for i in range(25)]
    return rows, spark.createDataFrame(rows, "graph long, i long, vector array<double>")


def test_halves_equal_the_fitted_network(spark):
    rows, vectors = graphs(spark)
    x = {(g, i): v for g, i, v in rows}
    pairs = spark.createDataFrame([(g, i, (i + d) % 25, int(x[g, i][0] + x[g, (i + d) % 25][1] > 0)) for g in range(3) for i in range(25) for d in (1, 2, 7)],
                                  "graph long, i long, j long, label int")
    wide = spark.createDataFrame([(g, i, j, x[g, i] + x[g, j], y) for g, i, j, y in map(tuple, pairs.collect())], "graph long, i long, j long, x array<double>, label int")
    data = wide.withColumn("features", array_to_vector("x"))
    model = MultilayerPerceptronClassifier(layers=[12, 6, 3, 2], seed=1, maxIter=15).fit(data)
    want = {(r["graph"], r["i"], r["j"]): r["p"] for r in model.transform(data).withColumn("p", vector_to_array("probability")[1]).collect()}
    got = K.pair_scores(vectors, pairs, K.PairNet.of(model)).collect()
    assert len(got) == len(want) and all(abs(r["p"] - want[r["graph"], r["i"], r["j"]]) < 1e-9 for r in got)


def test_pairs_outside_the_training_set_are_scored(spark):
    rows, vectors = graphs(spark)
    x = {(g, i): v for g, i, v in rows}
    label = lambda g, i, j: int(x[g, i][0] + x[g, j][1] > 0)
    train = [(g, i, j, label(g, i, j)) for g in range(3) for i in range(25) for j in range(25) if i != j and (i + j) % 3]
    pairs = spark.createDataFrame(train, "graph long, i long, j long, label int")
    sizes = spark.createDataFrame([(g, 25) for g in range(3)], "graph long, n long")
    candidates = K.link_candidates(sizes, 8, pairs, "9")
    held = {tuple(r) for r in candidates.collect()}
    assert held and not held & {t[:3] for t in train}
    found = B.pair_link_probe(vectors, pairs, candidates, 6, iterations=60)
    links = {(r["graph"], r["i"], r["j"]) for r in found.collect()}
    assert links <= held and np.mean([((g, i, j) in links) == label(g, i, j) for g, i, j in held]) > 0.85
    best = B.pair_link_probe(vectors, pairs, candidates, 6, max_pairs=2, iterations=60).collect()
    assert len(best) == 6 and {(r["graph"], r["i"], r["j"]) for r in best} <= links


def test_odd_vectors_and_empty_tables(spark):
    net = K.PairNet(2, ((np.array([[1.0, 0.0, 0.0, 1.0]]), np.array([0.5])), (np.array([[2.0]]), np.array([-1.0]))))
    vectors = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0]), (1, 2, None), (1, 3, [1.0]), (1, 4, [float("nan"), 0.0]), (1, 5, [None, 1.0])],
                                    "graph long, i long, vector array<double>")
    pairs = spark.createDataFrame([(1, 0, j, "kept") for j in range(7)], "graph long, i long, j long, tag string")
    got = {r["j"]: (r["tag"], r["p"]) for r in K.pair_scores(vectors, pairs, net).collect()}
    sig = lambda v: 1 / (1 + math.exp(-v))
    assert set(got) == {0, 1} and all(tag == "kept" for tag, _ in got.values())
    assert abs(got[1][1] - sig(2 * sig(1 + 4 + 0.5) - 1)) < 1e-12
    assert K.pair_scores(vectors, pairs.limit(0), net).count() == 0 and K.pair_scores(vectors.limit(0), pairs, net).count() == 0
    sizes = spark.createDataFrame([(1, 1), (2, 2), (3, 0)], "graph long, n long")
    assert {(r["graph"], r["i"], r["j"]) for r in K.link_candidates(sizes, 50).collect()} <= {(2, 0, 1), (2, 1, 0)}


def test_draws_are_spread(tight):
    sizes = tight.createDataFrame([(1, 40)], "graph long, n long")
    pairs = K.link_candidates(sizes, 20)
    assert pairs.count() == pairs.distinct().count() > 500 and pairs.filter(F.col("i") == F.col("j")).count() == 0
