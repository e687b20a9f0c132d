"""Queries of the probe models.

Fits on real features have no SQL. The ``*_cells`` queries run the same operators on features that are the cells of a
partition, where the fit has a closed form: a model that can tell the cells apart scores a row with its cell's share.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import features as X, grouped as G, links as K, metrics as M, probes as B, sampling as S
from ..scale import materialize, ranked
from . import adapters as A
from .registry import big, query, rounded, table

COLS = ["f_chars", "n_words", "distinct_ratio", "n_digits", "n_lines"]
FOLDS = 5
TREES = 100


def rows(spark, sf):
    return A.labelled(spark, sf).select(F.col("doc_id").alias("id"), "lang", "source", F.col("quality").alias("label"), *COLS)


def halves(spark, sf):
    split = materialize(S.stratified_split(rows(spark, sf), "label", 0.8, "42"))
    return split.filter("split = 'train'"), split.filter("split = 'test'")


@query("rf_probe")
def rf_probe(spark, sf):
    return rounded(B.rf_probe(*halves(spark, sf), COLS, TREES), "score").select("id", "label", "score")


@query("logreg_probe")
def logreg_probe(spark, sf):
    return rounded(B.logreg_probe(*halves(spark, sf), COLS), "score").select("id", "label", "score")


@query("logreg_probe_multinomial")
def logreg_probe_multinomial(spark, sf):
    wide = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"),
                                                 *[F.col("embedding")[i].alias(f"e{i}") for i in range(64)])
    out = B.logreg_probe(wide.filter("vec_id % 5 <> 0"), wide.filter("vec_id % 5 = 0"), [f"e{i}" for i in range(64)])
    return out.select("vec_id", "label", "prediction")


def folded(spark, sf):
    return S.group_kfold(rows(spark, sf), "source", FOLDS, "snake", "42")


def forest(train, test):
    return B.rf_probe(train, test, COLS, TREES)


@query("oof_scores")
def oof_scores(spark, sf):
    return rounded(B.oof_scores(folded(spark, sf), range(FOLDS), forest), "score").select("id", "fold", "label", "score")


@query("cv_probe")
def cv_probe(spark, sf):
    return rounded(B.cv_probe(folded(spark, sf), range(FOLDS), forest), "value", "mean", "std")


@query("feature_importance")
def feature_importance(spark, sf):
    train, test = halves(spark, sf)
    model = B.rf_probe(train, test, COLS, TREES, with_model=True)[1]
    return rounded(B.feature_importance(model, COLS, spark), "importance")


DROPS = {"size": ["f_chars", "n_words"], "lines": ["n_lines"]}


@query("feature_ablation")
def feature_ablation(spark, sf):
    train, test = halves(spark, sf)
    return rounded(G.ablation_logistic(train, test, COLS, DROPS), "value")


@query("oof_logistic")
def oof_logistic(spark, sf):
    return rounded(G.oof_logistic(folded(spark, sf), COLS), "score").select("id", "fold", "label", "score")


@query("cv_logistic")
def cv_logistic(spark, sf):
    return rounded(G.cv_logistic(folded(spark, sf), COLS), "value", "mean", "std")


@query("group_probe")
def group_probe(spark, sf):
    return rounded(B.group_probe(rows(spark, sf), "lang", "label", COLS, 20, "42"), "accuracy", "f1")


@query("group_probe_forest")
def group_probe_forest(spark, sf):
    return rounded(B.group_probe_forest(rows(spark, sf), "lang", "label", COLS, 20, "42", TREES), "accuracy", "f1")


@query("majority_baseline", """SELECT arg_min(label, (-n, label)) AS majority, round(max(n)::DOUBLE / sum(n), 6) AS accuracy
  FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)""")
def majority_baseline(spark, sf):
    return rounded(B.majority_baseline(table(spark, sf, "embeddings"), "label"), "accuracy")


@query("majority_from_label", """SELECT round(sum(best)::DOUBLE / sum(n), 6) AS accuracy, count(*) AS n_labels FROM (
    SELECT lang, max(n) AS best, sum(n) AS n FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang)""")
def majority_from_label(spark, sf):
    return rounded(B.majority_from_label(table(spark, sf, "documents"), "source", "lang"), "accuracy")


# Vectors of one label are a graph; neighbours by vec_id with a positive first component are its positives.
def link_graphs(spark, sf):
    vec = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("graph"), "vec_id", F.col("embedding").alias("vector"))
    index = materialize(ranked(vec, ["graph"], [F.col("vec_id")], "i", 0).drop("vec_id"))
    sizes = index.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    pos = index.filter(F.col("vector")[0] > 0).select("graph", "i", (F.col("i") + 1).alias("j"))
    return index, sizes, pos


@query("pair_link_probe")
def pair_link_probe(spark, sf):
    index, sizes, pos = link_graphs(spark, sf)
    pairs = materialize(S.negative_pair_sampling(sizes, pos, 3, "42"))
    candidates = K.link_candidates(sizes, 10, pairs, "43")
    return rounded(B.pair_link_probe(index, pairs, candidates, 64), "p", places=4)


LINKS_SQL = """WITH v AS (SELECT label::BIGINT AS graph, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding::DOUBLE[] AS x FROM embeddings),
  sizes AS (SELECT graph, count(*) AS n FROM v GROUP BY graph),
  t AS (SELECT graph, n, unnest(range(least(10 * n, n * (n - 1)))) AS t FROM sizes WHERE n >= 2),
  c AS (SELECT DISTINCT graph, ('0x' || substr(md5('43|' || graph || '|' || t || '|i'), 1, 8))::BIGINT % n AS i,
               ('0x' || substr(md5('43|' || graph || '|' || t || '|j'), 1, 8))::BIGINT % n AS j FROM t),
  u AS (SELECT c.* FROM c WHERE i <> j AND NOT EXISTS (SELECT 1 FROM v WHERE v.graph = c.graph AND v.i = c.i AND c.j = c.i + 1 AND v.x[1] > 0))"""


@query("link_candidates", f"{LINKS_SQL} SELECT graph, i, j FROM u")
def link_candidates(spark, sf):
    _, sizes, pos = link_graphs(spark, sf)
    return K.link_candidates(sizes, 10, pos, "43")


# A network with weights by rule: 4 hidden units, one output.
FIXED = K.PairNet(64, (
    (np.array([[((7 * o + 3 * k) % 11 - 5) / 10 for k in range(128)] for o in range(4)]), np.array([o / 10 for o in range(4)])),
    (np.array([[1.5, -2.0, 1.0, -0.5]]), np.array([0.25]))))


@query("pair_scores", f"""{LINKS_SQL},
  h AS (SELECT graph, i, list_transform(range(4), lambda o: list_dot_product(x, list_transform(range(64), lambda k: ((7 * o + 3 * k) % 11 - 5) / 10.0::DOUBLE))) AS l,
               list_transform(range(4), lambda o: list_dot_product(x, list_transform(range(64, 128), lambda k: ((7 * o + 3 * k) % 11 - 5) / 10.0::DOUBLE))) AS r FROM v),
  z AS (SELECT u.graph, u.i, u.j, list_transform(range(4), lambda o: 1 / (1 + exp(-(a.l[o + 1] + b.r[o + 1] + o / 10.0)))) AS z
        FROM u JOIN h a ON a.graph = u.graph AND a.i = u.i JOIN h b ON b.graph = u.graph AND b.i = u.j)
  SELECT graph, i, j, round(1 / (1 + exp(-(0.25 + 1.5 * z[1] - 2.0 * z[2] + z[3] - 0.5 * z[4]))), 6) AS p FROM z""")
def pair_scores(spark, sf):
    index, sizes, pos = link_graphs(spark, sf)
    return rounded(K.pair_scores(index, K.link_candidates(sizes, 10, pos, "43"), FIXED), "p")


# Cells are the remainders of the id by 3; parts are by 5, from another digit of the id's hash order.
CELLS = ["c1", "c2"]
CELL_SQL = """c AS (SELECT doc_id AS id, doc_id % 3 AS cell, (doc_id // 3) % 5 AS fold, quality::INT AS label FROM labels),
  n AS (SELECT f.fold, c.cell, count(*)::DOUBLE AS n, sum(c.label)::DOUBLE AS k FROM c, (SELECT DISTINCT fold FROM c) f
        WHERE c.fold <> f.fold GROUP BY ALL),
  s AS (SELECT c.id, c.fold, c.cell, c.label, k / n AS share FROM c JOIN n ON n.fold = c.fold AND n.cell = c.cell)"""


def cells(spark, sf):
    cell = F.col("doc_id") % 3
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), cell.cast("double").alias("cell"), (F.floor(F.col("doc_id") / 3) % 5).alias("fold"),
        (cell == 1).cast("double").alias("c1"), (cell == 2).cast("double").alias("c2"), F.lit(0.0).alias("flat"),
        F.col("quality").cast("int").alias("label"))


def share_of_cell(train, test):
    return B.logreg_probe(train, test, CELLS)


def parts(spark, sf):
    rows = materialize(cells(spark, sf))
    return rows.filter("fold <> 0"), rows.filter("fold = 0")


@query("logreg_probe_cells", f"WITH {CELL_SQL} SELECT id, label, round(share, 3) AS score FROM s WHERE fold = 0")
def logreg_probe_cells(spark, sf):
    return rounded(share_of_cell(*parts(spark, sf)), "score", places=3).select("id", "label", "score")


@query("oof_scores_cells", f"WITH {CELL_SQL} SELECT id, fold, label, round(share, 3) AS score FROM s")
def oof_scores_cells(spark, sf):
    return rounded(B.oof_scores(cells(spark, sf), range(5), share_of_cell), "score", places=3).select("id", "fold", "label", "score")


CV_CELLS_SQL = f"""WITH {CELL_SQL}, per AS (SELECT p.fold, avg(CASE WHEN p.share > q.share THEN 1.0 WHEN p.share = q.share THEN 0.5 ELSE 0.0 END) AS value
    FROM s p JOIN s q ON p.fold = q.fold WHERE p.label = 1 AND q.label = 0 GROUP BY p.fold)
  SELECT fold, round(value, 6) AS value, round(avg(value) OVER (), 6) AS mean, round(stddev_pop(value) OVER (), 6) AS std FROM per"""


@query("cv_probe_cells", CV_CELLS_SQL)
def cv_probe_cells(spark, sf):
    return rounded(B.cv_probe(cells(spark, sf), range(5), share_of_cell), "value", "mean", "std")


@query("feature_ablation_cells", f"""WITH {CELL_SQL},
  m AS (SELECT 'none' AS dropped, label, cell = 1 AS a, cell = 2 AS b FROM c UNION ALL SELECT 'second', label, cell = 1, false FROM c
        UNION ALL SELECT 'all', label, false, false FROM c),
  t AS (SELECT dropped, label, avg(label) OVER (PARTITION BY dropped, a, b) AS share FROM m)
  SELECT p.dropped, round(avg(CASE WHEN p.share > q.share THEN 1.0 WHEN p.share = q.share THEN 0.5 ELSE 0.0 END), 6) AS value
  FROM t p JOIN t q ON p.dropped = q.dropped WHERE p.label = 1 AND q.label = 0 GROUP BY p.dropped""")
def feature_ablation_cells(spark, sf):
    data = materialize(cells(spark, sf))

    def fit(df, cols):
        scored = B.logreg_probe(df, df, cols)
        return M.roc_auc(scored, []).select(F.col("auc").alias("value"))
    return rounded(X.feature_ablation(data, [*CELLS, "flat"], CELL_DROPS, fit), "value")


CELL_DROPS = {"second": ["c2"], "all": ["c1", "c2"]}


@query("ablation_logistic_cells", f"""WITH {CELL_SQL},
  m AS (SELECT 'none' AS dropped, label, cell = 1 AS a, cell = 2 AS b FROM c UNION ALL SELECT 'second', label, cell = 1, false FROM c
        UNION ALL SELECT 'all', label, false, false FROM c),
  t AS (SELECT dropped, label, avg(label) OVER (PARTITION BY dropped, a, b) AS share FROM m)
  SELECT p.dropped, round(avg(CASE WHEN p.share > q.share THEN 1.0 WHEN p.share = q.share THEN 0.5 ELSE 0.0 END), 6) AS value
  FROM t p JOIN t q ON p.dropped = q.dropped WHERE p.label = 1 AND q.label = 0 GROUP BY p.dropped""")
def ablation_logistic_cells(spark, sf):
    data = materialize(cells(spark, sf))
    return rounded(G.ablation_logistic(data, data, [*CELLS, "flat"], CELL_DROPS), "value")


@query("oof_logistic_cells", f"WITH {CELL_SQL} SELECT id, fold, label, round(share, 5) AS score FROM s")
def oof_logistic_cells(spark, sf):
    return rounded(G.oof_logistic(cells(spark, sf), [*CELLS, "flat"]), "score", places=5).select("id", "fold", "label", "score")


@query("cv_logistic_cells", CV_CELLS_SQL)
def cv_logistic_cells(spark, sf):
    # equal cells have to tie as they do in the shares, whatever the last bits of a fit are
    scored = rounded(G.oof_logistic(cells(spark, sf), CELLS), "score", places=9)
    per = M.roc_auc(scored.select("fold", "label", "score"), ["fold"]).select("fold", F.col("auc").alias("value"))
    stats = per.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return rounded(per.withColumns({c: stats.select(c).scalar() for c in ("mean", "std")}), "value", "mean", "std")


# The drawing of balance_per_group, the split of stratified_split inside each language, and the share of each cell.
@query("group_probe_cells", """WITH dl AS (SELECT d.doc_id AS id, lang, quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
  neg AS (SELECT id, row_number() OVER (ORDER BY md5('42|' || id), id) AS r FROM (SELECT DISTINCT id FROM dl WHERE quality = 0)),
  pos AS (SELECT lang, id, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || lang || '|' || id), id) AS r FROM dl WHERE quality = 1),
  sizes AS (SELECT lang, least(count(*), (SELECT count(*) FROM neg)) AS n FROM pos GROUP BY lang HAVING n >= 20),
  picked AS (SELECT lang, id, 1 AS label FROM pos JOIN sizes USING (lang) WHERE r <= n UNION ALL SELECT lang, id, 0 FROM sizes JOIN neg ON r <= n),
  sp AS (SELECT *, row_number() OVER (PARTITION BY lang, label ORDER BY md5('42|' || id), id)
           <= round(count(*) OVER (PARTITION BY lang, label) * 0.8::DOUBLE) AS train FROM picked),
  share AS (SELECT lang, id % 3 AS cell, avg(label) AS p FROM sp WHERE train GROUP BY ALL),
  t AS (SELECT sp.lang, label, (round(p, 6) > 0.5)::INT AS pred FROM sp JOIN share ON share.lang = sp.lang AND cell = id % 3 WHERE NOT train)
  SELECT lang, round(avg((pred = label)::INT), 6) AS accuracy,
         round(coalesce(2.0 * sum(pred * label) / nullif(sum(pred) + sum(label), 0), 0), 6) AS f1, count(*) AS n_test,
         CASE WHEN avg((pred = label)::INT) < 0.65 THEN 'weak' WHEN avg((pred = label)::INT) > 0.85 THEN 'strong' ELSE 'fair' END AS verdict
  FROM t GROUP BY lang""")
def group_probe_cells(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    return rounded(B.group_probe(cells(spark, sf).join(docs, "id"), "lang", "label", CELLS, 20, "42"), "accuracy", "f1")



# A tree weighs the classes alike, so a cell's score is its share after weighting. Leaves side by side that name the same
# class are merged, so the label here is one that neighbouring cells decide differently.
@query("rf_probe_cells", """WITH c AS (SELECT doc_id AS id, doc_id % 3 AS cell, (doc_id // 3) % 5 AS fold, ((doc_id % 3 = 1) = (quality = 1))::INT AS label FROM labels),
  w AS (SELECT label, (SELECT count(*) FROM c WHERE fold <> 0)::DOUBLE / 2 / count(*) AS w FROM c WHERE fold <> 0 GROUP BY label),
  p AS (SELECT cell, sum(w * label) / sum(w) AS share FROM c JOIN w USING (label) WHERE fold <> 0 GROUP BY cell)
  SELECT id, label, round(share, 6) AS score FROM c JOIN p USING (cell) WHERE fold = 0""")
def rf_probe_cells(spark, sf):
    train, test = (d.withColumn("label", ((F.col("c1") == 1) == (F.col("label") == 1)).cast("int")) for d in parts(spark, sf))
    return rounded(B.rf_probe(train, test, ["cell"], 1, bootstrap=False), "score").select("id", "label", "score")


@query("feature_importance_cells", "SELECT 1 AS rank, 'cell' AS feature, 1.0::DOUBLE AS importance UNION ALL SELECT 2, 'flat', 0.0")
def feature_importance_cells(spark, sf):
    train, test = parts(spark, sf)
    model = B.rf_probe(train, test, ["flat", "cell"], TREES, with_model=True)[1]
    return rounded(B.feature_importance(model, ["flat", "cell"], spark), "importance")
