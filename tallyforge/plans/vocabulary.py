"""Queries of vocabulary and token operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vocab as V
from ..scale import materialize
from . import adapters as A
from .registry import big, query, rounded, table

D = A.DOC_NODES_SQL
VOCAB = """SELECT '<UNK>' AS token, 0 AS id UNION ALL
  SELECT token, row_number() OVER (ORDER BY n DESC, token) AS id FROM (
    SELECT token, count(*) AS n FROM {rows} GROUP BY token HAVING count(*) >= {least})"""
HALF = "sample IN (SELECT doc_id FROM labels)"


@query("build_vocab", f"WITH {D}, v AS ({VOCAB.format(rows='dnodes', least=2)}) SELECT * FROM v WHERE id < 2000")
def build_vocab(spark, sf):
    return V.build_vocab(A.document_nodes(spark, sf), 2, 2000)


def half_vocab(spark, sf):
    """Vocabulary of the training documents, those that have a label."""
    train = table(spark, sf, "labels").select(F.col("doc_id").alias("sample"))
    return V.build_vocab(A.document_nodes(spark, sf).join(train, "sample", "left_semi"), 2)


HALF_SQL = f"{D}, half AS (SELECT * FROM dnodes WHERE {HALF}), v AS ({VOCAB.format(rows='half', least=2)})"


@query("encode_tokens", f"""WITH {HALF_SQL}
  SELECT sample, unit, idx, d.token, coalesce(id, 0) AS id FROM dnodes d LEFT JOIN v ON v.token = d.token""")
def encode_tokens(spark, sf):
    return V.encode_tokens(A.document_nodes(spark, sf), half_vocab(spark, sf))


@query("decode_tokens", f"""WITH {HALF_SQL}, ids AS (
    SELECT n_chars % 40000 AS id, count(*) AS n FROM documents GROUP BY ALL)
  SELECT ids.id, n, coalesce(token, '<UNK>') AS token FROM ids LEFT JOIN v ON v.id = ids.id""")
def decode_tokens(spark, sf):
    ids = table(spark, sf, "documents").groupBy((F.col("n_chars") % 40000).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return V.decode_tokens(ids, half_vocab(spark, sf))


UPDATED = f"""{HALF_SQL}, fresh AS (SELECT DISTINCT token FROM dnodes WHERE token NOT IN (SELECT token FROM v)),
  grown AS (SELECT token, id FROM v UNION ALL
    SELECT token, (SELECT max(id) FROM v) + row_number() OVER (ORDER BY token) FROM fresh)"""


@query("update_vocab", f"WITH {UPDATED} SELECT * FROM grown")
def update_vocab(spark, sf):
    return V.update_vocab(half_vocab(spark, sf), A.document_nodes(spark, sf))


@query("vocab_valid", f"""WITH {UPDATED} SELECT bool_or(token = '<UNK>' AND id = 0) AS unk_first,
  count(*) = count(DISTINCT token) AS unique_tokens,
  count(*) = count(DISTINCT id) AND min(id) = 0 AND max(id) = count(*) - 1 AS dense FROM grown""")
def vocab_valid(spark, sf):
    return V.vocab_valid(update_vocab(spark, sf))


@query("unk_rate", f"""WITH {HALF_SQL}, e AS (
    SELECT sample, coalesce(id, 0) AS id FROM dnodes d LEFT JOIN v ON v.token = d.token)
  SELECT sample, round(avg((id = 0)::INT), 6) AS unk_rate, count(*) AS n_tokens FROM e GROUP BY sample""")
def unk_rate(spark, sf):
    return rounded(V.unk_rate(encode_tokens(spark, sf), ["sample"]), "unk_rate")


@query("token_counts", f"WITH {D} SELECT sample, token, count(*) AS n FROM dnodes GROUP BY sample, token")
def token_counts(spark, sf):
    return V.token_counts(A.document_nodes(spark, sf))


@query("token_counts_model_view", f"""WITH {D}
  SELECT sample, token, count(*) AS n FROM dnodes WHERE unit < 3 AND idx < 64 GROUP BY sample, token""")
def token_counts_model_view(spark, sf):
    return V.token_counts(A.document_nodes(spark, sf), 3, 64)


@query("call_api_counts", f"""WITH {A.ONODES_SQL}
  SELECT sample, coalesce(api, token, 'call') AS api, count(*) AS n FROM onodes JOIN ounits USING (unit) GROUP BY ALL""")
def call_api_counts(spark, sf):
    return V.call_api_counts(A.order_nodes(spark, sf).join(A.order_units(spark, sf), "unit"))


def doc_counts(spark, sf):
    return V.token_counts(A.document_nodes(spark, sf)).withColumnRenamed("token", "term")


COUNTS = f"{D}, counts AS (SELECT sample, token AS term, count(*) AS n FROM dnodes GROUP BY ALL)"


@query("top_k_terms", f"""WITH {COUNTS} (SELECT 'total' AS by, term, sum(n)::BIGINT AS weight FROM counts GROUP BY term ORDER BY weight DESC, term LIMIT 50)
  UNION ALL (SELECT 'df', term, count(*) AS weight FROM counts GROUP BY term ORDER BY weight DESC, term LIMIT 50)
  UNION ALL (SELECT 'train_df', term, count(*) AS weight FROM counts WHERE sample IN (SELECT doc_id FROM labels)
             GROUP BY term ORDER BY weight DESC, term LIMIT 50)""")
def top_k_terms(spark, sf):
    counts = doc_counts(spark, sf)
    train = table(spark, sf, "labels").select(F.col("doc_id").alias("sample"))
    weights = materialize(V.term_weights(counts, train))
    parts = [weights.select(F.lit(by).alias("by"), "term", F.col(by).alias("weight")).filter("weight > 0")
             .orderBy(F.col("weight").desc(), F.col("term").asc()).limit(50) for by in ("total", "df", "train_df")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


KINDS = ("click", "purchase", "error", "signup", "view")


@query("term_count_vector", "SELECT user_id AS sample, " + ", ".join(
    f"count(*) FILTER (event_type = '{k}') AS \"{k}\"" for k in KINDS) + " FROM events GROUP BY user_id")
def term_count_vector(spark, sf):
    counts = (table(spark, sf, "events").groupBy(F.col("user_id").alias("sample"), F.col("event_type").alias("term"))
              .agg(F.count(F.lit(1)).alias("n")))
    return V.term_count_vector(counts, KINDS)


def tfidf_sql(counts: str, min_df: int) -> str:
    return f"""WITH {COUNTS}, c AS ({counts}), train AS (SELECT doc_id FROM labels),
  df AS (SELECT term, count(*) AS df FROM c WHERE sample IN (SELECT doc_id FROM train) GROUP BY term HAVING count(*) >= {min_df}),
  w AS (SELECT sample, term, n * (ln((1 + (SELECT count(*) FROM train)) / (1 + df)::DOUBLE) + 1) AS w FROM c JOIN df USING (term))
  SELECT sample, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY sample)), 6) AS weight FROM w"""


@query("tfidf", tfidf_sql("SELECT * FROM counts", 3))
def tfidf(spark, sf):
    train = table(spark, sf, "labels").select(F.col("doc_id").alias("sample"))
    return rounded(V.tfidf(doc_counts(spark, sf), train, 3), "weight")


@query("tfidf_lowercase", tfidf_sql("SELECT sample, lower(term) AS term, sum(n) AS n FROM counts GROUP BY ALL", 2))
def tfidf_lowercase(spark, sf):
    train = table(spark, sf, "labels").select(F.col("doc_id").alias("sample"))
    return rounded(V.tfidf(doc_counts(spark, sf), train, 2, lowercase=True), "weight")


@query("most_common_tokens", f"WITH {D} SELECT token, count(*) AS n FROM dnodes GROUP BY token ORDER BY n DESC, token LIMIT 20")
def most_common_tokens(spark, sf):
    return V.most_common_tokens(A.document_nodes(spark, sf), 20)
