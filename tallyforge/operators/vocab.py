"""Vocabularies, encoded tokens and TF-IDF.

Tokens are rows ``(sample, token)``; a vocabulary is ``(token, id)`` with id 0 for ``<UNK>``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..scale import keyed_join, materialize, may_broadcast, ranked

UNK = "<UNK>"


def _with_unk(vocab: DataFrame) -> DataFrame:
    spark = vocab.sparkSession
    return spark.range(1).select(F.lit(UNK).alias("token"), F.lit(0).cast("long").alias("id")).unionByName(vocab)


def build_vocab(tokens: DataFrame, min_freq: int = 1, max_size: int | None = None) -> DataFrame:
    """Ids by falling frequency, ties by token; ``max_size`` counts the unknown token too."""
    counts = (tokens.filter(F.col("token") != UNK).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") >= min_freq))
    vocab = ranked(counts, [], [F.col("n").desc(), F.col("token").asc()], "id")
    if max_size is not None:
        vocab = vocab.filter(F.col("id") < max_size)
    return _with_unk(vocab.select("token", "id"))


def encode_tokens(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add ``id``, 0 for tokens outside the vocabulary."""
    return (keyed_join(tokens, vocab.select("token", "id"), ["token"], "left")
            .withColumn("id", F.coalesce("id", F.lit(0))))


def decode_tokens(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add ``token``, the unknown token for ids out of range."""
    return (keyed_join(ids, vocab.select("id", "token"), ["id"], "left")
            .withColumn("token", F.coalesce("token", F.lit(UNK))))


def update_vocab(vocab: DataFrame, tokens: DataFrame) -> DataFrame:
    """Append unseen tokens in sorted order; ids already given never change."""
    fresh = tokens.select("token").distinct().join(vocab, "token", "left_anti")
    top = vocab.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    added = ranked(fresh, [], [F.col("token").asc()], "id").withColumn("id", F.col("id") + top)
    return vocab.select("token", "id").unionByName(added.select("token", "id"))


def vocab_valid(vocab: DataFrame) -> DataFrame:
    """One row: unknown token first, no token twice, ids dense from 0."""
    # a token seen twice under different ids shows up as two rows after the grouping below
    by_token = vocab.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    ids = vocab.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    a = by_token.agg(F.max(F.when(F.col("token") == UNK, F.col("id"))).alias("unk_id"),
                     F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    b = ids.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most_id"), F.count(F.lit(1)).alias("n_ids"),
                F.min("id").alias("lo"), F.max("id").alias("hi"))
    return a.select(
        (F.coalesce(F.col("unk_id"), F.lit(-1)) == 0).alias("unk_first"), (F.col("most") == 1).alias("unique_tokens"),
        b.select((F.col("most_id") == 1) & (F.col("lo") == 0) & (F.col("hi") == F.col("n_ids") - 1)).scalar().alias("dense"))


def unk_rate(encoded: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of tokens that have no id of their own."""
    return encoded.groupBy(*by).agg(F.avg((F.col("id") == 0).cast("double")).alias("unk_rate"),
                                    F.count(F.lit(1)).alias("n_tokens"))


def token_counts(nodes: DataFrame, max_units: int | None = None, max_nodes: int | None = None) -> DataFrame:
    """Token counts per sample, of everything or of the first units and nodes a model would see.

    ``nodes`` is ``(sample, unit, idx, token)`` with ``unit`` and ``idx`` positions from 0.
    """
    view = nodes.filter(F.col("token").isNotNull() & (F.col("token") != ""))
    if max_units is not None:
        view = view.filter(F.col("unit") < max_units)
    if max_nodes is not None:
        view = view.filter(F.col("idx") < max_nodes)
    return view.groupBy("sample", "token").agg(F.count(F.lit(1)).alias("n"))


def call_api_counts(nodes: DataFrame) -> DataFrame:
    """Per sample, counts of what each call node names: its API, else its token, else ``call``."""
    name = F.coalesce(F.nullif("api", F.lit("")), F.nullif("token", F.lit("")), F.lit("call"))
    return nodes.groupBy("sample", name.alias("api")).agg(F.count(F.lit(1)).alias("n"))


def top_k_terms(counts: DataFrame, k: int, by: str = "total", train_ids: DataFrame | None = None) -> DataFrame:
    """The k terms with the largest total count, or document frequency over all or training samples."""
    rows = counts
    if by == "train_df":
        rows = rows.join(train_ids.select("sample").distinct(), "sample", "left_semi")
    weight = F.sum("n") if by == "total" else F.count(F.lit(1))
    return (rows.groupBy("term").agg(weight.alias("weight"))
            .orderBy(F.col("weight").desc(), F.col("term").asc()).limit(k))


def _known(ids: DataFrame) -> DataFrame:
    """Distinct samples as the right side of a join that does not deal out or sort the left one, if that is dealt by sample."""
    known = ids.select("sample").distinct()
    return F.broadcast(known) if may_broadcast(ids) else known.hint("shuffle_hash")


def term_weights(counts: DataFrame, train_ids: DataFrame) -> DataFrame:
    """(term, total, df, train_df) in one pass over the counts: all the weights that ``top_k_terms`` ranks by."""
    marked = counts.join(_known(train_ids).withColumn("_train", F.lit(True)), "sample", "left")
    return marked.groupBy("term").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("df"), F.count("_train").alias("train_df"))


def term_count_vector(counts: DataFrame, terms: Sequence[str]) -> DataFrame:
    """One column per term with its count in the sample, 0 when absent."""
    cells = [F.sum(F.when(F.col("term") == t, F.col("n")).otherwise(0)).alias(t) for t in terms]
    return counts.groupBy("sample").agg(*cells)


def tfidf(counts: DataFrame, train_ids: DataFrame, min_df: int, lowercase: bool = False) -> DataFrame:
    """``n * (ln((1 + N) / (1 + df)) + 1)`` with rows scaled to length 1, fitted on training samples.

    Samples outside the training set get weights from the same table; terms in fewer than
    ``min_df`` training samples are left out.
    """
    if lowercase:
        counts = (counts.withColumn("term", F.lower("term")).groupBy("sample", "term")
                  .agg(F.sum("n").alias("n")))
    size = train_ids.select("sample").distinct().agg(F.count(F.lit(1)).alias("size")).scalar()
    # written, so that the join sees the size of the vocabulary and not that of the texts
    df = materialize(counts.join(_known(train_ids), "sample", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
                     .filter(F.col("df") >= min_df)
                     .select("term", (F.log((1 + size) / (1 + F.col("df")).cast("double")) + 1).alias("idf")))
    weighted = keyed_join(counts, df, ["term"]).withColumn("w", F.col("n") * F.col("idf"))
    # a sample's terms are bounded by the vocabulary, so one window group is one document
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("sample")))
    return weighted.select("sample", "term", (F.col("w") / norm).alias("weight"))


def most_common_tokens(tokens: DataFrame, n: int) -> DataFrame:
    """The n most frequent tokens."""
    return (tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col("token").asc()).limit(n))
