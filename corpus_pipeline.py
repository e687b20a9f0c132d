"""From raw documents to balanced shards, one written table per stage.

Language ID drops what it cannot identify, near copies are reduced to one document each, documents that hold
benchmark text go, sources are mixed to target weights (a document may then stand twice), and what is left is dealt
to shards. ``run`` writes every stage as Parquet in the shared folder and starts the next one from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import decontam, langid, mixing, ngramjoin, sharding
from tallyforge.llm.common import Scratch
from tallyforge.plans.registry import query, table

#: What near copies are in this stage; ``op4_jaccard_join`` has settings of its own.
NEAR_COPIES = ngramjoin.Settings(words=5, percent=80)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is not left open: a calibrated probability of 0.35 at least."""
    return langid.keep_identified(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies: five-word shingles, Jaccard 0.8 or more."""
    return ngramjoin.keep_one(docs, NEAR_COPIES)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a contaminating share of benchmark text."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, group_bytes): a place for every row of the mix."""
    return sharding.shard_by_size(docs, shards=40)


STAGES = [("language ID", identify), ("n-gram Jaccard join", one_of_each), ("benchmark decontamination", decontaminate),
          ("mixing sources to target weights", mix), ("sharding", shard)]

#: Language ID and the heap have no SQL form; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(f"stage{i - 1}")
    return docs


def register() -> None:
    query("pipeline", ORACLE_SQL)(run)
