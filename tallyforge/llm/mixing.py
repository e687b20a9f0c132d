"""Mixing sources to target weights: hash-random order, distributed prefix sums, a cut at the exact budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.order import hash_key
from ..scale import may_broadcast
from .common import Scratch, blank_words, running_sums


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source, null included.

    Weights repeat along the sources in code point order, null last. ``share`` of all words is dealt by weight;
    a target ends at ``most`` times its source's size, and what lies above is dealt again to the others. That ends
    where every open source has the same level per weight, so sources fill up in the order of cap / weight.
    Only sources, not documents, meet in the windows here.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("_fill", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    filled = (sizes.withColumn("_w", weight)
              .withColumns({"_cap": F.col("source_size") * F.lit(float(most)),
                            "_all": F.sum("source_size").over(everything) * F.lit(float(share))})
              .withColumn("_fill", F.col("_cap") / F.col("_w"))
              .withColumns({"_caps": F.sum("_cap").over(by_fill) - F.col("_cap"),
                            "_open": F.sum("_w").over(everything) - F.sum("_w").over(by_fill) + F.col("_w")})
              .withColumn("_level", (F.col("_all") - F.col("_caps")) / F.col("_open"))
              .withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_fill"), F.col("_level"))).over(everything)))
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_w")))
    return filled.select("source", "source_size", target.alias("target"))


def _place(seed: str, id_col: str, size: Column) -> Column:
    """Where a row stands in its source: the hash of its id, the id, the size."""
    return F.struct(hash_key(seed, F.col(id_col)).alias("key"),
                    F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), size.alias("size"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
                seed: str = "mix", id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, epochs, part, taken) per row of ``docs``.

    Within a source, rows stand in the order of the hash of their id. The budget is the whole part of the target:
    ``epochs`` full passes over the source, then the first words of that order. ``part`` is what the last, partial
    pass takes of the row: all its words before the cut, some of the row at the cut, none after it.
    ``taken = epochs * size + part``, so the taken words of a source are its budget exactly.

    Null, empty and blank texts have size 0 and nothing is taken. Null is a source of its own. Rows with one id and
    size are interchangeable. A source without words has target 0; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"),
                       _place(seed, id_col, blank_words(text_col)).alias("_at")).withColumn("size", F.col("_at.size"))
    rows = scratch.write(rows, "rows")  # dealing by ranges looks at the rows twice; the texts are read once
    placed = running_sums(rows, scratch, "order", ["source"], ["_at"], _before="size")
    ordered = scratch.spark.read.parquet(scratch.path("order"))
    sizes = ordered.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most).withColumnRenamed("source", "_source")
    budget = F.floor("target")
    return (placed.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
            .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
            .withColumn("_left", budget - F.col("epochs") * F.col("source_size"))
            .withColumn("part", F.least("size", F.greatest(F.lit(0), F.col("_left") - F.col("_before"))).cast("long"))
            .select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "epochs", "part",
                    (F.col("epochs") * F.col("size") + F.col("part")).alias("taken")))


def mixed_documents(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it.

    Documents stay whole here: the one at the cut is kept if at least half of it lies before the cut. The order is
    that of a hash, so a source's cut is one position in it, and a row needs only its source's cut to know its
    copies: the texts are not shuffled. Rows with one id, source and size share their fate.
    """
    mix = mix_sources(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    cuts = (mix.withColumn("_at", _place(seed, id_col, F.col("size")))
            .groupBy("source").agg(F.max("epochs").alias("__mix_epochs"),
                                   F.max(F.when(F.col("part") > 0, F.struct("_at", "part"))).alias("__mix_cut"))
            .withColumnRenamed("source", "__mix_source"))
    at = _place(seed, id_col, blank_words(text_col))
    last = F.col("__mix_cut._at")
    whole = 2 * F.col("__mix_cut.part") >= F.col("__mix_cut._at.size")
    again = F.when((at < last) | ((at == last) & whole), 1).otherwise(0)
    copies = (F.col("__mix_epochs") + again).cast("int")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    cuts = Scratch(docs.sparkSession).write(cuts, "cuts")  # one row per source: its size is known before texts would be shuffled
    return (docs.join(F.broadcast(cuts) if may_broadcast(cuts) else cuts, F.col(source_col).cast("string").eqNullSafe(F.col("__mix_source")))
            .withColumn("__mix_copies", copies).filter("__mix_copies > 0")
            .withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*columns))
