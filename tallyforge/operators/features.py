"""Feature columns, scaling and weights."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import ratio
from ..scale import keyed_join
from .vocab import top_k_terms

SIMPLE = ("mean_entropy", "max_entropy", "min_entropy", "file_size", "num_api_calls", "num_units", "total_nodes",
          "total_edges_seq", "total_seed_edges", "total_node_indicators", "inter_edges")
GRAPH7 = ("num_functions", "num_api_calls", "num_imports", "file_size", "max_section_entropy", "packed", "total_nodes")

# Section names a compiler writes by default.
STANDARD_SECTIONS = (".text", ".data", ".rdata", ".rsrc", ".reloc", ".bss", ".idata", ".edata", ".pdata", ".tls",
                     ".gfids", ".didat", ".crt", ".xdata", ".rodata")


def _count(df: DataFrame, name: str, cond: Column | None = None) -> DataFrame:
    n = F.count(F.lit(1)) if cond is None else F.count_if(cond)
    return df.groupBy("sample").agg(n.alias(name))


def simple_features(samples: DataFrame, units: DataFrame, nodes: DataFrame, edges: DataFrame, evidence: DataFrame,
                    call_edges: DataFrame | None = None) -> DataFrame:
    """Eleven scalars per sample from its child tables; what is missing counts as 0.

    Every child is reduced to one row per sample before the join.  Child tables carry
    ``sample``; nodes have ``api``; evidence has ``kind``.
    """
    parts = [_count(units, "num_units"),
             nodes.groupBy("sample").agg(F.count(F.lit(1)).alias("total_nodes"), F.count("api").alias("num_api_calls")),
             _count(edges, "total_edges_seq"),
             evidence.groupBy("sample").agg(F.count_if(F.col("kind") == "edge").alias("total_seed_edges"),
                                            F.count_if(F.col("kind") == "indicator").alias("total_node_indicators"))]
    if call_edges is not None:
        parts.append(_count(call_edges, "inter_edges"))
    out = samples
    for p in parts:
        out = keyed_join(out, p, ["sample"], "left")
    return out.select("sample", *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in out.columns else F.lit(0.0))
                                  .alias(c) for c in SIMPLE])


def meta8(df: DataFrame) -> DataFrame:
    """Header features; ``sections`` is the array of section names, ``entropies`` theirs."""
    standard = F.array(*[F.lit(s) for s in STANDARD_SECTIONS])
    odd = F.size(F.filter("sections", lambda s: ~F.array_contains(standard, F.lower(s))))
    return df.select("sample", F.col("has_sig").cast("double").alias("has_sig"), F.col("linker").cast("double").alias("linker"),
                     F.col("year").cast("double").alias("year"), F.col("has_rich").cast("double").alias("has_rich"),
                     F.size("sections").cast("double").alias("n_sec"), odd.cast("double").alias("nonstd_sec"),
                     F.coalesce(F.array_max("entropies"), F.lit(0.0)).alias("max_ent"),
                     F.log10(F.greatest(F.col("file_size"), F.lit(1)).cast("double")).alias("log_size"))


def graph7(df: DataFrame) -> DataFrame:
    """The seven graph features as doubles, missing ones 0."""
    return df.select("sample", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in GRAPH7])


def global_features(df: DataFrame) -> DataFrame:
    """Entropy summary and whether the program calls anything external."""
    return df.select("sample", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in
                                 ("mean_entropy", "max_entropy", "min_entropy", "has_any_external_call")])


def feature_concat_gapi(graph: DataFrame, counts: DataFrame, k: int = 50, train_ids: DataFrame | None = None) -> DataFrame:
    """Graph features followed by the counts of the k APIs with the highest document frequency.

    ``counts`` is ``(sample, term, n)``.  Only the k chosen names reach the driver.
    """
    top = top_k_terms(counts, k, "train_df" if train_ids is not None else "df", train_ids)
    terms = [r["term"] for r in top.orderBy(F.col("weight").desc(), F.col("term").asc()).collect()]
    cells = [F.sum(F.when(F.col("term") == t, F.col("n")).otherwise(0)).alias(f"api{i}") for i, t in enumerate(terms)]
    wide = counts.filter(F.col("term").isin(terms)).groupBy("sample").agg(*cells)
    names = [c for c in graph.columns if c != "sample"]
    joined = keyed_join(graph, wide, ["sample"], "left")
    values = [F.col(c).cast("double") for c in names] + [F.coalesce(F.col(f"api{i}").cast("double"), F.lit(0.0))
                                                         for i in range(len(terms))]
    return joined.select("sample", F.array(*values).alias("features"))


def standard_scale(df: DataFrame, cols: Sequence[str], train_pred: Column) -> DataFrame:
    """Columns to mean 0 and population deviation 1 of the training rows; constants become 0."""
    one = df.filter(train_pred).agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in cols],
                                             *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).alias("fit")).scalar()
    out = df.withColumn("_fit", one)
    for c in cols:
        std = F.col(f"_fit.s_{c}")
        out = out.withColumn(c, (F.col(c) - F.col(f"_fit.m_{c}")) / F.when(std > 0, std).otherwise(1.0))
    return out.drop("_fit")


def class_weights_balanced(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight n / (classes * n_class) per row."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"))
    per = counts.select(label, (total.select("n").scalar() / (total.select("k").scalar() * F.col("_n"))).alias(out))
    return keyed_join(df, per, [label])


def cell_weights_clipped(df: DataFrame, bin: str, label: str, lo: float = 0.25, hi: float = 4.0, min_neg: int = 30,
                         out: str = "weight") -> DataFrame:
    """Inverse frequency of the (bin, label) cell, clipped; bins with few negatives are marked."""
    cells = df.groupBy(bin, label).agg(F.count(F.lit(1)).alias("_n"))
    total = cells.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"))
    neg = df.groupBy(bin).agg(F.count_if(F.col(label) == 0).alias("_neg"))
    raw = total.select("n").scalar() / (total.select("k").scalar() * F.col("_n"))
    per = (cells.join(neg, bin).select(bin, label, F.least(F.greatest(raw, F.lit(lo)), F.lit(hi)).alias(out),
                                       (F.col("_neg") < min_neg).alias("underpowered")))
    return keyed_join(df, per, [bin, label])


def feature_ablation(df: DataFrame, features: Sequence[str], drop: dict[str, Sequence[str]],
                     fit: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """Refit without each named set of features; ``fit(df, features)`` returns one row with ``value``."""
    out = fit(df, list(features)).select(F.lit("none").alias("dropped"), "value")
    for name, gone in drop.items():
        kept = [f for f in features if f not in set(gone)]
        out = out.unionByName(fit(df, kept).select(F.lit(name).alias("dropped"), "value"))
    return out
