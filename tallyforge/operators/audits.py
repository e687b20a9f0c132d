"""Data-quality audits as grouped aggregates.

Evidence is ``(sample, unit, technique_id, kind)`` with kind ``edge`` or ``indicator``;
samples are ``(sample, label, ...)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import ratio
from ..scale import exact_quantiles, first_rows, keyed_join, ranked

KINDS = ("edge", "indicator", "any")


class MissingEvidence(RuntimeError):
    """Required unit fields are absent; counting anyway would report rates that are too low."""


def share(num: Column, den: Column) -> Column:
    return F.lit(100.0) * ratio(num, den)


def both_kinds(evidence: DataFrame) -> DataFrame:
    """Every piece of evidence under its own kind and under ``any``."""
    return evidence.withColumn("kind", F.explode(F.array(F.col("kind"), F.lit("any"))))


def required_fields_gate(units: DataFrame, fields: Sequence[str], stop: bool = False) -> DataFrame:
    """Samples with a unit that lacks a required field, with the units missing each field."""
    missing = units.groupBy("sample").agg(
        *[F.count_if(F.col(f).isNull()).alias(f"missing_{f}") for f in fields])
    bad = missing.filter(" or ".join(f"missing_{f} > 0" for f in fields))
    if stop and not bad.isEmpty():
        first = [r["sample"] for r in bad.orderBy("sample").limit(10).collect()]
        raise MissingEvidence(f"samples without required fields, the first being {first}")
    return bad


def evidence_by_unit(edges: DataFrame, indicators: DataFrame) -> DataFrame:
    """Per unit and technique the number of edges, indicators and both."""
    cols = ["sample", "unit", "technique_id"]
    both = (edges.select(*cols, F.lit(1).alias("e"), F.lit(0).alias("i"))
            .unionByName(indicators.select(*cols, F.lit(0).alias("e"), F.lit(1).alias("i"))))
    return both.groupBy(*cols).agg(F.sum("e").alias("edge"), F.sum("i").alias("indicator"),
                                   F.count(F.lit(1)).alias("any"))


def sample_techniques(edges: DataFrame, indicators: DataFrame) -> DataFrame:
    """Distinct (sample, kind, technique), one per row."""
    cols = ["sample", "technique_id"]
    return (edges.select(*cols, F.lit("edge").alias("kind"))
            .unionByName(indicators.select(*cols, F.lit("indicator").alias("kind"))).distinct())


def _class_sizes(samples: DataFrame) -> DataFrame:
    return samples.filter(F.col("label").isNotNull()).groupBy("label").agg(F.count(F.lit(1)).alias("n_samples"))


def _firing(samples: DataFrame, evidence: DataFrame) -> DataFrame:
    """Samples with evidence per (technique, kind, label)."""
    hits = both_kinds(evidence.select("sample", "technique_id", "kind").distinct()).distinct()
    return (keyed_join(hits, samples.select("sample", "label"), ["sample"])
            .groupBy("technique_id", "kind", "label").agg(F.count(F.lit(1)).alias("n_firing")))


def fire_rate(samples: DataFrame, evidence: DataFrame, rules: DataFrame, min_rate: float = 0.01) -> DataFrame:
    """Share of samples each rule fires in, per kind and class; rules that never fire are listed too."""
    grid = (rules.select("technique_id", "rule_name").distinct()
            .withColumn("kind", F.explode(F.array(*[F.lit(k) for k in KINDS]))))
    sizes = _class_sizes(samples)
    labels = sizes.agg(F.collect_list(F.struct("label", "n_samples"))).scalar()
    full = grid.withColumn("c", F.explode(labels)).select("technique_id", "rule_name", "kind", "c.*")
    out = full.join(_firing(samples, evidence), ["technique_id", "kind", "label"], "left").fillna(0, ["n_firing"])
    rate = ratio(F.col("n_firing"), F.col("n_samples"))
    return out.withColumns({"fire_pct": rate * 100, "low_rate": rate < min_rate})


def unknown_techniques(evidence: DataFrame, rules: DataFrame) -> DataFrame:
    """Techniques that occur in the data but not in the rule table."""
    return evidence.select("technique_id").distinct().join(rules.select("technique_id"), "technique_id", "left_anti")


def cross_unit_fire_rate(samples: DataFrame, cross_edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Samples and edges of cross-unit evidence per technique and class."""
    per = cross_edges.groupBy("sample", "technique_id").agg(F.count(F.lit(1)).alias("n"))
    hits = (keyed_join(per, samples.select("sample", "label"), ["sample"]).groupBy("technique_id", "label")
            .agg(F.count(F.lit(1)).alias("n_firing"), F.sum("n").alias("n_edges")))
    labels = _class_sizes(samples).agg(F.collect_list(F.struct("label", "n_samples"))).scalar()
    grid = rules.select("technique_id").distinct().withColumn("c", F.explode(labels)).select("technique_id", "c.*")
    out = grid.join(hits, ["technique_id", "label"], "left").fillna(0, ["n_firing", "n_edges"])
    return out.withColumn("fire_pct", share(F.col("n_firing"), F.col("n_samples")))


def evidence_coverage(samples: DataFrame, evidence: DataFrame, tier: str = "tier") -> DataFrame:
    """Positives with no evidence, indicators only, or an edge, per confidence tier and in TOTAL."""
    kinds = evidence.groupBy("sample").agg(F.max((F.col("kind") == "edge").cast("int")).alias("has_edge"))
    state = (F.when(F.col("has_edge") == 1, "edge").when(F.col("has_edge") == 0, "indicator").otherwise("none"))
    rows = keyed_join(samples.filter("label = 1"), kinds, ["sample"], "left").withColumn("state", state)
    out = rows.rollup(tier).agg(F.count(F.lit(1)).alias("n"),
                                *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("none", "indicator", "edge")],
                                F.grouping(tier).alias("_all"))
    out = out.withColumn(tier, F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(tier))).drop("_all")
    return out.withColumns({f"pct_{s}": share(F.col(f"n_{s}"), F.col("n")) for s in ("none", "indicator", "edge")})


def technique_discrimination(samples: DataFrame, evidence: DataFrame, noise_diff: float = 15.0,
                             noise_neg: float = 30.0) -> DataFrame:
    """Share of each class a technique fires in, the difference, and a flag for mere noise."""
    sizes = samples.agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    n0, n1 = sizes.select("n0").scalar(), sizes.select("n1").scalar()
    fired = _firing(samples, evidence).groupBy("technique_id", "kind").agg(
        F.sum(F.when(F.col("label") == 0, F.col("n_firing")).otherwise(0)).alias("f0"),
        F.sum(F.when(F.col("label") == 1, F.col("n_firing")).otherwise(0)).alias("f1"))
    neg = F.coalesce(share(F.col("f0"), n0), F.lit(0.0))
    pos = F.coalesce(share(F.col("f1"), n1), F.lit(0.0))
    return (fired.select("technique_id", "kind", neg.alias("neg_pct"), pos.alias("pos_pct"))
            .withColumn("diff", F.col("pos_pct") - F.col("neg_pct"))
            .withColumn("is_noise", (F.abs("diff") < noise_diff) & (F.col("neg_pct") > noise_neg)))


def evidence_histogram(samples: DataFrame, edges: DataFrame, clip: int = 20) -> DataFrame:
    """Samples per class by their number of edges, counts at or above ``clip`` together."""
    per = edges.groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
    rows = keyed_join(samples.select("sample", "label"), per, ["sample"], "left")
    return (rows.withColumn("n_edges", F.least(F.coalesce("n", F.lit(0)), F.lit(clip)))
            .groupBy("label", "n_edges").agg(F.count(F.lit(1)).alias("n_samples")))


def boundary_lift(units: DataFrame, calls: DataFrame, evidence: DataFrame) -> DataFrame:
    """Share of evidence in flagged units over the share of call sites there; NULL where undefined.

    ``units`` is ``(sample, unit, flagged)``.
    """
    flags = units.select("sample", "unit", "flagged")
    sites = calls.groupBy("sample", "unit").agg(F.count(F.lit(1)).alias("n"))
    base = sites.join(flags, ["sample", "unit"]).agg(
        F.sum(F.when(F.col("flagged"), F.col("n")).otherwise(0)).alias("f"), F.sum("n").alias("n"))
    site_share = base.select(ratio(F.col("f"), F.col("n"))).scalar()
    per = both_kinds(evidence).groupBy("sample", "unit", "technique_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    out = (per.join(flags, ["sample", "unit"]).groupBy("technique_id", "kind").agg(
        F.sum(F.when(F.col("flagged"), 0).otherwise(F.col("n"))).alias("clean"),
        F.sum(F.when(F.col("flagged"), F.col("n")).otherwise(0)).alias("flagged")))
    inside = ratio(F.col("flagged"), F.col("clean") + F.col("flagged"))
    return out.withColumns({"flagged_pct": inside * 100, "lift": ratio(inside, site_share)})


def _unit_ranks(units: DataFrame, order: str = "unit") -> DataFrame:
    return ranked(units.select("sample", "unit", order) if order != "unit" else units.select("sample", "unit"),
                  ["sample"], [F.col(order).asc()], "rank", 0)


def position_bias(units: DataFrame, evidence: DataFrame, cutoff: int, clip: int = 200,
                  order: str = "unit") -> DataFrame:
    """Where evidence lies in samples with more than ``cutoff`` units.

    Rows with ``rank`` NULL: per technique and kind the samples with evidence, with some of it
    at rank >= cutoff, and with all of it there.  Rows with a rank: units with evidence of the
    kind at that rank, clipped.
    """
    sizes = units.groupBy("sample").agg(F.count(F.lit(1)).alias("n_units")).filter(F.col("n_units") > cutoff)
    pos = keyed_join(_unit_ranks(units, order), sizes, ["sample"]).select("sample", "unit", "rank")
    found = both_kinds(evidence.select("sample", "unit", "technique_id", "kind").distinct()).distinct()
    hits = found.join(pos, ["sample", "unit"])
    per = hits.groupBy("sample", "technique_id", "kind").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    rates = per.groupBy("technique_id", "kind").agg(
        F.count(F.lit(1)).alias("n_with"), F.count_if(F.col("hi") >= cutoff).alias("n_beyond"),
        F.count_if(F.col("lo") >= cutoff).alias("n_lost"))
    hist = (hits.select("sample", "unit", "kind", F.least("rank", F.lit(clip)).alias("rank")).distinct()
            .groupBy("kind", "rank").agg(F.count(F.lit(1)).alias("n_with")))
    none = F.lit(None)
    return (rates.select("technique_id", "kind", none.cast("long").alias("rank"), "n_with", "n_beyond", "n_lost")
            .unionByName(hist.select(none.cast("string").alias("technique_id"), "kind", F.col("rank").cast("long").alias("rank"),
                                     "n_with", none.cast("long").alias("n_beyond"), none.cast("long").alias("n_lost"))))


def truncation_stats(samples: DataFrame, cap: int, by: Sequence[str], size: str = "n_units") -> DataFrame:
    """Samples over the unit cap, with exact medians of the size and of what the cap drops."""
    by = list(by)
    rows = samples.withColumn("dropped", F.when(F.col(size) > cap, F.col(size) - cap))
    agg = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("dropped").alias("n_truncated"))
    out = agg.join(exact_quantiles(rows, by, size, {"median_units": 0.5}), by, "left")
    out = out.join(exact_quantiles(rows, by, "dropped", {"median_dropped": 0.5}), by, "left")
    return out.withColumn("truncated_pct", share(F.col("n_truncated"), F.col("n")))


def evidence_truncation(edges: DataFrame, max_units: int, max_nodes: int, by: Sequence[str]) -> DataFrame:
    """Edges lost to the unit cap, and of the rest those lost to the node cap.

    ``edges`` has the unit's ``rank`` and the node positions ``src_idx`` and ``dst_idx``.
    """
    unit_lost = F.col("rank") >= max_units
    node_lost = ~unit_lost & ((F.col("src_idx") >= max_nodes) | (F.col("dst_idx") >= max_nodes))
    out = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(unit_lost).alias("lost_by_units"),
                                 F.count_if(node_lost).alias("lost_by_nodes"))
    return out.withColumns({"lost_units_pct": share(F.col("lost_by_units"), F.col("n_edges")),
                            "lost_nodes_pct": share(F.col("lost_by_nodes"), F.col("n_edges"))})


def selection_coverage(evidence: DataFrame, selections: dict[str, DataFrame]) -> DataFrame:
    """Share of evidence that lies in the units each selection policy keeps."""
    per = evidence.groupBy("sample", "unit").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("t")).scalar()
    out = None
    for name, kept in selections.items():
        part = (per.join(kept.select("sample", "unit").distinct(), ["sample", "unit"], "left_semi")
                .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"))
                .select(F.lit(name).alias("policy"), "kept", total.alias("total")))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("kept_pct", share(F.col("kept"), F.col("total")))


def split_balance(df: DataFrame, split: str, label: str) -> DataFrame:
    """Rows and percentage of each class in each split."""
    counts = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    totals = df.groupBy(split).agg(F.count(F.lit(1)).alias("n_split"))
    return counts.join(totals, split).withColumn("pct", share(F.col("n"), F.col("n_split")))


def group_leakage(df: DataFrame, split: str, group: str, train: str = "train", test: str = "test") -> DataFrame:
    """One row: groups on both sides, the test rows they touch, and rows without a group."""
    sides = df.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count_if(F.col(split) == train).alias("n_train"), F.count_if(F.col(split) == test).alias("n_test"))
    leaks = (F.col("n_train") > 0) & (F.col("n_test") > 0)
    nulls = df.agg(F.count_if(F.col(group).isNull()).alias("n")).scalar()
    return sides.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(leaks).alias("leaked_groups"),
                     F.coalesce(F.sum(F.when(leaks, F.col("n_test"))), F.lit(0)).alias("leaked_test_rows")) \
        .withColumn("rows_without_group", nulls)


def unit_size_stats(units: DataFrame, tiny: int = 3, size: str = "n_nodes") -> DataFrame:
    """Smallest, largest and mean unit of each sample, and its tiny units."""
    return units.groupBy("sample").agg(
        F.count(F.lit(1)).alias("n_units"), F.min(size).alias("min_size"), F.max(size).alias("max_size"),
        F.avg(size).alias("mean_size"), F.count_if(F.col(size) <= tiny).alias("n_tiny"))


def find_sample(samples: DataFrame, units: DataFrame, sample=None, n_units: int | None = None) -> DataFrame:
    """One sample by id, or the first with exactly ``n_units`` units."""
    sizes = units.groupBy("sample").agg(F.count(F.lit(1)).alias("n_units"))
    rows = samples if sample is None else samples.filter(F.col("sample") == sample)
    rows = keyed_join(rows, sizes, ["sample"], "left").fillna(0, ["n_units"])
    if n_units is not None and sample is None:
        rows = rows.filter(F.col("n_units") == n_units)
    return rows.orderBy("sample").limit(1)


def anomaly_report(flags: DataFrame, top: int = 20) -> DataFrame:
    """Widest flagged units of each sample with the sample's counts per flag."""
    names = ("SPREAD", "FAR_UNLINK", "OVERLAP")
    counts = flags.groupBy("sample").agg(
        F.count_if(F.col("flags").isNotNull()).alias("n_units"), F.count_if(F.size("flags") > 0).alias("n_flagged"),
        *[F.count_if(F.array_contains("flags", n)).alias(f"n_{n.lower()}") for n in names])
    worst = first_rows(flags.filter(F.size("flags") > 0).select("sample", "unit", "spread", "coverage", "flags"),
                       ["sample"], [F.col("spread").desc(), F.col("unit").asc()], top)
    return keyed_join(worst, counts, ["sample"])


def near_size_overlap(df: DataFrame, feature: str, label: str) -> DataFrame:
    """Rows inside the range of the feature that both classes reach, with that range."""
    lo = df.groupBy(label).agg(F.min(feature).alias("v")).agg(F.max("v").alias("v")).scalar()
    hi = df.groupBy(label).agg(F.max(feature).alias("v")).agg(F.min("v").alias("v")).scalar()
    return df.withColumns({"overlap_low": lo, "overlap_high": hi}).filter(
        F.col(feature).between(F.col("overlap_low"), F.col("overlap_high")))


def crosstab_source_bin(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of a x b with margins; margins carry ``TOTAL``."""
    out = df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping(a).alias("_ga"), F.grouping(b).alias("_gb"))
    return out.select(F.when(F.col("_ga") == 1, "TOTAL").otherwise(F.col(a)).alias(a),
                      F.when(F.col("_gb") == 1, "TOTAL").otherwise(F.col(b)).alias(b), "n")


def plan_vs_built(plan: DataFrame, built: DataFrame, by: str, key: str = "id") -> DataFrame:
    """Planned, built and lost rows per split."""
    done = plan.join(built.select(key).distinct(), key, "left_semi").groupBy(by).agg(F.count(F.lit(1)).alias("built"))
    return (plan.groupBy(by).agg(F.count(F.lit(1)).alias("planned")).join(done, by, "left").fillna(0, ["built"])
            .withColumn("lost", F.col("planned") - F.col("built")))


def funnel_counts(log: DataFrame, kept: str = "kept") -> DataFrame:
    """Events per step and reason with the step's share of all events and of kept ones."""
    counts = log.groupBy("step", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("step") == kept).alias("k"))
    total = counts.agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    return counts.select("step", "reason", "n", share(F.col("n"), total.select("n").scalar()).alias("pct"),
                         share(F.col("k"), total.select("k").scalar()).alias("kept_share"))


def failure_taxonomy(log: DataFrame) -> DataFrame:
    """Outcomes and exception types with their share of all attempts.

    ``log`` is ``(outcome, exception_type)`` with outcome ok / out_of_scope / failed.
    """
    counts = log.groupBy("outcome", "exception_type").agg(F.count(F.lit(1)).alias("n"))
    total = log.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("pct", share(F.col("n"), total))


def projection_from_prior(prior: DataFrame, targets: DataFrame, loss: float, cap_source: str, cap: float) -> DataFrame:
    """Expected kept rows per (source, bin) from past shares.

    ``prior`` is ``(source, bin)`` rows, ``targets`` ``(source, target)``.  A source without
    history takes the overall shares; one source is capped to ``cap`` of everything kept.
    """
    per = prior.groupBy("source", "bin").agg(F.count(F.lit(1)).alias("n"))
    own = per.groupBy("source").agg(F.sum("n").alias("total"))
    overall = per.groupBy("bin").agg(F.sum("n").alias("n"))
    grand = overall.agg(F.sum("n")).scalar()
    shares = per.join(own, "source").select("source", "bin", ratio(F.col("n"), F.col("total")).alias("p"))
    kept = targets.select("source", (F.col("target") * F.lit(1.0 - loss)).alias("kept"))
    limit = kept.agg(F.sum("kept") * F.lit(cap)).scalar()
    kept = kept.withColumn("kept", F.when(F.col("source") == cap_source, F.least("kept", limit)).otherwise(F.col("kept")))
    seen = kept.join(shares, "source")
    bins = overall.select(F.struct("bin", ratio(F.col("n"), grand).alias("p")).alias("b")).agg(F.collect_list("b")).scalar()
    unseen = (kept.join(own.select("source"), "source", "left_anti")
              .withColumn("b", F.explode(bins)).select("source", "kept", "b.bin", "b.p"))
    return seen.unionByName(unseen).select("source", "bin", (F.col("kept") * F.col("p")).alias("expected"))


def confusion_matrix(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Counts of every (truth, predicted) combination that occurs."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def reproduction_diff(published: DataFrame, recomputed: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Published and recomputed values side by side; a side that lacks the key is NULL."""
    a = published.select(*keys, F.col(value).alias("published"))
    b = recomputed.select(*keys, F.col(value).alias("recomputed"))
    return a.join(b, list(keys), "full").withColumn("delta", F.abs(F.col("recomputed") - F.col("published")))


def mean_std_report(df: DataFrame, by: Sequence[str], value: str, ddof: int) -> DataFrame:
    """Mean and standard deviation over runs; ``ddof`` 1 for samples, 0 for populations."""
    std = F.stddev_samp(value) if ddof == 1 else F.stddev_pop(value)
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), std.alias("std"), F.count(F.lit(1)).alias("n"))
