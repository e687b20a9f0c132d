"""Selection, balancing, splitting and capping.

Random orders come from hashes of ``seed|key`` (see ``functions.order``), so every
operator gives the same rows on any cluster layout.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.order import hash_index, hash_key
from ..scale import Carry, first_rows, keyed_join, materialize, plan_bytes, prefix_scan, ranked, setting

UNIT = ["sample", "unit"]


# ------------------------------------------------------------------ units of a sample


def first_k_units(units: DataFrame, k: int, order: str = "unit") -> DataFrame:
    """The first k units of each sample."""
    return first_rows(units, ["sample"], [F.col(order).asc()], k)


def density_top_k(units: DataFrame, nodes: DataFrame, k: int, order: str = "unit") -> DataFrame:
    """The k units with most call nodes (an API, or a call mnemonic where there is one)."""
    is_call = F.col("api").isNotNull()
    if "mnemonic" in nodes.columns:
        is_call = is_call | (F.col("mnemonic") == "call")
    dense = nodes.filter(is_call).groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n_calls"))  # unit names repeat across samples
    with_n = units.join(dense, UNIT, "left").withColumn("n_calls", F.coalesce("n_calls", F.lit(0)))
    return first_rows(with_n, ["sample"], [F.col("n_calls").desc(), F.col(order).asc()], k)


def spread_top_k(units: DataFrame, k: int, order: str = "unit") -> DataFrame:
    """k units evenly spaced over the order: the first of each of k equal stretches."""
    pos = ranked(units, ["sample"], [F.col(order).asc()], "_pos", 0)
    sizes = units.groupBy("sample").agg(F.count(F.lit(1)).alias("_n"))
    step = lambda p: F.floor(p * F.lit(k) / F.col("_n"))
    keep = (F.col("_n") <= k) | (F.col("_pos") == 0) | (step(F.col("_pos")) != step(F.col("_pos") - 1))
    return keyed_join(pos, sizes, ["sample"]).filter(keep).drop("_pos", "_n")


def evidence_first_top_k(units: DataFrame, evidence: DataFrame, k: int, order: str = "unit") -> DataFrame:
    """Up to k units per sample, those with evidence before the rest, in order within both."""
    has = evidence.select(*UNIT).distinct().withColumn("has_evidence", F.lit(True))
    tagged = units.join(has, UNIT, "left").withColumn("has_evidence", F.coalesce("has_evidence", F.lit(False)))
    return first_rows(tagged, ["sample"], [F.col("has_evidence").desc(), F.col(order).asc()], k)


def drop_empty(samples: DataFrame, units: DataFrame) -> DataFrame:
    """Samples that have at least one unit, whatever their label."""
    return samples.join(units.select("sample").distinct(), "sample", "left_semi")


# ------------------------------------------------------------------ balancing


def _among_first(df: DataFrame, by: Sequence[str], order: dict[str, Column], cap: Column | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with ``_first``: whether a row is among the first ``cap`` of its group.

    Only the order columns are ranked. What comes back per group is the place of its last row inside the cap, so
    wide rows are neither sorted nor joined to their ranks. ``cap`` is a column, or a function that adds ``_cap``.
    """
    narrow = ranked(df.select(*by, *[c.alias(f"_o_{n}") for n, c in order.items()]), by, [F.col(f"_o_{n}") for n in order], "_rk")
    narrow = cap(narrow) if callable(cap) else narrow.withColumn("_cap", cap)
    place = F.struct(*[F.col(f"_o_{n}").alias(n) for n in order])
    last = narrow.filter(F.col("_rk") <= F.col("_cap")).groupBy(*by).agg(F.max(place).alias("_last"))
    here = F.struct(*[c.alias(n) for n, c in order.items()])
    joined = keyed_join(df, last, by, "left") if by else df.withColumn("_last", last.scalar())
    return joined.withColumn("_first", F.coalesce(here <= F.col("_last"), F.lit(False))).drop("_last")


def _seeded(seed: str, key: str) -> dict[str, Column]:
    return {"h": hash_key(seed, key), "key": F.col(key)}


def balance_classes(df: DataFrame, label: str, seed: str, key: str = "id") -> DataFrame:
    """Random subset with as many rows of every class as the smallest class has."""
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).scalar()
    return _among_first(df, [label], _seeded(seed, key), least).filter("_first").drop("_first")


def balance_per_group(df: DataFrame, group: str, label: str, min_samples: int, seed: str, key: str = "id") -> DataFrame:
    """Per group as many positives as negatives, negatives drawn from the whole table.

    Groups that cannot reach ``min_samples`` are skipped.  A group's negatives are the first
    n of one seeded order; they are met through their rank, not by pairing rows with groups.
    """
    pos = df.filter(F.col(label) == 1)
    neg = df.filter(F.col(label) == 0).select(key).distinct()
    n_neg = neg.agg(F.count(F.lit(1))).scalar()
    sizes = (pos.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.least("n", n_neg))
             .filter(F.col("n") >= min_samples))
    ranked_pos = ranked(pos.select(group, key).withColumn("_h", hash_key(seed, group, key)), [group],
                        [F.col("_h"), F.col(key)], "_rk")
    picked_pos = keyed_join(ranked_pos, sizes, [group]).filter(F.col("_rk") <= F.col("n"))
    ranked_neg = ranked(neg.withColumn("_h", hash_key(seed, key)), [], [F.col("_h"), F.col(key)], "_rk")
    # rank r is taken by every group that needs at least r negatives: expand ranks per group in chunks
    chunk = 100_000
    wanted = (sizes.withColumn("_c", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk))))
              .withColumn("_rk", F.explode(F.sequence(F.col("_c") * chunk + 1,
                                                      F.least(F.col("n"), (F.col("_c") + 1) * chunk)))))
    picked_neg = keyed_join(wanted, ranked_neg.select("_rk", key), ["_rk"])
    return (picked_pos.select(group, key, F.lit(1).alias(label))
            .unionByName(picked_neg.select(group, key, F.lit(0).alias(label))))


def random_subset(df: DataFrame, k: int, seed: str, key: str = "id") -> DataFrame:
    """k rows in seeded order."""
    return df.withColumn("_h", hash_key(seed, key)).orderBy("_h", key).limit(k).drop("_h")


# ------------------------------------------------------------------ splits


def stratified_split(df: DataFrame, label: str, ratio: float, seed: str, key: str = "id", within: Sequence[str] = ()) -> DataFrame:
    """Add ``split``: the first ``ratio`` of every class, inside every group ``within``, in seeded order trains."""
    by = [*within, label]
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    cap = lambda ranks: keyed_join(ranks, sizes, by).withColumn("_cap", F.round(F.col("_n") * F.lit(ratio)))
    return (_among_first(df.filter(F.col(label).isNotNull()), by, _seeded(seed, key), cap)
            .withColumn("split", F.when(F.col("_first"), "train").otherwise("test")).drop("_first"))


def group_shuffle_split(df: DataFrame, group: str, ratio: float, seed: str) -> DataFrame:
    """Add ``split`` with whole groups on one side; the test side gets the rounded-up share of groups."""
    groups = df.select(group).distinct()
    total = groups.agg(F.count(F.lit(1))).scalar()
    n_test = F.ceil(F.round((1 - F.lit(ratio)) * total, 9))
    order = ranked(groups.withColumn("_h", hash_key(seed, group)), [], [F.col("_h"), F.col(group)], "_rk")
    sides = order.select(group, F.when(F.col("_rk") <= n_test, "test").otherwise("train").alias("split"))
    return keyed_join(df, sides, [group])


def group_key(df: DataFrame, cluster: str = "cluster", key: str = "id") -> DataFrame:
    """Add ``group_key``: the near-duplicate cluster, or the row itself when it has none."""
    return df.withColumn("group_key", F.coalesce(F.nullif(F.col(cluster).cast("string"), F.lit("")),
                                                 F.col(key).cast("string")))


def _greedy_runs(k: int):
    """Fold plan for runs of equal-sized groups, largest size first.

    Putting ``count`` groups of one size, one after another, into the emptiest fold fills
    levels: a fold joins once the others have caught up with it, and from then on takes
    turns.  So a run is described by at most k stretches with a fixed turn order each.
    """
    import pandas as pd

    def plan(pdf: "pd.DataFrame") -> "pd.DataFrame":
        loads, out = [0] * k, []
        for size, count in sorted(zip(pdf["size"], pdf["count"]), reverse=True):
            size, count = int(size), int(count)
            level = [x // size for x in loads]
            marks = sorted(set(level))
            at, stretches = 0, []
            for i, mark in enumerate(marks):
                turn = sorted((f for f in range(k) if level[f] <= mark), key=lambda f: (loads[f] % size, f))
                room = len(turn) * (marks[i + 1] - mark) if i + 1 < len(marks) else count
                stretches.append({"begin": at, "turn": turn})
                at += room
                if at >= count:
                    break
            for i, s in enumerate(stretches):
                end = min(count, stretches[i + 1]["begin"] if i + 1 < len(stretches) else count)
                whole, rest = divmod(max(0, end - s["begin"]), len(s["turn"]))
                for j, f in enumerate(s["turn"]):
                    s.setdefault("gain", {})[f] = (whole + (j < rest)) * size
            for s in stretches:
                for f, g in s.pop("gain").items():
                    loads[f] += g
            out.append({"size": size, "stretches": stretches})
        return pd.DataFrame(out, columns=["size", "stretches"])

    return plan


def group_kfold(df: DataFrame, group: str, k: int, method: str = "greedy", seed: str = "42") -> DataFrame:
    """Add ``fold`` (0..k-1) without ever splitting a group.

    ``greedy``: largest group first into the smallest fold, first fold on ties, groups of one
    size in seeded order.  Only the table of distinct sizes is worked through in sequence; the
    sizes of N rows have at most sqrt(2N) distinct values.  ``snake``: rank by size modulo 2k.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size")).withColumn("_h", hash_key(seed, group))
    if method == "snake":
        order = ranked(sizes, [], [F.col("size").desc(), F.col("_h"), F.col(group)], "_rk", 0)
        turn = F.col("_rk") % (2 * k)
        folds = order.select(group, F.when(turn < k, turn).otherwise(2 * k - 1 - turn).alias("fold"))
        return keyed_join(df, folds, [group])
    runs = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("count"))
    plan = (runs.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(
        _greedy_runs(k), "size long, stretches array<struct<begin: bigint, turn: array<int>>>"))
    order = keyed_join(ranked(sizes, ["size"], [F.col("_h"), F.col(group)], "_t", 0), plan, ["size"])
    now = F.expr("element_at(filter(stretches, s -> s.begin <= _t), -1)")
    folds = order.withColumn("_s", now).select(group, F.expr(
        "element_at(_s.turn, cast((_t - _s.begin) % size(_s.turn) as int) + 1)").cast("long").alias("fold"))
    return keyed_join(df, folds, [group])


def carve_validation(df: DataFrame, group: str, label: str, frac: float = 0.15, min_neg: int = 40,
                     max_frac: float = 0.35, step: float = 0.05, seed: str = "20261008") -> DataFrame:
    """Add ``split`` with whole groups carved off for validation.

    Groups enter in seeded order until ``frac`` of the rows is reached; the share grows by
    ``step`` until ``min_neg`` negatives are in or ``max_frac`` is reached.  All shares are
    evaluated in one pass over the running sizes.
    """
    groups = (df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 0).alias("n_neg"))
              .withColumn("_h", hash_key(seed, group)))
    scan = prefix_scan(groups, [], [F.col("_h"), F.col(group)], before=Carry("sum", F.col("n")))
    total = df.agg(F.count(F.lit(1))).scalar()
    ladder = [frac]
    while ladder[-1] < max_frac:
        ladder.append(ladder[-1] + step)
    target = lambda f: F.floor(F.lit(f) * total)
    negs = scan.agg(*[F.coalesce(F.sum(F.when(F.col("before") < target(f), F.col("n_neg"))), F.lit(0)).alias(f"n{i}")
                      for i, f in enumerate(ladder)])
    pick = F.coalesce(*[F.when(F.col(f"n{i}") >= min_neg, F.lit(f)) for i, f in enumerate(ladder)], F.lit(ladder[-1]))
    chosen = negs.select(pick.alias("f")).scalar()
    sides = scan.select(group, F.when(F.col("before") < F.floor(chosen * total), "val").otherwise("train").alias("split"))
    return keyed_join(df, sides, [group])


def leave_one_group_out(df: DataFrame, family: str, label: str, fixed_negatives: Column) -> DataFrame:
    """One row per (held-out family, row, role).

    Positives of the held-out family test, those of other families train; negatives train,
    except the fixed ones, which test in every round.  Families are as many as models to be
    fitted, so their list is one array value.
    """
    positives = df.filter(F.col(label) == 1)
    families = positives.agg(F.array_sort(F.collect_set(family))).scalar()
    role = (F.when(F.col(label) == 1, F.when(F.col(family) == F.col("held_out"), "test").otherwise("train"))
            .when(fixed_negatives, "test").otherwise("train"))
    return df.withColumn("held_out", F.explode(families)).withColumn("role", role)


# ------------------------------------------------------------------ caps


def source_cap(df: DataFrame, source: str, value: str, k: int, seed: str, key: str = "id") -> DataFrame:
    """Keep k random rows of one source and every row of the others."""
    mine = F.coalesce(F.col(source) == value, F.lit(False))
    return df.filter(~mine).unionByName(random_subset(df.filter(mine), k, seed, key))


def vendor_fraction_cap(df: DataFrame, vendor: str, value: str, frac: float, key: str = "id") -> DataFrame:
    """Limit one vendor to ``frac`` of the current rows, keeping the first by key."""
    mine = F.coalesce(F.col(vendor) == value, F.lit(False))
    cap = F.floor(F.lit(frac) * df.agg(F.count(F.lit(1))).scalar())
    kept = _among_first(df.filter(mine), [], {"key": F.col(key)}, cap).filter("_first").drop("_first")
    return df.filter(~mine).unionByName(kept)


def _named(col: str) -> Column:
    """A join key that a null has as well."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit(""))


def vendor_limits(df: DataFrame, bin: str, vendor: str, frac: float) -> DataFrame:
    """(_bin, _limit): the most rows per vendor of each bin with which no vendor has more than ``frac`` of what stays.

    A cut lowers the bin's total and so the limit itself; this is the fixed point. With vendors in order of size, what stays
    is the least, over j, of the j smallest in full plus the limit for all others, so the limit is the least bound
    that any j gives. Where ``frac`` times the vendors is below 1 only an empty bin obeys, and the limit is 0. Only
    (bin, vendor) counts are looked at.
    """
    counts = df.groupBy(_named(bin).alias("_bin"), _named(vendor).alias("_vendor")).agg(F.count(F.lit(1)).alias("_n"))
    scan = prefix_scan(counts, ["_bin"], [F.col("_n").asc(), F.col("_vendor").asc()], _sum=Carry("sum", F.col("_n")), _j=Carry("count"))
    scan = keyed_join(scan, counts.groupBy("_bin").agg(F.count(F.lit(1)).alias("_m")), ["_bin"])

    def bound(j: Column, total: Column) -> Column:
        share = F.lit(1.0) - F.lit(float(frac)) * (F.col("_m") - j)
        return F.when(share > 1e-12, F.lit(float(frac)) * total / share)
    # before the row: its smaller vendors in full; after the last row: all of them
    bounds = F.least(bound(F.col("_j"), F.col("_sum")), bound(F.col("_j") + 1, F.col("_sum") + F.col("_n")))
    return scan.groupBy("_bin").agg(F.floor(F.min(bounds) + 1e-9).alias("_limit"))


def vendor_cap_per_bin(df: DataFrame, bin: str, vendor: str, frac: float, seed: str, key: str = "id", short: str = "drop") -> DataFrame:
    """The largest part of ``df`` in which no vendor has more than ``frac`` of its bin, for all bins and vendors at once.

    Of a vendor above the limit the first rows in seeded order stay. A null bin or vendor is one of its own. Bins with too
    few vendors for any part to obey are dropped, or left as they are with ``short="keep"``.
    """
    limits = vendor_limits(df, bin, vendor, frac)
    named = df.withColumns({"_bin": _named(bin), "_vendor": _named(vendor)})
    limits = materialize(limits)
    cap = lambda ranks: keyed_join(ranks, limits.withColumnRenamed("_limit", "_cap"), ["_bin"])
    marked = _among_first(named, ["_bin", "_vendor"], _seeded(seed, key), cap)
    if short == "keep":
        marked = keyed_join(marked, limits, ["_bin"]).withColumn("_first", F.col("_first") | (F.col("_limit") == 0)).drop("_limit")
    return marked.filter("_first").select(*df.columns)


def bin_fraction_cap(df: DataFrame, pred: Column, frac: float, overflow_split: str, seed: str,
                     key: str = "id") -> DataFrame:
    """Add ``split``: rows matching ``pred`` train only up to ``frac`` of all training rows."""
    mine = F.coalesce(pred, F.lit(False))
    others = df.filter(~mine)
    cap = F.floor(F.lit(frac) * others.agg(F.count(F.lit(1))).scalar() / F.lit(1.0 - frac))
    capped = (_among_first(df.filter(mine), [], _seeded(seed, key), cap)
              .withColumn("split", F.when(F.col("_first"), "train").otherwise(overflow_split)).drop("_first"))
    return others.withColumn("split", F.lit("train")).unionByName(capped)


def per_group_top_n(df: DataFrame, by: str, n: int, order: Sequence[Column], size: str | None = None,
                    size_cap: int | None = None) -> DataFrame:
    """The first n rows of each group in the given order among those within the size cap."""
    rows = df if size_cap is None else df.filter((F.col(size) > 0) & (F.col(size) <= size_cap))
    return first_rows(rows, [by], order, n)


def quota_round_robin(df: DataFrame, stratum: str, cls: str, quotas: DataFrame, seed: str, key: str = "id") -> DataFrame:
    """Fill each stratum's quota by taking turns over its classes in seeded order.

    ``quotas`` is ``(stratum, quota)``.  Row ranks past the quota can never be taken, so
    they are dropped before the turns are counted.
    """
    hashed = df.withColumns({"_h": hash_key(seed, key), "_c": hash_key(seed, cls)})
    inner = ranked(hashed, [stratum, cls], [F.col("_h"), F.col(key)], "_rk")
    inner = keyed_join(inner, quotas, [stratum]).filter(F.col("_rk") <= F.col("quota"))
    turns = ranked(inner, [stratum], [F.col("_rk"), F.col("_c"), F.col(cls), F.col(key)], "turn")
    return turns.filter(F.col("turn") <= F.col("quota")).drop("_h", "_c", "_rk", "quota")


def weighted_interleave(a: DataFrame, b: DataFrame, wa: int, wb: int, seed: str, key: str = "id") -> DataFrame:
    """Merge two lists, each in seeded order, wa rows of one then wb of the other; add ``position``."""
    def placed(df: DataFrame, width: int, shift: int, name: str) -> DataFrame:
        rows = ranked(df.select(key).withColumn("_h", hash_key(seed, key)), [], [F.col("_h"), F.col(key)], "_i", 0)
        at = F.floor(F.col("_i") / width) * (wa + wb) + shift + F.col("_i") % width
        return rows.select(key, F.lit(name).alias("list"), at.alias("_at"))
    both = placed(a, wa, 0, "a").unionByName(placed(b, wb, wa, "b"))
    return ranked(both, [], [F.col("_at")], "position", 0).drop("_at")


def negative_pair_sampling(sizes: DataFrame, positives: DataFrame, ratio: int = 3, seed: str = "0") -> DataFrame:
    """Node pairs with weak labels: the graph's positives and ``ratio`` times as many random others.

    ``sizes`` is ``(graph, n)``, ``positives`` ``(graph, i, j)``.  A graph without positives
    gets ``min(4, n)`` negatives; graphs of fewer than two nodes get nothing, and neither do graphs
    whose pairs are all positive.  Pairs are drawn with replacement, by numbered tries; the first
    free ones count.  Graphs that fall short draw again, with twice as many tries, until they have
    all they want.  Tries are expanded in chunks, so one large graph is spread over tasks.
    """
    graphs = sizes.filter(F.col("n") >= 2)
    pos = keyed_join(positives, graphs, ["graph"]).filter((F.col("i") < F.col("n")) & (F.col("j") < F.col("n")))
    known = pos.select("graph", "i", "j").distinct()
    counts = pos.groupBy("graph").agg(F.count(F.lit(1)).alias("n_pos"))
    used = known.filter("i <> j").groupBy("graph").agg(F.count(F.lit(1)).alias("n_used"))
    need = (graphs.join(counts, "graph", "left").join(used, "graph", "left")
            .filter(F.coalesce("n_used", F.lit(0)) < F.col("n") * (F.col("n") - 1))
            .withColumn("n_neg", F.when(F.col("n_pos") > 0, F.col("n_pos") * ratio)
                        .otherwise(F.least(F.lit(4), F.col("n"))).cast("long")).select("graph", "n", "n_neg"))
    need = materialize(need.filter("n_neg > 0").withColumns({"first": F.lit(0).cast("long"), "stop": F.col("n_neg") * 2, "have": F.lit(0).cast("long")}))
    taken = None
    while not need.isEmpty():
        chunk = 100_000
        chunks = need.withColumn("_c", F.explode(F.sequence(F.lit(0), F.floor((F.col("stop") - F.col("first") - 1) / chunk))))
        if plan_bytes(sizes) > setting(sizes, "tallyforge.smallBytes"):
            chunks = chunks.repartition("graph", "_c")
        tries = chunks.withColumn("t", F.explode(F.sequence(
            F.col("first") + F.col("_c") * chunk, F.least(F.col("stop"), F.col("first") + (F.col("_c") + 1) * chunk) - 1)))
        drawn = tries.select("graph", "n_neg", "have", "t", hash_index(seed, F.col("n"), "graph", "t", F.lit("i")).alias("i"),
                             hash_index(seed, F.col("n"), "graph", "t", F.lit("j")).alias("j"))
        free = drawn.filter(F.col("i") != F.col("j")).join(known, ["graph", "i", "j"], "left_anti")
        new = materialize(ranked(free, ["graph"], [F.col("t")], "_rk").filter(F.col("have") + F.col("_rk") <= F.col("n_neg"))
                          .select("graph", "i", "j"))
        taken = new if taken is None else taken.unionByName(new)
        got = new.groupBy("graph").agg(F.count(F.lit(1)).alias("got"))
        need = materialize(need.join(got, "graph", "left").withColumn("have", F.col("have") + F.coalesce("got", F.lit(0)))
                           .filter("have < n_neg").select("graph", "n", "n_neg", F.col("stop").alias("first"),
                                                          (F.col("stop") * 3 - F.col("first") * 2).alias("stop"), "have"))
    out = pos.select("graph", "i", "j", F.lit(1).alias("label"))
    return out if taken is None else out.unionByName(taken.select("graph", "i", "j", F.lit(0).alias("label")))
