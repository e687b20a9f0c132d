"""Ordered and windowed pattern matching over call sequences.

Calls are ``(sample, unit, node_id, api, position)`` with one position per call of a unit.
No operator gathers a whole unit: a chain can only use calls within
``(steps - 1) * window`` positions of its first call, so that stretch is all that is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..scale import Carry, keyed_join, materialize, prefix_scan
from .rules import CHAIN, FAMILY, SET

UNIT = ["sample", "unit"]
EDGE = ["sample", "unit", "src", "dst", "technique_id", "rule_name", "confidence"]
INDICATOR = ["sample", "unit", "node_id", "technique_id", "rule_name"]


def _chain_fold(seq: str, window: int, apis: str = "apis") -> str:
    """Greedy walk of ``apis`` over the position-sorted array ``seq`` (no backtracking), as an SQL expression."""
    return f"""
        aggregate({apis},
          named_struct('at', cast(null as bigint), 'open', true,
                       'found', cast(array() as array<struct<position: bigint, node_id: string>>)),
          (acc, step) -> if(not acc.open, acc,
            aggregate(
              array(try_element_at(filter({seq}, c -> c.api = step and (acc.at is null or c.position > acc.at)), 1)),
              acc,
              (keep, hit) -> if(hit is null or hit.position - keep.at > {int(window)},
                named_struct('at', keep.at, 'open', false, 'found', keep.found),
                named_struct('at', hit.position, 'open', true, 'found',
                  concat(keep.found, array(named_struct('position', hit.position,
                         'node_id', hit.node_id))))))),
          acc -> acc.found)"""


def _pairs(found: str = "found") -> Column:
    return F.expr(f"""
        transform(sequence(1, size({found}) - 1), i -> named_struct(
            'src', element_at({found}, i).node_id, 'dst', element_at({found}, i + 1).node_id))""")


def _chain_rules(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("mode") == CHAIN).select("technique_id", "rule_name", "apis", "min_len")


def _chain_calls(calls: DataFrame, rules: DataFrame) -> DataFrame:
    steps = _chain_rules(rules).withColumn("api", F.explode(F.array_distinct("apis")))
    return (calls.join(steps, "api")
            .withColumn("position", F.col("position").cast("long"))
            .withColumn("node_id", F.col("node_id").cast("string")))


def _chain_starts(matched: DataFrame) -> DataFrame:
    return (matched.filter(F.col("api") == F.element_at("apis", 1))
            .groupBy(*UNIT, "technique_id").agg(F.min("position").alias("start")))


def _stretch(matched: DataFrame, starts: DataFrame, window: int) -> DataFrame:
    reach = (F.size("apis") - 1) * F.lit(int(window))
    return (keyed_join(matched, starts, [*UNIT, "technique_id"])
            .filter(F.col("position").between(F.col("start"), F.col("start") + reach)))


def _seq() -> Column:
    return F.sort_array(F.collect_list(F.struct("position", "node_id", "api")))


def _chains(matched: DataFrame, window: int) -> DataFrame:
    near = _stretch(matched, _chain_starts(matched), window)
    return (near.groupBy(*UNIT, "technique_id", "rule_name", "apis", "min_len").agg(_seq().alias("seq"))
            .withColumn("found", F.expr(_chain_fold("seq", window))))


def ordered_chain(calls: DataFrame, rules: DataFrame, window: int = 8) -> DataFrame:
    """Edges between consecutive steps of each rule's greedy chain."""
    return _chain_edges(_chain_calls(calls, rules), window)


def _chain_edges(matched: DataFrame, window: int) -> DataFrame:
    return (_chains(matched, window)
            .filter(F.size("found") >= F.greatest(F.col("min_len"), F.lit(2)))
            .withColumn("confidence", F.when(F.size("found") == F.size("apis"), "full_chain")
                        .otherwise("partial_chain"))
            .withColumn("pair", F.explode(_pairs()))
            .select(*UNIT, "pair.src", "pair.dst", "technique_id", "rule_name", "confidence"))


def _matched_calls(calls: DataFrame, rules: DataFrame, mode: str) -> DataFrame:
    cols = ["technique_id", "rule_name", "singleton"]
    calls = calls.withColumn("node_id", F.col("node_id").cast("string"))
    if mode == SET:
        wanted = (rules.filter(F.col("mode") == SET)
                  .select(*cols, F.explode(F.array_distinct("apis")).alias("api")))
        return calls.join(wanted, "api")
    families = rules.filter(F.col("mode") == FAMILY).select(*cols, "prefixes")
    # every head of a distinct API name meets the prefixes in an equi-join, then names meet the calls
    heads = (calls.select("api").distinct().filter(F.length("api") > 0)
             .withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.length("api")),
                                                         lambda i: F.substring("api", F.lit(1), i)))))
    names = (heads.join(families.withColumn("prefix", F.explode("prefixes")), "prefix")
             .select("api", *cols).distinct())
    return keyed_join(calls, names.groupBy("api").agg(F.collect_list(F.struct(*cols)).alias("hit")), ["api"]) \
        .withColumn("hit", F.explode("hit")).select(*calls.columns, "hit.*")


def _adjacent(matched: DataFrame, window: int) -> DataFrame:
    scan = prefix_scan(matched, [*UNIT, "technique_id"], [F.col("position").asc()],
                       before=Carry("prev", F.struct(F.col("node_id").alias("node"), F.col("position").alias("at"))))
    return (scan.filter(F.col("position") - F.col("before.at") <= int(window))
            .select(*UNIT, F.col("before.node").alias("src"), F.col("node_id").alias("dst"),
                    "technique_id", "rule_name", F.lit("co_occurrence").alias("confidence")))


def set_cooccurrence(calls: DataFrame, rules: DataFrame, window: int = 8) -> DataFrame:
    """Edges between neighbouring calls out of a rule's API set, in any order, within the window."""
    return _adjacent(_matched_calls(calls, rules, SET), window)


def family_sequence(calls: DataFrame, rules: DataFrame, window: int = 8) -> DataFrame:
    """As ``set_cooccurrence`` for APIs that start with one of the rule's prefixes."""
    return _adjacent(_matched_calls(calls, rules, FAMILY), window)


def _hits(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Calls matched against the rules of all modes at once, written: every branch starts from here.

    Rules meet the distinct API names first; one pass over the calls then picks up each name's rules.
    """
    cols = ["mode", "technique_id", "rule_name", "apis", "min_len", "singleton"]
    names = materialize(calls.select("api").distinct().filter(F.length("api") > 0))
    named = rules.filter(F.col("mode") != FAMILY).select(F.explode(F.array_distinct("apis")).alias("api"), *cols).join(names, "api")
    heads = names.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.length("api")),
                                                             lambda i: F.substring("api", F.lit(1), i))))
    families = rules.filter(F.col("mode") == FAMILY).withColumn("prefix", F.explode("prefixes")).select("prefix", *cols)
    met = named.unionByName(heads.join(families, "prefix").select("api", *cols).distinct())
    by_name = met.groupBy("api").agg(F.collect_list(F.struct(*cols)).alias("hit"))
    slim = calls.select(*UNIT, F.col("node_id").cast("string").alias("node_id"), "api", F.col("position").cast("long").alias("position"))
    return materialize(keyed_join(slim, by_name, ["api"]).withColumn("hit", F.explode("hit")).select(*slim.columns, "hit.*"))


def _pair_edges(hits: DataFrame, window: int) -> DataFrame:
    return (_adjacent(hits.filter(F.col("mode") == SET), window)
            .unionByName(_adjacent(hits.filter(F.col("mode") == FAMILY), window)))


def _singles(matched: DataFrame, pair_edges: DataFrame) -> DataFrame:
    ends = (pair_edges.withColumn("node_id", F.explode(F.array("src", "dst")))
            .select(*UNIT, "technique_id", "node_id").distinct())
    return (matched.filter("singleton").join(ends, [*UNIT, "technique_id", "node_id"], "left_anti").select(*INDICATOR))


def singleton_indicators(calls: DataFrame, pair_edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Matched calls whose node takes part in no pair; rules may switch these off."""
    return _singles(_matched_calls(calls, rules, SET).unionByName(_matched_calls(calls, rules, FAMILY)), pair_edges)


def seed_edges(calls: DataFrame, rules: DataFrame, window: int = 8) -> DataFrame:
    """Edges of every rule."""
    hits = _hits(calls, rules)
    return _chain_edges(hits.filter(F.col("mode") == CHAIN), window).unionByName(_pair_edges(hits, window))


def seed_evidence(calls: DataFrame, rules: DataFrame, window: int = 8) -> DataFrame:
    """Edges and indicators in one table, told apart by ``kind``."""
    hits = _hits(calls, rules)
    pairs = _pair_edges(hits, window)
    edges = _chain_edges(hits.filter(F.col("mode") == CHAIN), window).unionByName(pairs)
    singles = _singles(hits.filter(F.col("mode") != CHAIN), pairs)
    return (edges.withColumn("kind", F.lit("edge"))
            .unionByName(singles.select(*UNIT, F.col("node_id").alias("src"), F.lit(None).cast("string").alias("dst"),
                                        "technique_id", "rule_name", F.lit(None).cast("string").alias("confidence"),
                                        F.lit("indicator").alias("kind"))))


def entry_walks(matched: DataFrame, window: int) -> DataFrame:
    """(sample, unit, technique_id, step, at, tail): what a walk finds that comes into a unit at a step.

    A walk that comes from another unit takes the unit's first call of that step, wherever it came from, so one row per
    step, with its position and the nodes chosen from there on, says all. Only entries inside the window can be reached.
    """
    near = matched.filter(F.col("position") < F.size("apis") * F.lit(int(window)))
    seqs = near.groupBy(*UNIT, "technique_id", "apis").agg(_seq().alias("seq")).filter(F.size("apis") > 1)
    steps = (seqs.withColumn("step", F.explode(F.sequence(F.lit(2), F.size("apis"))))
             .filter(F.expr(f"exists(seq, c -> c.api = element_at(apis, step) and c.position < {int(window)})")))
    walks = steps.withColumn("tail", F.expr(_chain_fold("seq", window, "slice(apis, step, size(apis))")))
    return (walks.select(*UNIT, "technique_id", "step", F.try_element_at("tail", F.lit(1))["position"].alias("at"), F.col("tail")["node_id"].alias("tail"))
            .filter(F.col("at") < int(window)))


def cross_unit_chain_1hop(calls: DataFrame, call_edges: DataFrame, rules: DataFrame, window: int = 8) -> DataFrame:
    """Chains that start in a caller and end in a unit it calls directly.

    ``call_edges`` is ``(sample, src, dst)`` over units.  The callee's positions are moved behind all of the
    caller's.  A chain has to touch both units, so it starts in the caller: what the caller's own walk has reached at
    its end, the step and how far behind the end it lies, is continued with the callee's table of entries.  Units meet as
    such summaries, a row per rule and a row per rule and step, never as sequences.  A callee with a full chain of
    its own is left out.  A node id is taken to belong to one unit.
    """
    matched = materialize(_chain_calls(calls, rules))
    ends = calls.groupBy(*UNIT).agg((F.max("position").cast("long") + 1).alias("offset"))
    own = materialize(_chains(matched, window).drop("seq"))
    # a step the caller could still make lies before its end, so a state out of the window's reach of the end is closed
    state = (keyed_join(own.filter(F.size("found") < F.size("apis")), ends, UNIT)
             .withColumn("gap", F.col("offset") - F.element_at("found", -1)["position"]).filter(F.col("gap") <= int(window)))
    callers = (state.groupBy("sample", F.col("unit").alias("src"))
               .agg(F.collect_list(F.struct("technique_id", "rule_name", "min_len", "gap", (F.size("found") + 1).alias("step"),
                                            F.col("found")["node_id"].alias("head"))).alias("rule")))  # one entry per rule
    full = own.filter((F.size("found") == F.size("apis")) & (F.size("found") >= F.col("min_len"))).select(*UNIT, "technique_id")
    callees = entry_walks(matched, window).join(full, [*UNIT, "technique_id"], "left_anti").withColumnRenamed("unit", "dst")
    hops = call_edges.filter(F.col("src") != F.col("dst")).select("sample", "src", "dst").distinct()
    per_rule = keyed_join(hops, callers, ["sample", "src"]).select("sample", "dst", F.inline("rule"))
    chains = (keyed_join(per_rule, callees, ["sample", "technique_id", "dst", "step"]).filter(F.col("gap") + F.col("at") <= int(window))
              .withColumn("found", F.concat("head", "tail")).filter(F.size("found") >= F.greatest(F.col("min_len"), F.lit(2))))
    pairs = F.transform(F.sequence(F.lit(1), F.size("found") - 1),
                        lambda i: F.struct(F.element_at("found", i).alias("src"), F.element_at("found", i + 1).alias("dst")))
    return (chains.withColumn("pair", F.explode(pairs))
            .groupBy("sample", "pair.src", "pair.dst", "technique_id")
            .agg(F.min("rule_name").alias("rule_name"))
            .withColumn("confidence", F.lit("cross_function_1hop")))


def rule_caveats(report: DataFrame, rules: DataFrame) -> DataFrame:
    """Attach the known limits of a rule to every report row that names it."""
    notes = rules.filter(F.col("caveat") != "").select("technique_id", "caveat").dropDuplicates(["technique_id"])
    return keyed_join(report, notes, ["technique_id"], "left")


def structural_indicators(df: DataFrame, entropies: str, n_imports: str,
                          packed_at: float = 7.2, min_imports: int = 10) -> DataFrame:
    """Highest section entropy, import-table anomaly and the packed flag made of both."""
    top = F.coalesce(F.array_max(entropies), F.lit(0.0))
    odd = F.coalesce(F.col(n_imports) < min_imports, F.lit(False))
    return df.withColumns({"max_section_entropy": top, "has_import_table_anomaly": odd,
                           "is_likely_packed": (top >= packed_at) | odd})


def entropy_stats(df: DataFrame, col: str) -> DataFrame:
    """Mean, maximum and minimum of an array column, 0.0 when it is empty."""
    size = F.coalesce(F.size(col), F.lit(0))
    total = F.aggregate(F.col(col), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return df.withColumns({
        "mean_entropy": F.when(size > 0, total / size).otherwise(0.0),
        "max_entropy": F.coalesce(F.array_max(col).cast("double"), F.lit(0.0)),
        "min_entropy": F.coalesce(F.array_min(col).cast("double"), F.lit(0.0))})
