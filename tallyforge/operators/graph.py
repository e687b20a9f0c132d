"""Call graphs, components, remapping and pooling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..scale import keyed_join, materialize, ranked


def unit_index(units: DataFrame, order: str = "addr") -> DataFrame:
    """Dense position of a unit by numeric address, never by its name."""
    return ranked(units, ["sample"], [F.col(order).cast("long"), F.col("unit")], "idx", 0)


def call_graph_edges(call_sites: DataFrame, units: DataFrame) -> DataFrame:
    """Distinct (caller_idx, callee_idx) between known units; self loops stay.

    ``call_sites`` is ``(sample, src, dst)`` with one row per site, ``units`` has ``idx``.
    """
    index = units.select("sample", "unit", "idx")
    hops = keyed_join(call_sites.select("sample", "src", "dst").distinct(),
                      index.select("sample", F.col("unit").alias("src"), F.col("idx").alias("caller_idx")),
                      ["sample", "src"])
    hops = keyed_join(hops, index.select("sample", F.col("unit").alias("dst"), F.col("idx").alias("callee_idx")),
                      ["sample", "dst"])
    return hops.select("sample", "caller_idx", "callee_idx").distinct()


def resolve_thunks(targets: DataFrame, hops: DataFrame, depth: int = 2) -> DataFrame:
    """APIs a call target stands for: itself, or what at most ``depth`` thunk hops lead to.

    ``targets`` is ``(id, kind, name)`` with kind api / thunk / other, ``hops`` is ``(src, dst)``.
    """
    kinds = targets.select(F.col("id").alias("at"), "kind", "name")
    steps = hops.select("src", "dst").distinct()
    front = targets.select(F.col("id").alias("target"), F.col("id").alias("at"), "kind", "name")
    found = front.filter("kind = 'api'").select("target", "name", F.lit(0).alias("hops"))
    for d in range(1, depth + 1):
        moved = (front.filter("kind = 'thunk'").select("target", F.col("at").alias("src"))
                 .join(steps, "src").select("target", F.col("dst").alias("at")))
        front = keyed_join(moved, kinds, ["at"])
        found = found.unionByName(front.filter("kind = 'api'").select("target", "name", F.lit(d).alias("hops")))
    return found


def api_histogram(calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Calls per API."""
    return calls.groupBy(*by, "api").agg(F.count(F.lit(1)).alias("n"))


def unique_apis(calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct API names, one per row so that no group is gathered."""
    return calls.select(*by, "api").distinct()


def call_count_two_ways(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """API calls per sample counted by call site and by call-graph edge; the two differ on purpose."""
    sites = calls.groupBy("sample").agg(F.count(F.lit(1)).alias("n_call_sites"))
    links = edges.groupBy("sample").agg(F.count(F.lit(1)).alias("n_graph_calls"))
    return sites.join(links, "sample", "full").fillna(0, ["n_call_sites", "n_graph_calls"])


def connected_components(pairs: DataFrame, vertices: DataFrame | None = None,
                         src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component) with the smallest member as the component's name.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): every round
    moves all neighbours of a vertex to their smallest one, which ends after a number of
    rounds logarithmic in the size of the component, hubs included.
    """
    edges = materialize(pairs.filter(F.col(src) != F.col(dst))
                        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct())
    mark = _signature(edges)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        edges = materialize(_small_star(_large_star(edges)))
        now = _signature(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    labels = leaves.unionByName(roots)
    if vertices is None:
        return labels
    return (keyed_join(vertices.select("id").distinct(), labels, ["id"], "left")
            .withColumn("component", F.coalesce("component", "id")))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return (keyed_join(both, low, ["u"]).filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = (keyed_join(edges, low, ["u"]).filter(F.col("v") != F.col("m"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def induced_subgraph_remap(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges with both ends selected, renumbered.

    ``edges`` is ``(sample, src, dst)`` over unit positions, ``selected`` is
    ``(sample, pos, new_idx)``.
    """
    a = selected.select("sample", F.col("pos").alias("src"), F.col("new_idx").alias("new_src"))
    b = selected.select("sample", F.col("pos").alias("dst"), F.col("new_idx").alias("new_dst"))
    return keyed_join(keyed_join(edges, a, ["sample", "src"]), b, ["sample", "dst"]) \
        .select("sample", F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))


def bounded_edges(edges: DataFrame, sizes: DataFrame, by: Sequence[str] = ("sample",)) -> DataFrame:
    """Drop edges with an endpoint at or past its graph's size ``(by..., n)``."""
    return (keyed_join(edges, sizes, list(by))
            .filter((F.col("src") < F.col("n")) & (F.col("dst") < F.col("n"))).drop("n"))


def _pool(vectors: DataFrame, by: Sequence[str], col: str, fn) -> DataFrame:
    cells = vectors.select(*by, F.posexplode(col).alias("pos", "x"))
    pooled = cells.groupBy(*by, "pos").agg(fn(F.col("x").cast("double")).alias("x"))
    # one entry per dimension
    return (pooled.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("cells"))
            .select(*by, F.col("cells.x").alias("vector")))


def pool_max(vectors: DataFrame, by: Sequence[str], col: str = "embedding") -> DataFrame:
    """Elementwise maximum of the vectors of each group."""
    return _pool(vectors, by, col, F.max)


def pool_mean(vectors: DataFrame, by: Sequence[str], col: str = "embedding") -> DataFrame:
    """Elementwise mean of the vectors of each group."""
    return _pool(vectors, by, col, F.avg)
