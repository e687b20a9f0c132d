"""Size-aware building blocks shared by every operator.

Three things go wrong first when a labelled corpus grows: a window over one very
large group runs in one task, a join on that group's key does too, and a broadcast
that was harmless outgrows the executors.  The helpers here keep the plain Spark form
while the data is small and switch to a distributed form, with the same result, when
it is not.

Settings (ordinary Spark configuration keys):

``tallyforge.smallBytes``      bytes read up to which a window is used directly
``tallyforge.broadcastBytes``  bytes read up to which a join side may be broadcast
``tallyforge.hotRows``         rows of one group above which it counts as hot
``tallyforge.spreadBytes``     bytes read per task where a row costs much work
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .functions.bits import key_value, order_key

DEFAULTS = {
    "tallyforge.smallBytes": 256 << 20,
    "tallyforge.broadcastBytes": 16 << 20,
    "tallyforge.hotRows": 20_000_000,
    "tallyforge.spreadBytes": 16 << 20,
}


#: Copies of a hot key's row.
SALTS = 64


def setting(df: DataFrame, key: str) -> int:
    return int(df.sparkSession.conf.get(key, str(DEFAULTS[key])))


def plan_bytes(df: DataFrame) -> int:
    """Bytes of all tables a plan reads after column pruning; very large when one is unknown.

    The optimizer's own figure for a join is the product of its sides, which would call any
    plan with a few joins large.
    """
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    except AttributeError:  # a session without a JVM handle
        return 1 << 62
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def may_broadcast(df: DataFrame) -> bool:
    """Inside the broadcast bound, with room for rows that explode out of few bytes."""
    size = plan_bytes(df)
    if size < 1 << 60 and "Generate " in df._jdf.queryExecution().optimizedPlan().toString():
        size *= 16
    return size <= setting(df, "tallyforge.broadcastBytes")


def is_small(df: DataFrame) -> bool:
    return plan_bytes(df) <= setting(df, "tallyforge.smallBytes")


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables: the one the cluster names."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tallyforge.sharedDir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    named = tempfile.mkdtemp(prefix="spark-")  # one machine: tests and trials
    spark.conf.set("tallyforge.sharedDir", named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyforge-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal out rows that cost much work each: all cores on a small input, ``spreadBytes`` of input a task on a large one.

    The splits of a large file hold more than that, and texts grow many times when they are taken apart. With ``keys``
    what is made of a row stays with its key, so later groupings by it need no shuffle of the parts.
    """
    size, spark = plan_bytes(df), df.sparkSession
    if size > 1 << 60:
        return df
    parts = -(-size // setting(df, "tallyforge.spreadBytes"))
    if not is_small(df):  # Spark deals out again what has fewer parts than this
        parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(parts, spark.sparkContext.defaultParallelism), *keys)


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group (one number comes back; counting is combined map-side)."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


# ------------------------------------------------------------------ joins


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a possibly skewed ``left`` to a ``right`` that has one row per key.

    Small ``right``: broadcast.  Otherwise the rest is shuffled, and rows of hot keys are salted: each
    meets one of ``SALTS`` copies of its key's row, so a hot key is spread over as many tasks.  Only the
    hot keys themselves, at most rows / hotRows of them, are broadcast, never the rows of ``right``.
    """
    keys = list(keys)
    if may_broadcast(right):
        return left.join(F.broadcast(right), keys, how)
    if is_small(left):
        return left.join(right, keys, how)
    limit = setting(left, "tallyforge.hotRows")
    hot = materialize(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
                      .filter(F.col("_n") > limit).drop("_n"))
    if hot.isEmpty():
        return left.join(right, keys, how)
    hot = F.broadcast(hot)
    cold = left.join(hot, keys, "left_anti").join(right, keys, how)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = right.join(hot, keys, "left_semi").withColumn("_salt", salts)
    warm = (left.join(hot, keys, "left_semi").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
            .join(salted, [*keys, "_salt"], how).drop("_salt"))
    return cold.unionByName(warm)


# ------------------------------------------------------------------ ordered scans


@dataclass(frozen=True)
class Carry:
    """What an ordered scan brings from the rows before the current one.

    kind: ``count`` rows, ``sum``, ``max``, ``last`` non-null value, ``prev`` row's value.
    """

    kind: str
    expr: Column | None = None


def _local(carry: Carry, name: str, window, before) -> Column:
    if carry.kind == "count":
        return F.count(F.lit(1)).over(before)
    if carry.kind == "sum":
        return F.coalesce(F.sum(name).over(before), F.lit(0))
    if carry.kind == "max":
        return F.max(name).over(before)
    if carry.kind == "last":
        return F.last(name, ignorenulls=True).over(before)
    return F.lag(name).over(window)


def prefix_scan(df: DataFrame, by: Sequence[str], order: Sequence[Column], **carries: Carry) -> DataFrame:
    """Add, per row, values carried from the earlier rows of its group.

    ``order`` has to be total.  Groups that fit a task use an ordinary window.  Otherwise
    the rows are range-partitioned by (group, order), written once, scanned slice by slice,
    and joined to what earlier slices carry over; at most one row per slice has a carry,
    so that side is bounded by the number of partitions.
    """
    by, order = list(by), list(order)
    df = df.withColumns({f"_in_{n}": c.expr if c.expr is not None else F.lit(1) for n, c in carries.items()})
    ins = [f"_in_{n}" for n in carries]
    if is_small(df) or largest_group(df, by) <= setting(df, "tallyforge.hotRows"):
        window = Window.partitionBy(*by).orderBy(*order)
        before = window.rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: _local(c, f"_in_{n}", window, before) for n, c in carries.items()}).drop(*ins)

    sliced = materialize(df.repartitionByRange(*[F.col(b) for b in by], *order)
                         .withColumn("_slice", F.spark_partition_id()))
    window = Window.partitionBy(*by, "_slice").orderBy(*order)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.withColumns({"_rn": F.row_number().over(window),
                                **{n: _local(c, f"_in_{n}", window, before) for n, c in carries.items()}})
    totals = {
        "count": lambda n: F.count(F.lit(1)),
        "sum": lambda n: F.sum(f"_in_{n}"),
        "max": lambda n: F.max(f"_in_{n}"),
        "last": lambda n: F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), F.col("_rn"))),
        "prev": lambda n: F.max_by(f"_in_{n}", F.col("_rn")),
    }
    slices = local.groupBy(*by, "_slice").agg(*[totals[c.kind](n).alias(f"_t_{n}") for n, c in carries.items()])
    across = Window.partitionBy(*by).orderBy("_slice")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    combine = {
        "count": lambda c: F.sum(c).over(earlier),
        "sum": lambda c: F.sum(c).over(earlier),
        "max": lambda c: F.max(c).over(earlier),
        "last": lambda c: F.last(c, ignorenulls=True).over(earlier),
        "prev": lambda c: F.lag(c).over(across),
    }
    over = (slices.withColumns({"_nth": F.row_number().over(across),
                                **{f"_c_{n}": combine[c.kind](f"_t_{n}") for n, c in carries.items()}})
            .filter("_nth > 1")
            .select(*[F.col(b).alias(f"_k_{b}") for b in by], F.col("_slice").alias("_k_slice"),
                    *[f"_c_{n}" for n in carries]))
    on = F.col("_slice") == F.col("_k_slice")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    joined = local.join(F.broadcast(over), on, "left")
    merge = {
        "count": lambda n: F.col(n) + F.coalesce(f"_c_{n}", F.lit(0)),
        "sum": lambda n: F.col(n) + F.coalesce(f"_c_{n}", F.lit(0)),
        "max": lambda n: F.greatest(n, f"_c_{n}"),
        "last": lambda n: F.coalesce(n, f"_c_{n}"),
        "prev": lambda n: F.when(F.col("_rn") == 1, F.col(f"_c_{n}")).otherwise(F.col(n)),
    }
    done = joined.withColumns({n: merge[c.kind](n) for n, c in carries.items()})
    return done.drop("_rn", "_slice", "_k_slice", *[f"_k_{b}" for b in by], *ins, *[f"_c_{n}" for n in carries])


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank", start: int = 1) -> DataFrame:
    """Row number inside each group, distributed also inside one group."""
    out = prefix_scan(df, by, order, **{name: Carry("count")})
    return out.withColumn(name, (F.col(name) + F.lit(start)).cast("long"))


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` (a small constant) rows of each group.

    Spark limits the groups before the shuffle for this shape, so a hot group sends
    at most ``n`` rows per map task.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")


#: Bits that a round of ``exact_quantiles`` settles: a group's histogram has at most 2^16 cells per wanted rank.
DIGIT = 16


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per group: nothing is sorted in Spark, no large group is buffered.

    Small inputs take Spark's own exact percentile, whose buffers are then small. Else it is radix selection: the
    order-preserving bits of the values are counted 16 at a time; each wanted rank goes into the cell that holds
    it, and only rows of that cell are counted in the next of the four rounds. Keys and values are written once and
    read by each round. The two forms may differ in the last bit of an interpolated value. NULL values do not take part, nor do groups with a NULL key; NaN is larger than all numbers. Without
    ``by`` there is one row, of NULLs if there are no values.
    """
    keys = list(by) or ["_all"]
    source = df if by else df.withColumn("_all", F.lit(0))
    known = F.col(value).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    if is_small(df):
        number = F.col(value).cast("double")
        return (source.filter(known).groupBy(*by)
                .agg(*[F.percentile(number, F.lit(float(q))).alias(n) for n, q in quantiles.items()]))
    rows = materialize(source.filter(known).select(*keys, order_key(F.col(value).cast("double")).alias("_key")))
    state = None
    for shift in range(64 - DIGIT, -1, -DIGIT):
        cell = F.shiftright("_key", shift).alias("_cell")
        if state is None:
            counted = rows.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("_n"))
        else:
            wanted = state.select(*keys, F.array_distinct(F.transform("_ranks", lambda r: r["cell"])).alias("_cells"))
            inside = F.array_contains("_cells", F.shiftright("_key", shift + DIGIT))
            counted = keyed_join(rows, wanted, keys).filter(inside).groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("_n"))
        histogram = counted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_cell", "_n"))).alias("_histogram"),
                                               F.sum("_n").alias("_size"))
        if state is None:
            places = [at((F.col("_size") - 1) * F.lit(float(q))) for q in quantiles.values() for at in (F.floor, F.ceil)]
            start = F.array(*[F.struct(p.cast("long").alias("at"), F.lit(0).cast("long").alias("cell")) for p in places])
            state = histogram.withColumn("_ranks", start)
        else:
            state = histogram.drop("_size").join(state, keys)
        state = materialize(state.withColumn("_ranks", _descend(shift == 64 - DIGIT)).drop("_histogram"))
    cols = []
    for i, (name, q) in enumerate(quantiles.items()):
        low, high = (key_value(F.col("_ranks")[2 * i + j]["cell"]) for j in (0, 1))
        at = (F.col("_size") - 1) * F.lit(float(q))
        part = at - F.floor(at)
        cols.append(F.when(part == 0, low).otherwise(low + (high - low) * part).alias(name))
    out = state.select(*by, *cols)
    return out if by else out.agg(*[F.max(n).alias(n) for n in quantiles])


def _descend(first: bool) -> Column:
    """Each rank in ``_ranks`` moved into the cell of ``_histogram`` that holds it, and counted from that cell's start."""
    none = F.lit(None).cast("long")

    def step(acc: Column, cell: Column) -> Column:
        here = F.struct(acc["at"].alias("at"), cell["_cell"].alias("cell"))
        later = F.struct((acc["at"] - cell["_n"]).alias("at"), none.alias("cell"))
        return F.when(acc["cell"].isNotNull(), acc).when(acc["at"] < cell["_n"], here).otherwise(later)

    def move(rank: Column) -> Column:
        cells = F.col("_histogram")
        if not first:
            cells = F.filter(cells, lambda c: F.shiftright(c["_cell"], DIGIT) == rank["cell"])
        return F.aggregate(cells, F.struct(rank["at"].alias("at"), none.alias("cell")), step)

    return F.transform("_ranks", move)
