"""Nested graph records to flat tables, and the scalar rules that go with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import api_list, trailing_number
from ..scale import Carry, first_rows, keyed_join, prefix_scan, ranked

UNITS = "intra_procedural_graphs"


def _array(col: str, df: DataFrame) -> Column:
    return F.coalesce(F.col(col), F.array().cast(df.schema[col].dataType))


def explode_units(sample: DataFrame) -> DataFrame:
    """One row per unit of each record, numbered by numeric address.

    A record is one row, so its units are sorted inside the row without a shuffle.
    """
    entries = F.transform(F.map_entries(UNITS), lambda e: F.struct(
        e["value"]["addr"].alias("addr"), e["key"].alias("unit"), e["value"].alias("body")))
    return (sample.select("sample_id", F.posexplode(F.sort_array(entries)).alias("ord", "u"))
            .select(F.col("sample_id").alias("sample"), "u.unit", F.col("ord").cast("long").alias("ord"),
                    *[F.col(f"u.body.{f}").alias(f) for f in sample.schema[UNITS].dataType.valueType.names]))


def explode_nodes(units: DataFrame) -> DataFrame:
    """One row per node; the API is an array whether the record held one name, several or none."""
    rows = units.select("sample", "unit", F.inline(_array("nodes", units)))
    return rows.withColumn("api", api_list(F.col("api")))


def explode_blocks(units: DataFrame) -> DataFrame:
    """One row per block."""
    return units.select("sample", "unit", F.inline(_array("blocks", units)))


def explode_edges(units: DataFrame, kind: str = "edges_cfg") -> DataFrame:
    """One row per edge pair (src, dst) of the named edge list; a missing list has no edges."""
    return (units.select("sample", "unit", F.explode(_array(kind, units)).alias("e"))
            .select("sample", "unit", F.get("e", F.lit(0)).alias("src"), F.get("e", F.lit(1)).alias("dst")))


def explode_edge_lists(units: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The edges of several lists with the ``kind`` each is given, in one pass over the records; null lists have no edges."""
    def named(kind: str, col: str) -> Column:
        return F.transform(_array(col, units), lambda e: F.struct(
            F.get(e, F.lit(0)).alias("src"), F.get(e, F.lit(1)).alias("dst"), F.lit(kind).alias("kind")))
    return units.select("sample", "unit", F.inline(F.concat(*[named(k, c) for k, c in kinds.items()])))


def explode_evidence(units: DataFrame, kind: str = "seed_edges") -> DataFrame:
    """One row per seed edge or node indicator."""
    return units.select("sample", "unit", F.inline(_array(kind, units)))


def unit_position(df: DataFrame, key_col: str, out: str = "position") -> DataFrame:
    """Trailing number of a unit key: decimal, else hexadecimal, else 0."""
    return df.withColumn(out, trailing_number(F.col(key_col)))


def normalize_api_name(df: DataFrame, col: str, out: str = "api_name") -> DataFrame:
    """Text behind the last ``!``, trimmed."""
    return df.withColumn(out, F.trim(F.substring_index(F.col(col), "!", -1)))


def qualified_api_name(df: DataFrame, dll: str, name: str, out: str = "qualified") -> DataFrame:
    """``library!name`` with the library in lower case, ``?`` when it is unknown."""
    lib = F.lower(F.coalesce(F.nullif(F.col(dll), F.lit("")), F.lit("?")))
    return df.withColumn(out, F.concat(lib, F.lit("!"), F.col(name)))


# Operand type codes and their names.
OPERAND_TYPES = {1: "reg", 2: "imm", 3: "mem", 4: "fp"}
# Statement tags that carry no computation.
SKIPPED_TAGS = ("Ist_IMark", "Ist_NoOp", "Ist_AbiHint")


def instruction_token(df: DataFrame, mnemonic: str, op_types: str, out: str = "token") -> DataFrame:
    """``mnemonic_type_type`` from the mnemonic and an array of operand codes."""
    def name(code: Column) -> Column:
        known = F.lit(None).cast("string")
        for value, text in OPERAND_TYPES.items():
            known = F.when(code == value, text).otherwise(known)
        return F.coalesce(known, F.concat(F.lit("op"), code.cast("string")))
    head = F.replace(F.lower(F.trim(F.col(mnemonic))), F.lit(" "), F.lit("."))
    return df.withColumn(out, F.concat_ws("_", head, F.transform(op_types, name)))


def statement_token(df: DataFrame, tag: str, jumpkind: str, data_tag: str, op: str, out: str = "token") -> DataFrame:
    """``tag:jumpkind:data:op`` without prefixes; rows with a skipped tag are dropped.

    The jump kind counts for exits only, the operation only together with data.
    """
    jump = F.when(F.col(tag) == "Ist_Exit", F.col(jumpkind))
    operation = F.when(F.col(data_tag).isNotNull(), F.col(op))
    return (df.filter(~F.col(tag).isin(*SKIPPED_TAGS))
            .withColumn(out, F.concat_ws(":", F.regexp_replace(tag, "^Ist_", ""), jump,
                                         F.regexp_replace(data_tag, "^Iex_", ""), operation)))


def sequence_tokens(nodes: DataFrame, mode: str = "insn") -> DataFrame:
    """Token rows of a unit numbered in block and node order.

    ``insn`` takes each node's token, ``block`` the tokens array of each block.  The sequence
    stays as rows: a unit of any length is one group of an ordered scan, never one value.
    """
    if mode == "insn":
        rows = nodes.select("sample", "unit", "idx", F.lit(0).alias("sub"), "token")
    elif mode == "block":
        rows = nodes.select("sample", "unit", F.col("addr").alias("idx"), F.posexplode("tokens").alias("sub", "token"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return ranked(rows, ["sample", "unit"], [F.col("idx"), F.col("sub")], "ord", 0).select("sample", "unit", "ord", "token")


def assign_call_positions(call_sites: DataFrame) -> DataFrame:
    """Number the calls of a unit by site address; a site with several targets gives several calls."""
    rows = call_sites.select("sample", "unit", "node_id", "addr", F.posexplode("apis").alias("nth", "api"))
    return ranked(rows, ["sample", "unit"], [F.col("addr"), F.col("node_id"), F.col("nth")], "position", 0) \
        .select("sample", "unit", "node_id", "api", "position")


def seq_edges(nodes: DataFrame) -> DataFrame:
    """Edges between consecutive nodes of the same block."""
    scan = prefix_scan(nodes.select("sample", "unit", "block", "idx"), ["sample", "unit", "block"],
                       [F.col("idx").asc()], src=Carry("prev", F.col("idx")))
    return scan.filter(F.col("src").isNotNull()).select("sample", "unit", "src", F.col("idx").alias("dst"))


def block_to_node_edges(nodes: DataFrame, block_edges: DataFrame) -> DataFrame:
    """Block edges lifted to (last node of the source, first node of the target); empty blocks drop out."""
    key = ["sample", "unit", "block"]
    ends = nodes.groupBy(*key).agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    hops = keyed_join(block_edges.withColumnRenamed("src", "block"), ends.select(*key, F.col("last").alias("src")), key)
    hops = keyed_join(hops.drop("block").withColumnRenamed("dst", "block"), ends.select(*key, F.col("first").alias("dst")), key)
    return hops.select("sample", "unit", "src", "dst")


def epoch_year(df: DataFrame, col: str, out: str = "year") -> DataFrame:
    """UTC year of epoch seconds inside (0, 2^31), else 0."""
    ts = F.col(col)
    # civil year from days, so that the session time zone has no say
    year = F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts / 86400).cast("int")))
    return df.withColumn(out, F.when((ts > 0) & (ts < 2 ** 31), year).otherwise(0))


def confidence_tier(df: DataFrame, votes: str, high: int = 15, medium: int = 5, out: str = "tier") -> DataFrame:
    """unknown / high / medium / low by the number of votes."""
    v = F.col(votes)
    return df.withColumn(out, F.when(v.isNull(), "unknown").when(v >= high, "high")
                         .when(v >= medium, "medium").otherwise("low"))


def consensus_label(votes: DataFrame, pos_min: int = 5, neg_max: int = 0, excluded: Sequence[str] = ()) -> DataFrame:
    """Label 1 at ``pos_min`` votes or more, 0 at ``neg_max`` or fewer; items between are dropped.

    ``votes`` is ``(id, voter, vote)``; votes of excluded voters do not count.
    """
    count = F.count_if(F.col("vote") & ~F.col("voter").isin(list(excluded)))
    n = votes.groupBy("id").agg(count.alias("n_votes"))
    label = F.when(F.col("n_votes") >= pos_min, 1).when(F.col("n_votes") <= neg_max, 0)
    return n.withColumn("label", label).filter(F.col("label").isNotNull())


# File name parts that rank or rule out a release asset.
ARCHIVES, BETTER = r"\.(zip|7z)$", r"x64|win64|64bit|windows"
BARRED_ARCHIVE, BARRED_EXE = r"src|source|arm|linux|mac|debug|pdb|symbol", r"src|arm|linux|mac"


def asset_score(name: Column) -> Column:
    """0 or 1 for archives, 2 for executables used only as a fallback, NULL for the rest."""
    low = F.lower(name)
    return (F.when(low.rlike(ARCHIVES) & ~low.rlike(BARRED_ARCHIVE), F.when(low.rlike(BETTER), 0).otherwise(1))
            .when(low.rlike(r"\.exe$") & ~low.rlike(BARRED_EXE), 2))


def asset_pick(df: DataFrame, by: str, score: str, size: str, url: str) -> DataFrame:
    """The best asset of each group by score, size and address; unscored assets never win."""
    return first_rows(df.filter(F.col(score).isNotNull()), [by],
                      [F.col(score).asc(), F.col(size).asc(), F.col(url).asc()], 1)
