"""Files in, files out.  Schemas are always given, never inferred."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import schema as S
from ..operators.dedup import dataset_fingerprint

SAMPLE_SUFFIX = "_static.json"


#: A line of a record file: the record, or the line itself if it is none.
RECORD = S.GRAPH_RECORD + ", sha256 string, _bad string"


def read_graph_json(spark: SparkSession, path: str, glob: str = "*" + SAMPLE_SUFFIX) -> DataFrame:
    """Graph records, one JSON per line; other files are ignored and malformed records skipped.

    ``glob`` names plain files, and takes the same with ``.gz`` behind it.
    The id comes from the file name where a record carries none (``sha256`` in the record wins).
    """
    rows = (spark.read.schema(RECORD).option("pathGlobFilter", f"{{{glob},{glob}.gz}}").option("recursiveFileLookup", True)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path))
    return named_records(rows, F.col("_metadata.file_name"))


def named_records(rows: DataFrame, file: Column) -> DataFrame:
    """The records among parsed lines, with their ids."""
    named = F.coalesce("sample_id", "sha256", path_sample_id(file))
    return rows.filter(F.col("_bad").isNull()).withColumn("sample_id", named).drop("_bad", "sha256")


def write_graph_json(df: DataFrame, path: str) -> None:
    """Compact JSON lines, one record each, gzipped: a record spells out every field of every node, some thirty times its text.

    Such a file is read by one task, so ``df`` should come in as many parts as ``scale.spread`` gives.
    """
    df.write.option("ignoreNullFields", False).option("compression", "gzip").json(path)


def read_jsonl_manifest(spark: SparkSession, path: str, schema: str = S.MANIFEST) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_manifest_sorted(df: DataFrame, path: str, key: str) -> None:
    """JSON lines sorted by key over all files, columns in name order."""
    (df.select(*sorted(df.columns)).repartitionByRange(F.col(key)).sortWithinPartitions(key)
     .write.option("ignoreNullFields", False).json(path))


def _cells(df: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("--")) for c in df.columns]


def _latex(cell: Column) -> Column:
    return F.regexp_replace(cell, r"([%_&#$])", r"\\$1")


def _write_lines(spark: SparkSession, path: str, head: Sequence[str], rows: DataFrame, foot: Sequence[str]) -> None:
    """Text in order over its part files: ``head``, the rows (place, value) by place, ``foot``."""
    def fixed(section: int, lines: Sequence[str]) -> DataFrame:
        texts = F.array(*[F.lit(t) for t in lines]).cast("array<string>")
        return spark.range(1).select(F.lit(section).alias("section"), F.posexplode(texts).alias("line", "value"))
    both = fixed(0, head).unionByName(fixed(2, foot)).withColumn("place", F.lit(None).cast(rows.schema["place"].dataType))
    body = rows.select(F.lit(1).alias("section"), F.lit(0).alias("line"), "value", "place")
    (both.unionByName(body).repartitionByRange("section", "line", "place").sortWithinPartitions("section", "line", "place")
     .select("value").write.text(path))


def write_result_table(df: DataFrame, path: str, source: str, note: str = "") -> None:
    """A result table below ``path``: ``csv``, ``latex`` and ``provenance``.

    Both texts open with where the numbers come from and, if there is one, a note. The CSV then has its header and rows, the
    LaTeX a ``tabular`` with rules, its first column to the left and the others to the right. Rows are in order of their
    columns. Null cells are ``--`` in LaTeX and empty in the CSV. The provenance record names the columns, and
    has the fingerprint and number of the rows, which ``write_table_manifest`` gathers.
    """
    spark = df.sparkSession
    notes = [f"source: {source}", *([f"note: {note}"] if note else [])]
    place = F.struct(*df.columns).alias("place")
    _write_lines(spark, f"{path}/csv", [f"# {n}" for n in notes] + [",".join(df.columns)], df.select(place, F.to_csv(F.struct(*df.columns)).alias("value")), [])
    row = F.concat(F.concat_ws(" & ", *[_latex(c) for c in _cells(df)]), F.lit(r" \\")).alias("value")
    head = " & ".join(re.sub(r"([%_&#$])", r"\\\1", c) for c in df.columns)
    top = [*[f"% {n}" for n in notes], r"\begin{tabular}{l" + "r" * (len(df.columns) - 1) + "}", r"\toprule", head + r" \\", r"\midrule"]
    _write_lines(spark, f"{path}/latex", top, df.select(place, row), [r"\bottomrule", r"\end{tabular}"])
    mark = dataset_fingerprint(df).select(F.struct("fingerprint", "n_rows")).scalar()
    first = spark.range(1).select(F.lit(source).alias("source"), F.lit(note).alias("note"), F.lit(",".join(df.columns)).alias("columns"), mark.alias("mark"))
    (first.select("source", "note", "columns", "mark.fingerprint", F.coalesce("mark.n_rows", F.lit(0)).alias("n_rows"))
     .write.option("ignoreNullFields", False).json(f"{path}/provenance"))


def read_result_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a written table, from its CSV."""
    columns = StructType.fromDDL(schema).fieldNames()
    lines = spark.read.text(f"{path}/csv").filter(~F.col("value").startswith("# ") & (F.col("value") != ",".join(columns)))
    return lines.select(F.from_csv("value", schema).alias("r")).select("r.*")


def write_table_manifest(spark: SparkSession, base: str, names: Sequence[str]) -> None:
    """``TABLES_MANIFEST`` below ``base``: a Markdown table of the named result tables, their sources and fingerprints."""
    rows = None
    for n in names:
        one = spark.read.schema("source string, note string, columns string, fingerprint string, n_rows long").json(f"{base}/{n}/provenance")
        one = one.withColumn("name", F.lit(n))
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise ValueError("a manifest names at least one table")
    files = F.concat("name", F.lit("/csv, "), "name", F.lit("/latex"))
    cell = F.concat(F.lit("| "), F.concat_ws(" | ", "name", files, "source", F.coalesce(F.substring("fingerprint", 1, 16), F.lit("empty")), "n_rows"), F.lit(" |"))
    full = rows.select(F.struct(F.lit(2), "name").alias("place"), F.concat(F.lit("- "), "name", F.lit(" = "), F.coalesce("fingerprint", F.lit("empty"))).alias("value"))
    gap = spark.range(1).select(F.struct(F.lit(1), F.lit("").alias("name")).alias("place"), F.lit("").alias("value"))
    table = rows.select(F.struct(F.lit(0), "name").alias("place"), cell.alias("value")).union(gap).union(full)
    _write_lines(spark, f"{base}/TABLES_MANIFEST", ["# Result tables", "", "| table | files | source | fingerprint | rows |", "|---|---|---|---|---|"], table, [])


def read_event_log(spark: SparkSession, path: str, streaming: bool = False, schema: str = S.EVENT_LOG) -> DataFrame:
    """Append-only JSON lines, as a batch or as a stream; unparseable lines are skipped."""
    reader = (spark.readStream if streaming else spark.read).schema(schema + ", _bad string")
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter(F.col("_bad").isNull()).drop("_bad")


def path_sample_id(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(_static)?\.json(\.gz)?$", "")


def sample_id_from_path(df: DataFrame, col: str, out: str = "sample") -> DataFrame:
    """File name without its folder and suffix."""
    return df.withColumn(out, path_sample_id(F.col(col)))


def scan_label_fast(df: DataFrame, text_col: str, key: str = "label", out: str = "label") -> DataFrame:
    """An integer field of a JSON text by pattern, without parsing the document."""
    hit = F.regexp_extract(text_col, rf'"{key}"\s*:\s*(\d+)', 1)
    return df.withColumn(out, F.when(hit != "", hit).try_cast("long"))


def read_binary_dir(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select("path", "length", "content"))


def ingest_binary_dir(source: SparkSession | DataFrame, magic: str, known: DataFrame, path: str | None = None) -> DataFrame:
    """(path, length, sha256, magic_ok, reason) of every file.

    ``source`` is a session with a path, or rows ``(path, length, content)``.  ``known`` has the
    hashes already present; the first path of a hash seen twice is the one to import.
    """
    files = read_binary_dir(source, path) if isinstance(source, SparkSession) else source
    lead = F.substring("content", 1, len(magic)).cast("string")
    rows = files.select("path", "length", F.sha2("content", 256).alias("sha256"), (lead == magic).alias("magic_ok"))
    firsts = rows.filter("magic_ok").groupBy("sha256").agg(F.min("path").alias("path"))
    fresh = firsts.join(known.select("sha256").distinct(), "sha256", "left_anti").withColumn("fresh", F.lit(True))
    seen = (rows.join(fresh, ["sha256", "path"], "left"))
    reason = F.when(~F.col("magic_ok"), "bad_magic").when(F.col("fresh").isNull(), "already_present").otherwise("import")
    return seen.withColumn("reason", reason).select("path", "length", "sha256", "magic_ok", "reason")


def metadata_prefilter(df: DataFrame, types: Sequence[str], max_size: int, type_col: str = "file_type",
                       size_col: str = "file_size") -> DataFrame:
    """Rows of an allowed type and known size up to the cap; a plain filter that reaches the scan."""
    return df.filter(F.col(type_col).isin(list(types)) & (F.col(size_col) <= max_size))


# File names of forwarders and installers.
FORWARDERS, INSTALLERS = r"(?i)^(api-ms-win-|ext-ms-)", r"(?i)(setup|install|uninst)"


def filename_exclusion(df: DataFrame, col: str, patterns: Sequence[str] = (FORWARDERS, INSTALLERS)) -> DataFrame:
    """Drop rows whose name matches any pattern; rows without a name stay."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col(col).rlike(p)
    return df.filter(~F.coalesce(hit, F.lit(False)))


def group_membership_join(members: DataFrame, groups: DataFrame, targets: Sequence[str] | None = None) -> DataFrame:
    """One row per (sample, group) of samples without an error, restricted to the target groups."""
    wanted = F.col("groups") if targets is None else F.array_intersect("groups", F.array(*[F.lit(t) for t in targets]))
    rows = (groups.filter(~F.coalesce("error", F.lit(False)))
            .select(F.col("sample_id").alias("sample"), F.explode(F.array_distinct(wanted)).alias("group")))
    return members.join(rows, "sample")
