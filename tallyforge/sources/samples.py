"""One file per sample, written by tasks and moved into place at commit."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .files import RECORD, SAMPLE_SUFFIX, named_records

FORMAT = "sample_files"
#: Of gzip: pyarrow's own choice of 9 takes six times as long as 2 on such records, for files a fifth smaller.
LEVEL = 2


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


@dataclass
class _Staged(WriterCommitMessage):
    folder: str | None


class _SampleWriter(DataSourceWriter):
    """Every task attempt stages its files in a folder of its own.

    The folders of the attempts that Spark accepts are renamed into the target, one step each; whatever else was staged, by
    failed or repeated attempts, goes with the staging folder. A failed job leaves nothing behind.
    """

    def __init__(self, path: str, suffix: str) -> None:
        self.path, self.suffix, self.job = path.rstrip("/"), suffix, uuid.uuid4().hex

    def _staging(self, base: str) -> str:
        return f"{base}/_staging-{self.job}"

    def write(self, iterator: Iterator[Row]) -> _Staged:
        files, base = _filesystem(self.path)
        context, folder, gzip = TaskContext.get(), None, pa.Codec("gzip", compression_level=LEVEL)
        for name, text in iterator:
            if folder is None:
                folder = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
                files.create_dir(f"{self._staging(base)}/{folder}", recursive=True)
            body = text.encode()
            if self.suffix.endswith(".gz"):
                body = gzip.compress(body)
            with files.open_output_stream(f"{self._staging(base)}/{folder}/{quote(name, safe='')}{self.suffix}", compression=None) as out:
                out.write(body)
        return _Staged(folder)

    def commit(self, messages: list[_Staged | None]) -> None:
        files, base = _filesystem(self.path)
        files.create_dir(base, recursive=True)
        for m in messages:
            if m is not None and m.folder is not None:
                files.move(f"{self._staging(base)}/{m.folder}", f"{base}/{m.folder}-{self.job}")
        self._clear(files, base)

    def abort(self, messages: list[_Staged | None]) -> None:
        self._clear(*_filesystem(self.path))

    def _clear(self, files, base: str) -> None:
        from pyarrow import fs

        if files.get_file_info(self._staging(base)).type == fs.FileType.Directory:
            files.delete_dir(self._staging(base))


class SampleFiles(DataSource):
    """Sink of (name, text) rows: ``<name><suffix>`` with the text, names escaped as in URLs."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> _SampleWriter:
        return _SampleWriter(self.options["path"], self.options.get("suffix", SAMPLE_SUFFIX))


def write_sample_json(df: DataFrame, path: str, key: str = "sample_id", suffix: str = SAMPLE_SUFFIX) -> None:
    """``<sample>_static.json`` per record, compact JSON with nulls, in one folder per task below ``path``.

    A ``suffix`` that ends in ``.gz`` compresses the files, which ``read_graph_json`` takes as well.
    Samples have a name, and no two records have the same: else nothing is written and an error says so. An empty
    table makes an empty folder. Files are added to what lies there. The folder is one that every task can reach.
    """
    odd = df.select(F.col(key).cast("string").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR name IS NULL").limit(1).collect()
    if odd:
        raise ValueError(f"sample {odd[0]['name']!r} is on {odd[0]['n']} rows; each needs one name of its own")
    df.sparkSession.dataSource.register(SampleFiles)
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    df.select(F.col(key).cast("string").alias("name"), text.alias("text")).write.format(FORMAT).option("suffix", suffix).mode("append").save(path)


def _lines(path: str, suffix: str):
    """(folder) -> (file, value): the lines of all sample files in a folder below ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = _filesystem(path)
        for folder in (f for b in batches for f in b.column("folder").to_pylist()):
            names, lines, held = [], [], 0
            for info in files.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base)):
                if info.type != fs.FileType.File or info.base_name[0] in "._" or not info.base_name.removesuffix(".gz").endswith(suffix):
                    continue
                with files.open_input_file(info.path) as f:
                    body = f.read()
                if info.base_name.endswith(".gz"):
                    body = zlib.decompress(body, 31)
                found = [x for x in body.split(b"\n") if x.strip()]
                names += [info.base_name] * len(found)
                lines += found
                held += len(body)
                if held >= 8 << 20:
                    yield _named_lines(names, lines)
                    names, lines, held = [], [], 0
            if names:
                yield _named_lines(names, lines)
    return run


def _named_lines(names: list[str], lines: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())], names=["file", "value"])


def read_sample_json(spark: SparkSession, path: str, suffix: str = SAMPLE_SUFFIX) -> DataFrame:
    """What ``write_sample_json`` wrote below ``path``, as ``read_graph_json`` gives it, with the file's name as ``file``.

    A task lists and reads a folder. Spark's own reader lists all files in the driver and costs more per small file than its record.
    """
    from pyarrow import fs

    files, base = _filesystem(path)
    folders = [""] + [i.base_name for i in files.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory and i.base_name[0] not in "._"]
    named = spark.createDataFrame(spark.sparkContext.parallelize([(f,) for f in folders], len(folders)), "folder string")
    lines = named.mapInArrow(_lines(path, suffix), "file string, value string")
    record = F.from_json("value", RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.select("file", F.explode(F.array(record)).alias("r")).select("r.*", "file")  # exploded, as a filter below would parse again
    return named_records(rows, F.col("file"))
