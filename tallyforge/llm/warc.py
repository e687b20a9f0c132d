"""WARC archives: records of pages, a normaliser for monolithic gzip files, and reads by a sidecar offset index.

An archive that is one gzip stream can only be read from its start. The normaliser inflates such a file once, as a
stream, writes every record again as a gzip member of its own, and writes the members' offsets beside it, so that
any record can be read alone. Files are written inside tasks through ``pyarrow.fs``, by the URI of the folder.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, text_batches

#: Fixed values of the format.
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Columns of the offset index.
INDEX = ("archive string, offset long, length long, record_id string, record_type string, page_id long, "
         "target_uri string, payload_digest string, payload_bytes long, refers_to long")
NAMES = [x.split()[0] for x in INDEX.split(", ")]
CHUNK = 1 << 20


# ------------------------------------------------------------------ records


def _clean(value: str) -> str:
    """A header value stays on its line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int,
                 refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit that names the page that has it."""
    revisit = refers_to is not None
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest)),
            ("WARC-Payload-Digest", f"sha1:{sha}"), ("X-Payload-Length", str(size))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    if revisit:
        head += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    body = b"" if revisit else payload
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return VERSION + b"\r\n" + lines + b"\r\n" + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class Inflater:
    """Bytes of a gzip file with one member or many, read as a stream."""

    def __init__(self, chunks: Iterable[bytes]) -> None:
        self._chunks, self._z, self._rest, self._inside = iter(chunks), zlib.decompressobj(31), b"", False
        self.buffer = bytearray()

    def fill(self, n: int) -> bool:
        """At least ``n`` bytes in the buffer, if the file has them."""
        while len(self.buffer) < n:
            data = self._rest or next(self._chunks, b"")
            before = len(self.buffer)
            self.buffer += self._z.decompress(data, CHUNK)
            if not data and len(self.buffer) == before and not self._z.eof:
                if self._inside:
                    raise EOFError("the gzip stream ends inside a member")
                return False
            self._inside = self._inside or bool(data)
            self._rest = self._z.unconsumed_tail
            if self._z.eof:
                self._rest, self._z, self._inside = self._z.unused_data, zlib.decompressobj(31), False
        return True


def records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of a gzip archive, holding one record at a time."""
    source = Inflater(chunks)
    while source.fill(1):
        while (end := source.buffer.find(b"\r\n\r\n")) < 0:
            if not source.fill(len(source.buffer) + CHUNK) and source.buffer.find(b"\r\n\r\n") < 0:
                raise ValueError("a record's header does not end")
        head = parse_head(bytes(source.buffer[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        if not source.fill(size) and len(source.buffer) < size:
            raise ValueError("a record's block is cut off")
        yield head, bytes(source.buffer[:size])
        del source.buffer[:size]


# ------------------------------------------------------------------ files


def _store(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write_file(folder: str, name: str, parts: Iterable[bytes]) -> None:
    """Write under a name of this attempt, then move: a second attempt replaces a whole file by its equal."""
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    draft = posixpath.join(base, f".{name}.{uuid.uuid4().hex}")
    with store.open_output_stream(draft, compression=None) as out:
        for part in parts:
            out.write(part)
    store.move(draft, posixpath.join(base, name))


def _chunks(uri: str) -> Iterator[bytes]:
    store, path = _store(uri)
    with store.open_input_stream(path, compression=None) as f:
        while data := f.read(CHUNK):
            yield bytes(data)


def _value(x):
    return None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else x


def write_monolithic(pages: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Write each partition of (page_id, url, payload, digest, size, refers_to) as one gzip stream.

    Gives (archive), one row per file; a partition without rows writes none.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        name = f"pages-{TaskContext.get().partitionId():06d}.warc.gz"
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return

        def parts() -> Iterator[bytes]:
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            for pdf in (x for s in ([first], batches) for x in s):
                for page_id, url, payload, digest, size, refers in zip(
                        pdf["page_id"], pdf["url"], pdf["payload"], pdf["digest"], pdf["size"], pdf["refers_to"]):
                    page_id, refers = _value(page_id), _value(refers)
                    yield z.compress(build_record(None if page_id is None else int(page_id), _value(url), bytes(payload),
                                                  digest, int(size), None if refers is None else int(refers)))
            yield z.flush()

        _write_file(folder, name, parts())
        yield pd.DataFrame({"archive": [posixpath.join(folder, name)]})

    return (pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", "size",
                         F.col("refers_to").cast("string").alias("refers_to"))
            .mapInPandas(write, "archive string"))


def normalise_archives(archives: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Rewrite each file of (archive) with one gzip member per record; gives the offset index, one row per record.

    A file is inflated once and as a stream; one record is held at a time. The index is written beside the archive
    as ``<name>.idx`` lines ``offset length record-id`` as well. Columns of the result: ``INDEX``.
    """
    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive in pdf["archive"]:
                name = posixpath.basename(archive)
                rows: list[tuple] = []

                def members(archive=archive, name=name, rows=rows) -> Iterator[bytes]:
                    at = 0
                    for head, record in records(_chunks(archive)):
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = z.compress(record) + z.flush()
                        page, refers = head.get("x-page-id"), head.get("x-refers-to-page")
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        rows.append((posixpath.join(folder, name), at, len(member), head["warc-record-id"], head["warc-type"],
                                     page and int(page), head.get("warc-target-uri"), digest, int(head["x-payload-length"]),
                                     refers and int(refers)))
                        at += len(member)
                        yield member

                _write_file(folder, name, members())
                _write_file(folder, f"{name}.idx", (f"{r[1]} {r[2]} {r[3]}\n".encode() for r in rows))
                for i in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[i:i + 10_000], columns=NAMES).astype(
                        {"page_id": "Int64", "refers_to": "Int64"})

    return archives.mapInPandas(rewrite, INDEX)


def read_records(index: DataFrame) -> DataFrame:
    """Read the records that ``index`` names, each by its own offset.

    (page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to): size and SHA-1 of a response are
    taken from the payload read, and an index or header that says otherwise raises; a revisit has no payload
    and tells those of the page it refers to.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, store_file = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.archive != opened:
                    if store_file is not None:
                        store_file.close()
                    store, path = _store(r.archive)
                    opened, store_file = r.archive, store.open_input_file(path)
                store_file.seek(int(r.offset))
                record = zlib.decompress(store_file.read(int(r.length)), 31)
                end = record.index(b"\r\n\r\n")
                head = parse_head(record[:end])
                payload = record[end + 4:end + 4 + int(head["content-length"])]
                digest, size = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex(), int(head["x-payload-length"])
                if head["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"{head['warc-record-id']}: the payload is not the one that was written")
                page, refers = head.get("x-page-id"), head.get("x-refers-to-page")
                out.append((page and int(page), head.get("warc-target-uri"), head["warc-type"],
                            payload if head["warc-type"] == "response" else None, size, digest, refers and int(refers)))
            yield pd.DataFrame(out, columns=["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest",
                                             "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return index.select("archive", "offset", "length").mapInPandas(
        read, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


# ------------------------------------------------------------------ pages


def archive_pages(pages: DataFrame, folder: str, least_bytes: int = 1000, id_col: str = "page_id",
                  url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row into monolithic archives under ``folder/raw``; gives (archive).

    Of records with equal payloads of at least ``least_bytes`` bytes, those with the largest id are responses and
    the others revisit them. Null payloads count as empty, a null id as smaller than any other, and repeated rows
    are written each; rows that share the largest id are all responses. Further columns are ignored.
    """
    text_batches(pages.sparkSession)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    keys = rows.filter(F.col("size") >= least_bytes).select("page_id", "digest")
    # digests that several pages have, and then the pages that are not the last of them: without the payloads
    last = (keys.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
            .filter("n > 1 AND last IS NOT NULL").select("digest", "last"))
    again = (keys.distinct().join(last, "digest").filter("page_id IS NULL OR page_id < last")
             .select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), F.col("last").alias("refers_to")))
    marked = rows.join(again, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")), "left")
    return write_monolithic(marked, f"{folder}/raw")


def archive_round_trip(pages: DataFrame, scratch: Scratch | None = None, **columns) -> DataFrame:
    """Archive pages, normalise the archives, and read every record back through the index.

    Each step ends in a table of file names or offsets in the shared folder before the next one starts, so a lost
    executor repeats its own files only. The monolithic files go once the normalised ones are complete.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    archives = scratch.write(archive_pages(pages, scratch.path("warc"), **columns), "archives")
    files = max(1, archives.count())
    index = scratch.write(normalise_archives(archives.repartition(files), scratch.path("warc/members")), "index")
    scratch.drop("warc/raw")
    return read_records(index.repartition(files, "archive"))


def index_table(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, offset, length, record_id) from the sidecar files of a folder."""
    lines = spark.read.text(f"{folder}/*.idx").withColumn("_file", F.input_file_name())
    part = F.split("value", " ")
    return lines.select(F.regexp_replace("_file", r"\.idx$", "").alias("archive"), part[0].cast("long").alias("offset"),
                        part[1].cast("long").alias("length"), part[2].alias("record_id"))
