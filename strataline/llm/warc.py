"""WARC files as a Spark data source (``warc``), for reading and writing.

Reading plans one partition for each file, and takes equality, IN and prefix filters on
record_type, record_id, target_uri, refers_to and payload_digest
(``spark.sql.python.filterPushdown.enabled`` has to be true before the read). A
record's headers are parsed first; a record that the filters reject, or any
record under the option ``payload=false``, has its payload passed over: plain
records by seeking, gzip members by the skip lengths of their extra field
(``sl``, WARC annex D), which the writer sets. Members without it are inflated.

Writing makes one gzip member per record. A file ends at ``file_bytes``; files are
written under ``_temporary`` and renamed when all tasks are done, so a failed or
repeated task leaves nothing behind. The path is a URI that pyarrow's file systems
open (file, hdfs, s3, gs) and all executors reach.

Defined results: a null payload is written as empty; a null URI is left out and
read back as null; line ends in a header value become blanks; an empty table writes no file and a folder
without files reads as no rows.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from .storage import beside, staged

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary"
FILE_BYTES = 64 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
_BATCH_BYTES = 8 << 20
_PEEK = 4096


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("file:", "/")) else posixpath.abspath(uri))


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field has the lengths of the member and of the record."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    return value.replace("\r", " ").replace("\n", " ")


def record(record_id: str, record_type: str, target_uri: str | None, date: str, refers_to: str | None, payload_digest: str, payload_bytes: int, payload: bytes) -> bytes:
    """A WARC/1.1 record of an HTTP response; a revisit has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + (payload if record_type == "response" else b"")
    lines = [("WARC-Type", record_type), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if target_uri is not None:
        lines.append(("WARC-Target-URI", target_uri))
    lines.append(("WARC-Payload-Digest", f"sha1:{payload_digest}"))
    if refers_to is not None:
        lines += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in lines) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Header names in lower case; values without the angle brackets of ids."""
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        value = value.strip()
        out[name.strip().lower()] = value[1:-1] if value[:1] == "<" and value[-1:] == ">" else value
    return out


@dataclass
class WarcFile(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


def _accepts(filters: list[tuple[str, str, tuple]], fields: dict[str, str | None]) -> bool:
    for column, kind, values in filters:
        got = fields.get(column)
        if got is None or not (got.startswith(values) if kind == "prefix" else got in values):
            return False
    return True


def _fields(head: dict[str, str]) -> dict[str, str | None]:
    out = {c: head.get(h) for c, h in _HEADERS.items()}
    digest = out["payload_digest"]
    out["payload_digest"] = digest.partition(":")[2] if digest and ":" in digest else digest
    return out


def records(source: pa.NativeFile, size: int, filters: list[tuple[str, str, tuple]], payloads: bool) -> Iterator[tuple[dict[str, str | None], int | None, bytes | None]]:
    """(header fields, payload bytes, payload) of the records that the filters accept."""
    at = 0
    while at < size:
        source.seek(at)
        peek = source.read(_PEEK)
        if peek[:2] == b"\x1f\x8b":
            inflate = zlib.decompressobj(31)
            skip = struct.unpack_from("<I", peek, 16)[0] if peek[3] & 4 and peek[12:16] == b"sl\x08\x00" else 0
            data = inflate.decompress(peek, _PEEK)

            def more(want: int) -> bool:
                """Inflate some more; whether there was more."""
                nonlocal data
                fed = inflate.unconsumed_tail or (b"" if inflate.eof else source.read(max(_PEEK, want)))
                if not fed:
                    return False
                data += inflate.decompress(fed, max(want, _PEEK))
                return True

            while b"\r\n\r\n" not in data and more(_PEEK):
                pass
            text, found, _ = data.partition(b"\r\n\r\n")
            if not found:
                raise ValueError(f"no WARC header at byte {at}")
            head = parse_head(text)
            block_at, length = len(text) + 4, int(head.get("content-length", 0))
            fields = _fields(head)
            wanted = _accepts(filters, fields)
            need = block_at + (length if wanted and payloads else min(length, 1024) if wanted else 0)
            while len(data) < need and more(need - len(data)):
                pass
            block = data[block_at : block_at + length]
            if skip:
                at += skip
            else:
                while not inflate.eof and more(1 << 16):
                    data = b""
                at = source.tell() - len(inflate.unused_data)
        else:
            data = peek
            while b"\r\n\r\n" not in data:
                part = source.read(_PEEK)
                if not part:
                    raise ValueError(f"no WARC header at byte {at}")
                data += part
            text, _, _ = data.partition(b"\r\n\r\n")
            head = parse_head(text)
            block_at, length = len(text) + 4, int(head.get("content-length", 0))
            fields = _fields(head)
            wanted = _accepts(filters, fields)
            need = block_at + (length if wanted and payloads else min(length, 1024) if wanted else 0)
            if len(data) < need:
                data += source.read(need - len(data))
            block = data[block_at : block_at + length]
            at += block_at + length + 4
        if wanted:
            is_http = "application/http" in head.get("content-type", "")
            http, _, body = block.partition(b"\r\n\r\n") if is_http else (b"", b"", block)
            n = parse_head(http).get("content-length") if is_http else str(length)
            yield fields, int(n) if n is not None else None, body if payloads and fields["record_type"] != "revisit" else None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payloads = options["path"], options.get("payload", "true").lower() != "false"
        self.filters: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in _HEADERS and column != "date" and isinstance(f, EqualTo) and isinstance(f.value, str):
                self.filters.append((column, "in", (f.value,)))
            elif column in _HEADERS and column != "date" and isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self.filters.append((column, "in", tuple(f.value)))
            elif column in _HEADERS and column != "date" and isinstance(f, StringStartsWith):
                self.filters.append((column, "prefix", (f.value,)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files, path = _file_system(self.path)
        found = files.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if files.get_file_info(path).type != fs.FileType.File else [files.get_file_info(path)]
        names = sorted((-f.size, f.path) for f in found if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz")) and "/_temporary/" not in f.path)
        return [WarcFile(p) for _, p in names]

    def read(self, partition: WarcFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files were found
            return
        files, _ = _file_system(self.path)
        columns: dict[str, list] = {c: [] for c in [*_HEADERS, "payload_bytes", "payload"]}
        types = {"payload_bytes": pa.int64(), "payload": pa.binary()}

        def batch() -> pa.RecordBatch:
            order = ("record_id", "record_type", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes", "payload")
            out = pa.RecordBatch.from_arrays([pa.array(columns[c], types.get(c, pa.string())) for c in order], list(order))
            for c in columns.values():
                c.clear()
            return out

        held = 0
        with files.open_input_file(partition.path) as source:
            for fields, n, payload in records(source, source.size(), self.filters, self.payloads):
                for c, v in fields.items():
                    columns[c].append(v)
                columns["payload_bytes"].append(n)
                columns["payload"].append(payload)
                held += len(payload or b"") + 500
                if held > _BATCH_BYTES:
                    yield batch()
                    held = 0
        if columns["payload"]:
            yield batch()


class WarcWriter(DataSourceArrowWriter):
    """Rows: record_id, record_type, target_uri, date, refers_to, payload_digest, payload_bytes, payload."""

    def __init__(self, options: dict[str, str]):
        self.path, self.limit = options["path"], int(options.get("file_bytes", FILE_BYTES))
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = _file_system(self.path)
        folder = f"{root}/_temporary/{self.run}"
        files.create_dir(folder, recursive=True)
        task, written = uuid.uuid4().hex, []
        sink, size = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if sink is None:
                        written.append(f"part-{task}-{len(written):05d}.warc.gz")
                        sink, size = files.open_output_stream(f"{folder}/{written[-1]}", compression=None), 0
                    data = member(record(**row | {"payload": row["payload"] or b""}))
                    sink.write(data)
                    size += len(data)
                    if size >= self.limit:
                        sink.close()
                        sink = None
        finally:
            if sink is not None:
                sink.close()
        return _Written(written)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _file_system(self.path)
        files.create_dir(root, recursive=True)
        for name in (f for m in messages if m is not None for f in m.files):
            files.move(f"{root}/_temporary/{self.run}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _file_system(self.path)
        if files.get_file_info(f"{root}/_temporary/{self.run}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/_temporary/{self.run}")
        if not files.get_file_info(fs.FileSelector(f"{root}/_temporary", allow_not_found=True)) and files.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/_temporary")


class WarcDataSource(DataSource):
    """Options: ``path``; reading: ``payload`` (default true); writing: ``file_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def page_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Rows for the writer. Of equal payloads of at least ``min_revisit_bytes`` bytes the
    page with the largest id is the response and the others revisit it. Equal payloads
    meet by digest without their bytes (maxima before the shuffle); pages then meet
    their target by page id, which is even however many copies a payload has."""
    raw = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("target_uri"), raw.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    large = rows.where(F.col("payload_bytes") >= min_revisit_bytes).select("page", "payload_digest")
    kept = large.groupBy("payload_digest").agg(F.max("page").alias("target"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = large.join(beside(staged(kept, "warc_targets")), "payload_digest").where("page != target").distinct()
    out = rows.join(revisits, ["page", "payload_digest"], "left")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    revisit = F.col("target").isNotNull()
    return out.select(
        urn("page").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(date).alias("date"),
        F.when(revisit, urn("target")).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the archives in ``path``. Responses are read with
    their payloads, whose bytes and digest are taken; revisits by their headers alone, as the filter on
    record_type goes to the reader and their blocks are passed over."""
    page = lambda c: F.expr(f"try_cast(substr({c}, 10) as bigint)").alias  # noqa: E731  after urn:page:
    source = spark.read.format("warc")
    whole = source.load(path).where("record_type = 'response'")
    heads = spark.read.format("warc").option("payload", "false").load(path).where("record_type = 'revisit'")
    whole = whole.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    return whole.drop("payload").unionByName(heads.drop("payload")).select(page("record_id")("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to")("refers_to"))
