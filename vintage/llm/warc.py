"""WARC archives as a Spark data source, with identical-payload revisits.

Reading plans one partition per file (or per group of small files). A record's
header is parsed first; record-type and header predicates are tested on it, and
unless the payload was asked for (it is in the schema) and the record passes,
the payload is skipped by seeking over it. In files compressed record by record
the bytes have to be inflated to find the next record, but are not kept.

Predicates: ``record_type``, ``target_uri``, ``payload_digest`` and
``record_id`` compared by =, IN or prefix are taken over when Spark offers them
(``spark.sql.python.filterPushdown.enabled``); others stay with Spark.

Writing: each task writes files of its own and rolls over at
``max_file_bytes``. Only files named by committed tasks are listed in the
manifest that the reader follows, so lost or repeated tasks leave nothing
behind that is read. The folder must be one that all machines share.

Options: ``compression`` (gzip, the default, or none), ``max_file_bytes``,
``group_bytes`` (files planned together), ``verify`` (recompute the digest of
response payloads that are read; a mismatch fails the read).
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In,
                                    InputPartition, StringStartsWith, WriterCommitMessage)
from pyspark.sql.types import (BinaryType, LongType, StringType, StructField, StructType)

from vintage.llm.common import ship_package, written
from vintage.session import checkpoint_dir

SCHEMA = StructType([
    StructField("record_id", StringType()), StructField("record_type", StringType()),
    StructField("target_uri", StringType()), StructField("payload_digest", StringType()),
    StructField("payload_bytes", LongType()), StructField("refers_to_id", StringType()),
    StructField("payload", BinaryType()),
])
_HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
              "payload_digest": "warc-payload-digest", "refers_to_id": "warc-refers-to"}
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "_manifest.json"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else re.sub(r"^(\w+):/*", r"\1:///", path))


def sha1_base32(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value without control characters."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def record(record_id: str, record_type: str, uri: str | None, payload: bytes, refers_to: str | None = None,
           date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record of an HTTP response; a revisit holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_clean(uri)}")
    lines.append(f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}")
    if record_type == "revisit":
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Inflated(io.RawIOBase):
    """The concatenated members of a gzip file, inflated as they are read."""

    def __init__(self, source):
        self.source, self.left, self.out = source, b"", b""
        self.z = zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, buf) -> int:
        while not self.out:
            if self.z.eof:
                self.left, self.z = self.z.unused_data or self.left, zlib.decompressobj(31)
            raw = self.left or self.source.read(1 << 16)
            self.left = b""
            if not raw:
                return 0
            self.out = self.z.decompress(raw)
        n = min(len(buf), len(self.out))
        buf[:n] = self.out[:n]
        self.out = self.out[n:]
        return n


def _headers(f) -> dict[str, str] | None:
    """Header fields up to the empty line (names in lower case), None at the end of the file."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    out = {"": line.decode("utf-8", "replace").strip()}
    last = ""
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:  # folded line
            out[last] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        last = name.strip().lower()
        out[last] = value.strip()
    return out


def _skip(f, n: int) -> None:
    if f.seekable():
        f.seek(n, io.SEEK_CUR)
        return
    while n > 0:
        got = len(f.read(min(n, 1 << 20)))
        if not got:
            return
        n -= got


def _field(head: dict[str, str], column: str) -> str | None:
    value = head.get(_HEADER_OF[column])
    if value is None:
        return None
    if column in ("record_id", "refers_to_id"):
        return value.strip("<>")
    return value.removeprefix("sha1:") if column == "payload_digest" else value


def read_records(f, wanted: set[str], tests: list, verify: bool = False) -> Iterator[dict]:
    """Records of one open file: header first, the payload only where it is wanted and the tests pass."""
    body = bool({"payload", "payload_bytes"} & wanted) or verify
    while (head := _headers(f)) is not None:
        if not head[""].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {head['']!r}")
        length = int(head.get("content-length", 0))
        if not all(_field(head, c) in values if kind == "in" else (_field(head, c) or "").startswith(values)
                   for c, kind, values in tests):
            _skip(f, length)
            continue
        row = {c: _field(head, c) for c in wanted if c in _HEADER_OF}
        if body and head.get("content-type", "").startswith("application/http"):
            before = length
            http, size = _http_header(f, length)
            length -= size
            said = http.get("content-length")
            row["payload_bytes"] = int(said) if said and said.isdigit() else length
            if (("payload" in wanted) or verify) and head.get("warc-type") == "response":
                payload = f.read(length)
                if len(payload) != length:
                    raise ValueError(f"truncated record of {before} bytes")
                length = 0
                row["payload"], row["payload_bytes"] = payload, len(payload)
                if verify and "warc-payload-digest" in head and _field(head, "payload_digest") != sha1_base32(payload):
                    raise ValueError(f"payload digest of {head.get('warc-record-id')} differs")
        elif body:
            row["payload_bytes"] = length
            if "payload" in wanted:
                row["payload"], length = f.read(length), 0
        _skip(f, length)
        yield row


def _http_header(f, most: int) -> tuple[dict[str, str], int]:
    """HTTP header fields of a block and the number of bytes they take."""
    out, size = {}, 0
    while size < most:
        line = f.readline(most - size)
        size += len(line)
        if line in (b"\r\n", b"\n", b""):
            break
        name, _, value = line.decode("latin-1").partition(":")
        out[name.strip().lower()] = value.strip()
    return out, size


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        if unknown := set(self.names) - set(SCHEMA.fieldNames()):
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        self.path = options["path"]
        self.group = int(options.get("group_bytes", 128 << 20))
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in _HEADER_OF and isinstance(f, EqualTo) and f.value is not None:
                self.tests.append((column, "in", (f.value,)))
            elif column in _HEADER_OF and isinstance(f, In):
                self.tests.append((column, "in", tuple(v for v in f.value if v is not None)))
            elif column in _HEADER_OF and isinstance(f, StringStartsWith):
                self.tests.append((column, "prefix", f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, root = _filesystem(self.path)
        found = {i.path: i.size for i in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=False))
                 if i.is_file and re.search(r"\.warc(\.gz)?$", i.path)} if fs.get_file_info(root).type == pafs.FileType.Directory else {root: 0}
        if fs.get_file_info(f"{root}/{_MANIFEST}").type == pafs.FileType.File:
            listed = json.loads(fs.open_input_stream(f"{root}/{_MANIFEST}").read())
            found = {f"{root}/{n}": found[f"{root}/{n}"] for n in listed}
        groups, size = [[]], 0
        for path, n in sorted(found.items()):
            if groups[-1] and size + n > self.group:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += n
        return [Files(tuple(g)) for g in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(self.path)
        types = {"payload": pa.binary(), "payload_bytes": pa.int64()}
        schema = pa.schema([(n, types.get(n, pa.string())) for n in self.names])
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], schema.field(n).type) for n in self.names],
                                              schema=schema)

        for path in partition.paths:
            if path.endswith(".gz"):
                f = io.BufferedReader(_Inflated(fs.open_input_stream(path, compression=None)), 1 << 16)
            else:
                f = io.BufferedReader(_Seekable(fs.open_input_file(path)), 1 << 16)
            for r in read_records(f, set(self.names), self.tests, self.verify):
                rows.append(r)
                size += len(r.get("payload") or b"") + 200
                if size > 16 << 20:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class _Seekable(io.RawIOBase):
    """A pyarrow file as a raw Python file."""

    def __init__(self, f):
        self.f = f

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        return self.f.seek(at, whence)

    def tell(self) -> int:
        return self.f.tell()

    def readinto(self, buf) -> int:
        return self.f.readinto(buf)


@dataclass
class Written(WriterCommitMessage):
    """Names of the files of one task."""

    names: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    """Rows (record_id, record_type, target_uri, refers_to_id, payload) as records."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.most = int(options.get("max_file_bytes", 64 << 20))
        self.overwrite = overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc{'.gz' if self.gzip else ''}")
                    out, size = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                raw = record(r["record_id"], r["record_type"], r["target_uri"], r["payload"] or b"", r["refers_to_id"])
                raw = gzip.compress(raw, 4, mtime=0) if self.gzip else raw
                out.write(raw)
                size += len(raw)
                if size >= self.most:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(tuple(names))

    def _manifest(self, names: list[str]) -> None:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        at = f"{root}/{_MANIFEST}"
        if not self.overwrite and fs.get_file_info(at).type == pafs.FileType.File:
            names = json.loads(fs.open_input_stream(at).read()) + names
        with fs.open_output_stream(at, compression=None) as f:
            f.write(json.dumps(names).encode())

    def commit(self, messages: list[Written | None]) -> None:
        self._manifest([n for m in messages if m is not None for n in m.names])

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _filesystem(self.path)
        for m in messages:
            for n in m.names if m is not None else ():
                fs.delete_file(f"{root}/{n}")


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")`` after registration."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let Spark offer it predicates."""
    ship_package(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """The WARC records of pages: record_id, record_type, target_uri, refers_to_id, payload.

    Of equal payloads of at least ``min_bytes`` bytes the one with the largest
    id is the response and the others revisit it; smaller ones are responses.
    Payloads are equal when their SHA-1 is. NULL html is an empty payload. Rows
    that repeat the largest id are all responses, as nothing tells them apart;
    a page without an id revisits the response of its payload, and is one
    itself where no page of that payload has an id. Record ids are made from
    the page id. An empty table gives no record; extra columns are ignored.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target_uri"),
                     payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    groups = (p.select("sha", "id", F.octet_length("payload").alias("bytes")).filter(F.col("bytes") >= min_bytes)
              .groupBy("sha").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    repeated = written(groups.select(F.col("sha").alias("gsha"), "keep"), "warc-repeated")
    j = p.join(repeated, F.col("sha") == F.col("gsha"), "left")
    revisit = F.col("keep").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep"))
    urn = F.coalesce(F.concat(F.lit("urn:page:"), F.col("id").cast("string")),
                     F.concat(F.lit("urn:page-of:"), F.col("sha"), F.lit(":"), F.sha1(F.coalesce("target_uri", F.lit("")))))
    return j.select(urn.alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                    "target_uri", F.when(revisit, F.concat(F.lit("urn:page:"), F.col("keep").cast("string"))).alias("refers_to_id"),
                    "payload")


def round_trip(pages: DataFrame, min_bytes: int = 0, **columns) -> DataFrame:
    """Writes the pages' records and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    register(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex[:12]}"
    page_records(pages, min_bytes, **columns).write.format("warc").mode("append").save(path)
    fields = ("record_id", "record_type", "payload_digest", "payload_bytes", "refers_to_id")
    back = (spark.read.format("warc").schema(StructType([SCHEMA[n] for n in fields]))
            .option("verify", "true").load(path))

    def number(c: str) -> Column:
        return F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")

    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       number("refers_to_id").alias("refers_to"))
