"""WARC archives as a Spark data source, with revisit records for repeated payloads.

Writing: one gzip member for each record, so that any record can be read alone; the member's
header carries its length in the ``sl`` extra field, so that a reader can pass over it. A task
writes one file under a temporary name, which the commit of the job gives its final name; files
of lost or repeated tasks go.

Reading: archives are planned as ranges of about ``SPLIT_BYTES``; a range begins at the first
record at or after its start. Of every record only the header is inflated first. Predicates on
``record_type`` and other header columns (equality and lists) are pushed into the reader; a
record that fails them is passed over by its length, and its payload is never inflated. The
payload is decoded only if the schema asks for it or digests are to be verified.

Paths may be anything that ``pyarrow.fs`` opens (``file:``, ``s3:``, ``gs:``, ``hdfs:``).

Defined cases: a null page counts as an empty payload, a null URL leaves the target out, and
control characters and blanks of a URL are percent-encoded. Of equal payloads the record of the
largest id is the response (all rows that share it); a null id is the smallest.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from barloom.llm.common import own_exchange

LEVEL = 1  # of gzip
SPLIT_BYTES = 64 << 20
CHUNK = 1 << 20
ROWS = 2000
_MAGIC = b"\x1f\x8b\x08\x04"  # a member with an extra field
_PLAIN = b"\x1f\x8b\x08\x00"

SCHEMA = (
    "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, "
    "payload_bytes long, payload binary"
)
#: Columns that only need a record's header.
HEADER = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in url)


def record(page_id, url, payload: bytes, digest: str, refers_to, is_revisit: bool) -> bytes:
    """The bytes of a WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if is_revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = LEVEL) -> bytes:
    """A gzip member whose extra field ``sl`` holds its whole length and that of its contents."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = deflate.compress(raw) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = _MAGIC + struct.pack("<IBB", 0, 0, 255) + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    part: str | None
    final: str | None


class WarcWriter(DataSourceArrowWriter):
    """Rows ``(page_id, url, payload, payload_digest, refers_to, is_revisit)`` to archives."""

    def __init__(self, path: str, level: int):
        self.path, self.level = path.rstrip("/"), level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        part, final = f"{root}/_temporary-{name}", f"{root}/{name}"
        out, held = None, []
        for batch in iterator:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "payload_digest", "refers_to", "is_revisit")]
            for k in range(batch.num_rows):
                page_id, url, payload, digest, refers_to, revisit = (c[k].as_py() for c in cols)
                held.append(member(record(page_id, url, payload or b"", digest, refers_to, revisit), self.level))
                if len(held) >= 256:
                    out = out or self._open(fs, root, part)
                    out.write(b"".join(held))
                    held = []
        if held:
            out = out or self._open(fs, root, part)
            out.write(b"".join(held))
        if out is None:
            return Written(None, None)
        out.close()
        return Written(part, final)

    @staticmethod
    def _open(fs, root, part):
        fs.create_dir(root, recursive=True)
        return fs.open_output_stream(part, compression=None)  # records are members already

    def commit(self, messages):
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        for m in messages:
            if m and m.part:
                fs.move(m.part, m.final)
        for f in fs.get_file_info(pafs.FileSelector(root)):
            if "/_temporary-" in f.path:  # of tasks that ran twice
                fs.delete_file(f.path)

    def abort(self, messages):
        fs, root = filesystem(self.path)
        for m in messages:
            if m and m.part and fs.get_file_info(m.part).type != pafs.FileType.NotFound:
                fs.delete_file(m.part)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int


class _Window:
    """A file read forward in chunks, with skips."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.size = file, at, size
        self.data = b""

    def fill(self, n: int) -> bytes:
        """At least ``n`` bytes from here, or all that are left."""
        while len(self.data) < n and self.at + len(self.data) < self.size:
            self.file.seek(self.at + len(self.data))
            self.data += self.file.read(max(CHUNK, n - len(self.data)))
        return self.data

    def skip(self, n: int):
        self.data = self.data[n:] if n < len(self.data) else b""
        self.at += n


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split: int, verify: bool):
        self.path, self.columns, self.split, self.verify = path, [f.name for f in schema.fields], split, verify
        unknown = set(self.columns) - {*HEADER, "payload_bytes", "payload"}
        if unknown:
            raise ValueError(f"unknown columns {sorted(unknown)}")
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADER and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted[column] & values if column in self.wanted else values
            elif column == "record_type" and isinstance(f, IsNotNull):
                continue  # every record has one
            else:
                yield f

    def partitions(self):
        fs, root = filesystem(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.type == pafs.FileType.File and f.path.endswith(".warc.gz") and "/_temporary-" not in f.path:
                n = max(1, round(f.size / self.split))
                cuts = [f.size * k // n for k in range(n + 1)]
                out += [Range(f.path, a, b, f.size) for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def read(self, partition: Range):
        if not isinstance(partition, Range):  # a folder without archives
            return
        fs, _ = filesystem(self.path)
        schema = pa.schema([(c, {"payload_bytes": pa.int64(), "payload": pa.binary()}.get(c, pa.string())) for c in self.columns])
        rows: dict[str, list] = {c: [] for c in self.columns}
        held = 0
        with fs.open_input_file(partition.path) as file:
            for values in self._records(file, partition):
                for c in self.columns:
                    rows[c].append(values.get(c))
                held += len(values.get("payload") or b"") + 200
                if held > 1 << 22 or len(rows[self.columns[0]]) >= ROWS:
                    yield pa.RecordBatch.from_pydict(rows, schema=schema)
                    rows, held = {c: [] for c in self.columns}, 0
        if self.columns and rows[self.columns[0]]:
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    def _records(self, file, p: Range):
        w = _Window(file, p.start, p.size)
        if p.start:
            self._align(w)
        while w.at < p.end and w.fill(18):
            length = self._length(w.data)
            inflate = zlib.decompressobj(zlib.MAX_WBITS | 16)
            data, used = b"", 0
            while b"\r\n\r\n" not in data and not inflate.eof:
                piece = w.fill(used + 4096)[used : used + 4096]
                if not piece:
                    raise ValueError(f"{p.path}: the record at {w.at} is cut off")
                data += inflate.decompress(piece)
                used += len(piece)
            head, _, block = data.partition(b"\r\n\r\n")
            fields = self._fields(head)
            good = all(self._value(fields, c) in v for c, v in self.wanted.items())
            need_block = good and ("payload" in self.columns or "payload_bytes" in self.columns or self.verify)
            if need_block and not ("payload" in self.columns or self.verify) and b"\r\n\r\n" in block:
                need_block = False  # the length is in the inner header
                rest = block
            elif need_block or length is None:
                parts = [block]
                while not inflate.eof:
                    piece = w.fill(used + CHUNK)[used : used + CHUNK]
                    if not piece:
                        raise ValueError(f"{p.path}: the record at {w.at} is cut off")
                    parts.append(inflate.decompress(piece))
                    used += len(piece)
                rest = b"".join(parts)
            else:
                rest = block
            w.skip(length if length is not None else used - len(inflate.unused_data))
            if good:
                yield self._row(fields, rest)

    @staticmethod
    def _length(data: bytes) -> int | None:
        if data[:4] == _MAGIC and data[12:14] == b"sl":
            return struct.unpack("<I", data[16:20])[0]
        return None

    def _align(self, w: _Window):
        """To the first record at or after here."""
        while True:
            data = w.fill(CHUNK)
            at = min((k for k in (data.find(_MAGIC), data.find(_PLAIN)) if k >= 0), default=-1)
            if at < 0:
                if w.at + len(data) >= w.size:
                    w.skip(len(data))
                    return
                w.skip(max(1, len(data) - 3))
                continue
            w.skip(at)
            try:
                if zlib.decompressobj(zlib.MAX_WBITS | 16).decompress(w.fill(4096)[:4096], 8).startswith(b"WARC/"):
                    return
            except zlib.error:
                pass
            w.skip(1)

    @staticmethod
    def _fields(head: bytes) -> dict[str, str]:
        out = {}
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            out[name.strip().lower()] = value.strip()
        return out

    @staticmethod
    def _value(fields: dict[str, str], column: str) -> str | None:
        value = fields.get(HEADER[column].lower())
        return value.removeprefix("sha1:") if value and column == "payload_digest" else value

    def _row(self, fields: dict[str, str], block: bytes) -> dict:
        out = {c: self._value(fields, c) for c in HEADER}
        inner, _, payload = block.partition(b"\r\n\r\n")
        if out["record_type"] == "response" and ("payload" in self.columns or self.verify):
            payload = payload[: -4] if payload.endswith(b"\r\n\r\n") else payload
            out["payload"], out["payload_bytes"] = payload, len(payload)
            if self.verify:
                digest = base32_sha1(payload)
                if digest != out["payload_digest"]:
                    raise ValueError(f"{out['record_id']}: the payload does not have its digest")
        else:  # the length of the payload that was met, also where it is not stored
            out["payload_bytes"] = int(self._fields(inner).get("content-length", 0))
        return out


class WarcDataSource(DataSource):
    """Format ``warc``. Options: ``split_bytes``, ``level``, ``verify`` (recompute payload digests)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], schema, int(self.options.get("split_bytes", SPLIT_BYTES)), self.options.get("verify", "false") == "true")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], int(self.options.get("level", LEVEL)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page_id, url, payload, payload_digest, refers_to, is_revisit)`` of ``(page_id, url, html)``.

    Records of equal payloads of at least ``min_bytes`` refer to that of the largest id. Only
    digests that occur twice are kept of the aggregation, and the join splits a hot digest.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    met = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    met = met.where("n > 1").select(own_exchange("sha").alias("k"), "last")
    joined = rows.join(met, own_exchange("sha") == F.col("k"), "left")
    revisit = F.col("k").isNotNull() & F.coalesce(F.col("page_id") < F.col("last"), F.col("page_id").isNull() & F.col("last").isNotNull())
    digest = _base32(F.col("sha"))
    return joined.select("page_id", "url", "payload", digest.alias("payload_digest"), F.when(revisit, F.col("last")).alias("refers_to"), revisit.alias("is_revisit"))


def _base32(sha_hex: F.Column) -> F.Column:
    """Base32 of 40 hexadecimal digits, eight groups of five digits to four letters."""
    bits = [F.lpad(F.conv(F.substring(sha_hex, 1 + 5 * k, 5), 16, 2), 20, "0") for k in range(8)]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    picks = [F.substring(F.lit(letters), F.conv(F.substring(b, 1 + 5 * j, 5), 2, 10).cast("int") + 1, F.lit(1)) for b in bits for j in range(4)]
    return F.concat(*picks)


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    register(pages.sparkSession)
    with_revisits(pages, min_bytes).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, columns: str = SCHEMA, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(columns).option("verify", str(verify).lower()).load(path)


def digest(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives at ``path`` and read every record back, digests verified."""
    write(pages, path, min_bytes)
    back = read(pages.sparkSession, path, "record_id string, record_type string, payload_digest string, refers_to string, payload_bytes long", verify=True)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1).try_cast("long")
    return back.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
