"""WARC archives as a PySpark data source, with identical payloads stored once."""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from narrata.llm.common import shared_dir, staged

SCHEMA = "page_id long, url string, record_type string, refers_to long, declared_bytes long, declared_digest string, payload binary"
ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared_bytes", pa.int64()), ("declared_digest", pa.string()), ("payload", pa.binary())])
#: Where a column's value stands in a record's header.
HEADER = {"page_id": "x-page-id", "url": "warc-target-uri", "record_type": "warc-type", "refers_to": "x-refers-to-page", "declared_bytes": "x-payload-bytes", "declared_digest": "warc-payload-digest"}
NUMBERS = {"page_id", "refers_to", "declared_bytes"}
MANIFEST = "_committed"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES = 4_000_000


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, as executors and driver alike can open it."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:/", path) else (fs.LocalFileSystem(), path)


def _value(column: str, header: dict[str, str]) -> object:
    raw = header.get(HEADER[column])
    if raw is None:
        return None
    if column == "declared_digest":
        return raw.removeprefix("sha256:")
    return int(raw) if column in NUMBERS else raw


_COMPARED = {
    EqualTo: lambda v, x: v == x,
    In: lambda v, x: v in x,
    GreaterThan: lambda v, x: v > x,
    GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x,
    LessThanOrEqual: lambda v, x: v <= x,
    StringStartsWith: lambda v, x: v.startswith(x),
}


@dataclass
class WarcFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    """One partition a file. Record-type and header predicates are tested on a record's header, before its block is read."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in HEADER and type(f) in (*_COMPARED, IsNotNull, IsNull):
                self.tests.append((type(f), column, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, path = _open(self.path)
        found = system.get_file_info(path)
        if found.type == fs.FileType.File:
            return [WarcFile(self.path)]
        listed = sorted(x.base_name for x in system.get_file_info(fs.FileSelector(path)))
        manifests = [n for n in listed if n.startswith(MANIFEST)]
        names = [] if manifests else [n for n in listed if re.search(r"\.warc(\.gz)?$", n)]
        for manifest in manifests:
            with system.open_input_stream(f"{path}/{manifest}", compression=None) as f:
                names += f.read().decode().split()
        return [WarcFile(f"{self.path}/{n}") for n in names]

    def wanted(self, header: dict[str, str]) -> bool:
        for kind, column, x in self.tests:
            v = _value(column, header)
            if kind is IsNull:
                if v is not None:
                    return False
            elif v is None or kind is not IsNotNull and not _COMPARED[kind](v, x):
                return False
        return True

    def read(self, partition: WarcFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, path = _open(partition.path)
        with system.open_input_file(path) as raw:
            records = gzip_records if path.endswith(".gz") else plain_records
            rows: list[list] = []
            size = 0
            for header, block in records(Buffered(raw)):
                if not self.wanted(header):
                    continue
                body = None
                if self.payload and header.get("warc-type") in ("response", "resource"):
                    body = payload_of(header, block())
                    size += len(body)
                rows.append([_value(c, header) for c in HEADER] + [body])
                if size > BATCH_BYTES or len(rows) >= 10_000:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)


def batch_of(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class Buffered:
    """Lines, reads and forward seeks over a file, with one buffer; a seek beyond the buffer reads nothing."""

    def __init__(self, raw: pa.NativeFile, size: int = 1 << 20):
        self.raw, self.size, self.buffer, self.at = raw, size, b"", 0

    def _fill(self) -> bool:
        more = self.raw.read(self.size)
        self.buffer, self.at = self.buffer[self.at :] + more, 0
        return bool(more)

    def readline(self) -> bytes:
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if not self._fill():
                end = len(self.buffer) - 1
                break
        line, self.at = self.buffer[self.at : end + 1], end + 1
        return line

    def read(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n and self._fill():
            pass
        out = self.buffer[self.at : self.at + n]
        self.at += len(out)
        return out

    def peek(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n and self._fill():
            pass
        return self.buffer[self.at : self.at + n]

    def unread(self, data: bytes) -> None:
        self.buffer, self.at = data + self.buffer[self.at :], 0

    def seek(self, n: int) -> None:
        inside = min(n, len(self.buffer) - self.at)
        self.at += inside
        if n > inside:
            self.raw.seek(self.raw.tell() + n - inside)


def parse_header(lines: list[bytes]) -> dict[str, str]:
    """A record's header fields by lower-case name."""
    if not lines or not lines[0].startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {lines[:1]!r}")
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def plain_records(stream: Buffered) -> Iterator[tuple[dict[str, str], Callable[[], bytes]]]:
    """(header, function that reads the block) of each record; a block that isn't asked for is sought over."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        lines = []
        while line not in (b"\r\n", b"\n", b""):
            lines.append(line)
            line = stream.readline()
        header = parse_header(lines)
        left = [int(header.get("content-length", 0))]

        def block() -> bytes:
            data = stream.read(left[0])  # noqa: B023
            left[0] = 0  # noqa: B023
            return data

        yield header, block
        stream.seek(left[0])


#: A gzip header whose extra field "sl" holds the sizes of the member, compressed and not.
GZIP_HEAD = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"


def gzip_member(data: bytes, level: int) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = deflate.compress(data) + deflate.flush()
    extra = b"sl" + struct.pack("<HII", 8, 22 + 2 + len(body) + 8, len(data))
    return GZIP_HEAD + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def gzip_records(stream: Buffered) -> Iterator[tuple[dict[str, str], Callable[[], bytes]]]:
    """As plain_records for one gzip member a record.

    Of a member that tells its size only the beginning is inflated for the header; the rest is inflated when the block
    is asked for, and sought over otherwise. Members of other writers are inflated to find their end.
    """
    while head := stream.peek(24):
        size = 0
        if head[:3] == b"\x1f\x8b\x08" and head[3] == 4 and head[12:14] == b"sl":
            size = struct.unpack("<I", head[16:20])[0]
        inflate = zlib.decompressobj(31)
        data, read = b"", 0
        while b"\r\n\r\n" not in data and not inflate.eof:
            piece = inflate.unconsumed_tail or stream.read(min(2048, size - read) if size else 1 << 16)
            if not piece:
                raise ValueError("a gzip member does not end")
            read += 0 if inflate.unconsumed_tail else len(piece)
            data += inflate.decompress(piece, 4096)
        start, _, rest = data.partition(b"\r\n\r\n")
        header = parse_header(start.split(b"\r\n"))
        parts = [rest]

        def finish() -> None:
            nonlocal read
            while not inflate.eof:  # noqa: B023
                piece = inflate.unconsumed_tail or stream.read(size - read if size else 1 << 16)  # noqa: B023
                if not piece:
                    raise ValueError("a gzip member does not end")
                read += 0 if inflate.unconsumed_tail else len(piece)  # noqa: B023
                parts.append(inflate.decompress(piece, 1 << 24))  # noqa: B023

        def block() -> bytes:
            finish()  # noqa: B023
            return b"".join(parts)[: int(header.get("content-length", 0))]  # noqa: B023

        yield header, block
        if size:
            stream.seek(size - read)
        else:
            finish()
            stream.unread(inflate.unused_data)


def payload_of(header: dict[str, str], block: bytes) -> bytes:
    """An HTTP message's body, empty where the message ends before its blank line; other blocks whole."""
    if header.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{digest}')}>"


def record(row: dict) -> bytes:
    """The bytes of one record: a response with its payload, or a revisit that names the response of the same payload."""
    payload = row["payload"] or b""
    response = row["refers_to"] is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + payload if response else http
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"]) if row["url"] is not None else None
    fields = [
        ("WARC-Type", "response" if response else "revisit"),
        ("WARC-Record-ID", record_id(row["page_id"], row["payload_digest"])),
        ("WARC-Date", row["date"]),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
        ("WARC-Profile", None if response else SAME_PAYLOAD),
        ("WARC-Refers-To", None if response else record_id(row["refers_to"], row["payload_digest"])),
        ("X-Page-Id", row["page_id"]),
        ("X-Payload-Bytes", row["payload_bytes"]),
        ("X-Refers-To-Page", row["refers_to"]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own; only those of tasks that the job committed are named in the job's manifest.

    A job appends a manifest of its own and leaves those of others; with overwrite the files before it go after its commit.
    """

    def __init__(self, options: dict[str, str], overwrite: bool = False):
        self.path = options["path"].rstrip("/")
        self.overwrite = overwrite
        self.limit = int(options.get("maxfilebytes", 256_000_000))
        self.level = int(options.get("level", 3))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > self.limit:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * (self.level > 0))
                    out, size = system.open_output_stream(f"{path}/{names[-1]}", compression=None, buffer_size=1 << 20), 0
                data = record(row)
                if self.level:
                    data = gzip_member(data, self.level)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        before = [x.base_name for x in system.get_file_info(fs.FileSelector(path))] if self.overwrite else []
        own = {n for m in messages if m for n in m.names}
        with system.open_output_stream(f"{path}/{MANIFEST}-{uuid.uuid4().hex}", compression=None) as f:
            f.write("\n".join(sorted(own)).encode())
        old = [n for n in before if n not in own and (n.startswith(MANIFEST) or re.search(r"\.warc(\.gz)?$", n))]
        for n in sorted(old, key=lambda n: not n.startswith(MANIFEST)):  # manifests first, so that no reader misses a file
            system.delete_file(f"{path}/{n}")

    def abort(self, messages: list) -> None:
        system, path = _open(self.path)
        for n in (n for m in messages if m for n in m.names):
            system.delete_file(f"{path}/{n}")


class WarcSource(DataSource):
    """format("warc"): option payload=false leaves all blocks unread; maxFileBytes bounds a file that is written, and level
    is that of gzip, 0 for plain files."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_archive(pages: DataFrame, path: str, least: int = 100, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes one record per row of pages to WARC files under path.

    Of rows with equal payloads of at least `least` bytes the one with the smallest id is the response and others are
    revisits that refer to it. Payloads are compared by their SHA-256 and length; the groups are found from digests
    alone, minima are combined before the shuffle, and payloads move once, dealt by id, so a group of very many copies
    is spread out. Cases: a null html is an empty payload; a row without id is a response without that header; rows
    that repeat the smallest id of a group are all responses; control characters and blanks in a URL are written in
    percent form; an empty table gives an archive without records; other columns are ignored.
    """
    register(pages.sparkSession)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    light = staged(rows.select("page_id", "payload_bytes", "payload_digest"), "digests")
    groups = light.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    again = light.join(groups, ["payload_digest", "payload_bytes"]).where("page_id > refers_to").select("page_id", "payload_digest", "refers_to").distinct()
    full = rows.join(again, ["page_id", "payload_digest"], "left")
    shown = full.select("page_id", "url", "payload_bytes", "payload_digest", "refers_to", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), F.lit(date).alias("date"))
    shown.write.format("warc").option("path", path).mode("append").save()


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records under path; filters on header columns are pushed into the reader."""
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def archived(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of an archive's records.

    Responses are read with their payloads, whose size and digest are computed anew and must equal what the header
    declares; for revisits, whose payload another record holds, only headers are read.
    """
    full = read_archive(spark, path).where(F.col("record_type") == "response")
    digest = F.sha2("payload", 256)
    sound = F.when((digest == F.col("declared_digest")) & (F.octet_length("payload") == F.col("declared_bytes")), digest).otherwise(F.raise_error(F.concat(F.lit("damaged record of page "), F.col("page_id").cast("string"))))
    responses = full.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), sound.alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    light = read_archive(spark, path, payload=False).where(F.col("record_type") == "revisit")
    return responses.union(light.select("page_id", F.col("declared_bytes").alias("payload_bytes"), F.col("declared_digest").alias("payload_digest"), "record_type", "refers_to"))


def new_archive(spark: SparkSession) -> str:
    """A path for a new archive in the shared folder."""
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
