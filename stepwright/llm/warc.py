"""WARC archives as a PySpark Python data source.

Reading: files are listed once and planned into partitions by size; a large file that this source
wrote is split into ranges, whose tasks find the first member that starts there. Only the start of
a gzip member is inflated to parse a record's header, filters on record_type and the other header
columns are tried on it, and a record that fails them, or whose payload is not asked for by the
schema, is skipped without inflating its block where it is alone in its member: the member's extra
field 'sl' says where the next one starts. Members without that field are inflated and dropped as
they are read; a member may hold any number of records. Archives that are not compressed are read
too; there Content-Length says where the next record is.

Writing: each task writes files of bounded size under names of its own; when a job commits, the
files of tasks that succeeded are named in a manifest of that job, and readers go by all manifests,
so appends add up and what a lost executor or a repeated task leaves behind is never read.

Defined cases: an archive without records, or a folder without archives, has no rows; a header
field that a record lacks is null; a record that ends early is an error that names its place; a
null html is an empty payload; pages of any length are one record; pages with a null page_id keep
null; columns of pages beside page_id, url and html are not read.

Options: path; max_file_bytes and level (writing); partition_bytes (reading).
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
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
    Filter,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from stepwright.llm.common import materialise, scratch_path, text_or_empty

#: Columns of records, and the header field that each comes from.
HEADER_FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "date": "WARC-Date",
}
SCHEMA = ", ".join([*(f"{name} string" for name in HEADER_FIELDS), "content_length long", "payload binary"])
MANIFEST = "_manifest-"
#: The start of a member that gzip_member wrote: magic, flags, time and so on, length and name of the extra field.
MEMBER_START = re.compile(rb"\x1f\x8b\x08\x04.{6}\x0c\x00sl\x08\x00", re.DOTALL)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"


def gzip_member(data: bytes, level: int) -> bytes:
    """data as one gzip member whose extra field holds its packed and unpacked lengths."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 24 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record_bytes(row: dict) -> bytes:
    """A record: header fields that are not null, then the block (an HTTP response, or none)."""
    lines = ["WARC/1.1"] + [f"{field}: {clean(row[name])}" for name, field in HEADER_FIELDS.items() if row.get(name) is not None]
    block = b""
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    else:
        payload = row["payload"] or b""
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    lines += [f"Content-Type: {HTTP_TYPE}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(str(value).split("\r\n")).replace("\n", " ").replace("\r", " ")


def parse_header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


@dataclass
class FileRanges(InputPartition):
    """Files that one task reads: path, and where the members that it reads start."""

    ranges: list[tuple[str, int, int]]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class Member:
    """A gzip member that starts at byte `at`, inflated as far as it is asked for."""

    def __init__(self, source, start: bytes, at: int):
        self.source, self.data, self.at = source, start, at
        self.unpacker, self.out = zlib.decompressobj(31), bytearray()

    def fill(self, n: int) -> None:
        """Inflate until n bytes are there or the member ends."""
        while len(self.out) < n and not self.unpacker.eof:
            self.data = self.data or self.source.read(1 << 16)
            more = self.unpacker.decompress(self.data, max(4096, n - len(self.out)))
            if not more and not self.data and not self.unpacker.eof:
                raise ValueError(f"a truncated record at byte {self.at}")
            self.out += more
            self.data = self.unpacker.unconsumed_tail

    def head(self) -> bytes | None:
        """The next record's header; None at the member's end."""
        while True:
            while self.out.startswith(b"\r\n"):
                del self.out[:2]
            end = self.out.find(b"\r\n\r\n")
            if end >= 0:
                found = bytes(self.out[:end])
                del self.out[: end + 4]
                return found
            if self.unpacker.eof:
                if self.out.strip():
                    raise ValueError(f"a record without a header at byte {self.at}")
                return None
            self.fill(len(self.out) + 4096)

    def block(self, n: int, wanted: bool) -> bytes | None:
        """The next n bytes, or None where they are only passed over."""
        if wanted:
            self.fill(n)
            found = bytes(self.out[:n])
            del self.out[:n]
            if len(found) < n:
                raise ValueError(f"a truncated record at byte {self.at}")
            return found
        while n:
            self.fill(min(n, 1 << 20))
            if not self.out:
                raise ValueError(f"a truncated record at byte {self.at}")
            gone = min(n, len(self.out))
            del self.out[:gone]
            n -= gone
        return None

    def end(self) -> int:
        """Where the next member starts; the rest of this one is inflated and dropped."""
        while not self.unpacker.eof:
            self.out.clear()
            self.fill(1 << 16)
        return self.source.tell() - len(self.unpacker.unused_data)


def place_of(options) -> tuple[fs.FileSystem, str]:
    path = options["path"]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class WarcReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.options, self.names = dict(options), [f.name for f in schema.fields]
        self.types = {f.name: pa.int64() if f.name == "content_length" else pa.binary() if f.name == "payload" else pa.string() for f in schema.fields}
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership on header columns; the rest stays with Spark."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if isinstance(f, IsNotNull) and name in self.wanted:
                continue
            if isinstance(f, (EqualTo, In)) and name in HEADER_FIELDS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[FileRanges]:
        store, root = place_of(self.options)
        listed = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        manifests = [i.path for i in listed if i.base_name.startswith(MANIFEST)]
        most = int(self.options.get("partition_bytes", 32 << 20))
        found: list[tuple[str, int, int]] = []
        for path in manifests:
            with store.open_input_stream(path) as source:
                for name, size in json.load(source):
                    found += [(f"{root}/{name}", a, min(a + most, size)) for a in range(0, size, most)]
        if not manifests:  # of others' archives a member's length may not be known, so each is read from its start
            found = [(i.path, 0, i.size) for i in listed if i.path.endswith((".warc", ".warc.gz"))]
        groups, room = [], 0
        for path, a, b in sorted(found):
            if not groups or room < b - a:
                groups.append([])
                room = most
            groups[-1].append((path, a, b))
            room -= b - a
        return [FileRanges(g) for g in groups]

    def read(self, partition: FileRanges) -> Iterator[pa.RecordBatch]:
        store, _ = place_of(self.options)
        columns: dict[str, list] = {n: [] for n in self.names}
        held = 0
        for path, begin, until in partition.ranges if partition else []:
            with store.open_input_file(path) as source:
                for header, payload in self.records(source, self.first_member(source, begin), until):
                    for name in self.names:
                        if name == "payload":
                            columns[name].append(payload)
                        elif name == "content_length":
                            columns[name].append(int(header.get("content-length", 0)))
                        else:
                            columns[name].append(header.get(HEADER_FIELDS[name].lower()))
                    held += 500 + len(payload or b"")
                    if held > 4 << 20:
                        yield self.batch(columns)
                        columns, held = {n: [] for n in self.names}, 0
        yield self.batch(columns)

    def batch(self, columns: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, self.types[n]) for n, v in columns.items()], list(columns))

    @staticmethod
    def first_member(source, begin: int) -> int:
        """The first byte from begin on where a member starts: its length leads to another member or to the end."""
        if begin == 0:
            return 0
        size, at = source.size(), begin
        while at < size:
            source.seek(at)
            window = source.read((1 << 16) + 24)
            for found in MEMBER_START.finditer(window):
                length = window[found.start() + 16 : found.start() + 20]
                if len(length) == 4:
                    follows = at + found.start() + struct.unpack("<I", length)[0]
                    source.seek(min(follows, size))
                    if follows == size or MEMBER_START.match(source.read(24)):
                        return at + found.start()
            at += 1 << 16
        return size

    def records(self, source, at: int, until: int) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """Header and payload (None if not asked for) of the records that pass the filters, of members that start before until."""
        while at < until:
            source.seek(at)
            start = source.read(8192)
            if start.startswith(b"\x1f\x8b"):
                at = yield from self.member_records(Member(source, start, at), start)
                continue
            header, payload, at = self.plain_record(source, start, at)
            if header is not None:
                yield header, payload

    def member_records(self, member: Member, start: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """The records of a member; returns where the next one starts."""
        packed, unpacked = self.member_lengths(start)
        passed = 0
        while (head := member.head()) is not None:
            header = parse_header(head)
            passes, wants_block = self.wants(header)
            n = int(header.get("content-length", 0))
            passed += len(head) + 8 + n
            if packed and not wants_block and passed >= unpacked:  # the last record of its member
                if passes:
                    yield header, None
                return member.at + packed
            block = member.block(n, wants_block)
            if passes:
                yield header, self.payload(header, block) if wants_block else None
        return member.end()

    def wants(self, header: dict[str, str]) -> tuple[bool, bool]:
        """Does the record pass the filters, and is its block needed?"""
        passes = all(header.get(HEADER_FIELDS[n].lower()) in values for n, values in self.wanted.items())
        return passes, passes and "payload" in self.names and header.get("warc-type") != "revisit"

    def plain_record(self, source, start: bytes, at: int) -> tuple[dict[str, str] | None, bytes | None, int]:
        """Header (None if the record is filtered out), payload and end of an uncompressed record."""
        while b"\r\n\r\n" not in start:
            more = source.read(8192)
            if not more:
                raise ValueError(f"a record without a header at byte {at}")
            start += more
        head, _, _ = start.partition(b"\r\n\r\n")
        header, begin = parse_header(head.lstrip(b"\r\n")), at + len(head) + 4
        end = begin + int(header.get("content-length", 0))
        passes, wants_block = self.wants(header)
        payload = None
        if wants_block:
            source.seek(begin)
            block = source.read(end - begin)
            if len(block) < end - begin:
                raise ValueError(f"a truncated record at byte {at}")
            payload = self.payload(header, block)
        return header if passes else None, payload, end + 4

    @staticmethod
    def member_lengths(start: bytes) -> tuple[int, int]:
        """The packed and unpacked lengths in the member's extra field, or 0 and 0."""
        if start[3] & 4 and start[12:14] == b"sl":
            return struct.unpack("<II", start[16:24])
        return 0, 0

    @staticmethod
    def payload(header: dict[str, str], block: bytes) -> bytes:
        block = block[: int(header.get("content-length", 0))]
        return block.partition(b"\r\n\r\n")[2] if header.get("content-type", "").startswith("application/http") else block


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool = False):
        self.options, self.overwrite = dict(options), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = place_of(self.options)
        most, level = int(self.options.get("max_file_bytes", 64 << 20)), int(self.options.get("level", 1))
        store.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        sink, size, name = None, 0, ""
        for batch in iterator:
            for row in batch.to_pylist():
                if sink is None:
                    name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    sink = store.open_output_stream(f"{root}/{name}", compression=None)
                size += sink.write(gzip_member(record_bytes(row), level))
                if size >= most:
                    sink.close()
                    files.append((name, size))
                    sink = None
        if sink is not None:
            sink.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = place_of(self.options)
        store.create_dir(root, recursive=True)
        before = [i.path for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.startswith(MANIFEST)] if self.overwrite else []
        with store.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as sink:
            sink.write(json.dumps([f for m in messages if m for f in m.files]).encode())
        for path in before:
            store.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = place_of(self.options)
        for message in messages:
            for name, _ in message.files if message else []:
                store.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make format("warc") known to the session, with filters pushed down."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records of the archives under path; columns names what is wanted (payload only if named)."""
    register(spark)
    kinds = dict(part.split(" ") for part in SCHEMA.split(", "))
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)
    return spark.read.format("warc").schema(schema).load(path)


def page_records(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Records for pages (page_id, url, html): the columns of SCHEMA but for content_length.

    Of equal payloads of at least least_bytes the smallest page_id (null last) is the response
    and the others are revisits of it; rows that share that page_id are all responses. A null
    html is an empty payload.
    """
    payload = F.encode(text_or_empty(F.col("html")), "UTF-8")
    rows = pages.select("page_id", "url", F.sha2(text_or_empty(F.col("html")), 256).alias("digest"), payload.alias("payload"))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id")
    firsts = (
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("digest", F.col("first.page_id").alias("first_id"), F.lit(True).alias("many"))
    )
    joined = rows.join(firsts, "digest", "left")
    revisit = F.col("many").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(revisit, urn(F.col("first_id"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"),
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str, **options) -> None:
    """Write a record per page to the archives under path."""
    register(pages.sparkSession)
    page_records(pages).write.format("warc").mode("append").options(**options).save(path)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to.

    Responses are read with their payloads, which are measured and hashed again; revisits are
    read by their headers alone and get their response's payload by its record id.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_pages(pages, path)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1)
    page_id = lambda c: F.when(number(c) != "", number(c).cast(pages.schema["page_id"].dataType))
    responses = (
        read_warc(spark, path, ["record_type", "record_id", "payload_digest", "payload"])
        .where("record_type = 'response'")
        .select(
            "record_type", "record_id",
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.sha2("payload", 256).alias("payload_digest"),
        )
    )
    responses = materialise(responses, "warc-responses")  # payloads are inflated and hashed once
    revisits = read_warc(spark, path, ["record_type", "record_id", "refers_to", "payload_digest"]).where("record_type = 'revisit'")
    firsts = (
        responses.where(F.col("payload_bytes") > 0)
        .select(F.col("record_id").alias("refers_to"), "payload_bytes", F.concat(F.lit("sha256:"), F.col("payload_digest")).alias("payload_digest"))
        .distinct()
    )
    resolved = revisits.join(firsts, ["refers_to", "payload_digest"])
    bare = F.substring_index("payload_digest", ":", -1).alias("payload_digest")
    rows = responses.select("*", F.lit(None).cast("string").alias("refers_to")).unionByName(
        resolved.select("record_type", "record_id", "payload_bytes", bare, "refers_to")
    )
    return rows.select(
        page_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_id(F.col("refers_to")).alias("refers_to"),
    )
