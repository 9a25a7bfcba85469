"""WARC archives as a PySpark data source, and the archiving of pages with revisit records.

`register_warc(spark)` makes `spark.read.format("warc")` and `df.write.format("warc")` known.

**Reading.** Files are planned into partitions of about `partition_bytes`: small files share one, and a large file is cut at the
record offsets that its writer left in the manifest (a file without manifest is one partition). Of a record, its header comes first;
filters on header columns that Spark pushes down are held against it, and what they reject is never inflated or decoded: an
uncompressed record is stepped over by its length, a compressed one by the lengths in the `sl` field of its gzip header (where a
foreign file has none, it is inflated to find its end, but not kept). HTTP headers are parsed only for the columns that need them, and
a payload is read only if the schema asks for it or `verify` is set. Columns are chosen by `.schema(...)`.

**Writing.** One gzip member a record. A task writes files of its own, new in each attempt, and the driver's commit lists those of the
attempts that counted in a manifest; reading a folder with manifests takes only the listed files, so leftovers of lost executors
are never read. The folder must be one that all executors reach, by a scheme that `pyarrow.fs` knows (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.llm.tables import columns_or_null
from varve.session import stage

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns from the record's own header, by header name.
HEADER_COLUMNS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "date": "warc-date", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest", "block_digest": "warc-block-digest", "content_type": "content-type", "content_length": "content-length",
}
SCHEMA = (
    "record_id string, record_type string, date string, target_uri string, refers_to string, payload_digest string, block_digest string, "
    "content_type string, content_length long, headers map<string,string>, http_status int, payload_bytes long, payload binary, file string"
)
_ARROW = {"content_length": pa.int64(), "payload_bytes": pa.int64(), "http_status": pa.int32(), "payload": pa.binary(), "headers": pa.map_(pa.string(), pa.string())}
CHUNK, FEED = 1 << 18, 1 << 14
MANIFEST = "_written-"


class BadRecord(ValueError):
    """A file that is no WARC file, or one cut short."""


# ---- bytes of one file


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if re.match(r"file:/(?!/)", path):
        path = path[5:]
    return fs.FileSystem.from_uri(path.rstrip("/"))


def skip_lengths(head: bytes) -> tuple[int, int] | None:
    """(compressed, inflated) size of a gzip member, if its header tells them."""
    if len(head) < 24 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:16] != b"sl\x08\x00":
        return None
    return struct.unpack("<II", head[16:24])


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """`data` as one gzip member whose header tells both lengths, if they fit."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = 24 + len(body) + len(tail)
    if max(size, len(data)) >= 1 << 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\0\xff" + body + tail
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x0c\0sl\x08\0" + struct.pack("<II", size, len(data)) + body + tail


class RecordStream:
    """The bytes of a WARC file from `start` on, inflated if they are packed; `inflated` counts what had to be."""

    def __init__(self, handle, start: int = 0):
        self.raw, self.inflated = handle, 0
        handle.seek(start)
        self.pending, self.at, self.place = handle.read(max(CHUNK, 2)), 0, start  # place: of pending[0] in the file
        self.packed = self.pending[:2] == b"\x1f\x8b"
        self.buffer, self.used = bytearray(), 0
        self.inflater, self.member, self.lengths = None, start, None

    def _more(self) -> bool:
        self.place += len(self.pending)
        self.pending, self.at = self.raw.read(CHUNK), 0
        return bool(self.pending)

    def _fill(self) -> bool:
        if self.used > CHUNK:
            del self.buffer[: self.used]
            self.used = 0
        while True:
            if self.at >= len(self.pending) and not self._more():
                if self.inflater is not None:
                    raise BadRecord("the file ends within a gzip member")
                return False
            if not self.packed:
                self.buffer += memoryview(self.pending)[self.at :]
                self.at = len(self.pending)
                return True
            if self.inflater is None:
                if len(self.pending) - self.at < 24:
                    self.place += self.at
                    self.pending, self.at = self.pending[self.at :] + self.raw.read(CHUNK), 0
                self.member, self.lengths = self.place + self.at, skip_lengths(self.pending[self.at : self.at + 24])
                self.inflater = zlib.decompressobj(31)
            fed = self.pending[self.at : self.at + FEED]
            try:
                out = self.inflater.decompress(fed)
            except zlib.error as bad:
                raise BadRecord(f"gzip member at {self.member}: {bad}") from bad
            self.at += len(fed) - len(self.inflater.unused_data)
            if self.inflater.eof:
                self.inflater = None
            if out:
                self.inflated += len(out)
                self.buffer += out
                return True

    def begin(self) -> int | None:
        """Where the next record begins in the file (for a packed one, its gzip member), or None at the end."""
        fresh = self.used == len(self.buffer)
        while self.used == len(self.buffer):
            if not self._fill():
                return None
        if not self.packed:
            return self.place + self.at - (len(self.buffer) - self.used)
        self.alone = fresh
        return self.member

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.used < n:
            if not self._fill():
                raise BadRecord("the file ends within a record")
        out = bytes(memoryview(self.buffer)[self.used : self.used + n])
        self.used += n
        return out

    def head(self, most: int | None = None) -> bytes:
        """Bytes up to and with the next empty line; within `most` bytes, all of them if there is none."""
        seen = self.used
        while (found := self.buffer.find(b"\r\n\r\n", seen)) < 0 and (most is None or len(self.buffer) - self.used < most):
            seen = max(self.used, len(self.buffer) - 3)
            before, kept = self.used, seen - self.used
            if not self._fill():
                raise BadRecord("the file ends within a header")
            seen = self.used + kept if self.used != before else seen
        if found < 0 or most is not None and found + 4 - self.used > most:
            return self.take(most)
        return self.take(found + 4 - self.used)

    def skip(self, n: int, total: int) -> None:
        """Past the next `n` bytes, which end a record of `total` bytes."""
        if self.packed and self.alone and self.lengths is not None and self.lengths[1] == total:
            self._seek(self.member + self.lengths[0])
            self.inflater, self.lengths = None, None
        elif not self.packed and n > len(self.buffer) - self.used:
            self._seek(self.place + self.at + n - (len(self.buffer) - self.used))
        else:
            while n > len(self.buffer) - self.used:
                n -= len(self.buffer) - self.used
                self.used = len(self.buffer)
                if not self._fill():
                    raise BadRecord("the file ends within a record")
            self.used += n

    def _seek(self, to: int) -> None:
        self.buffer, self.used = bytearray(), 0
        if to <= self.place + len(self.pending):
            self.at = to - self.place
        else:
            if to > self.raw.size():
                raise BadRecord("the file ends within a record")
            self.raw.seek(to)
            self.pending, self.at, self.place = b"", 0, to


def parse_fields(head: bytes) -> tuple[str, dict[str, str]]:
    """First line and named fields of a header; names in small letters, folded lines joined, of repeated names the first."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    name = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            key, value = line.split(":", 1)
            name = key.strip().lower()
            if name in fields:
                name = None
            else:
                fields[name] = value.strip()
    return lines[0], fields


# ---- filters


def _test(f: ds.Filter) -> tuple[str, Callable] | None:
    """(column, test of its value that gives True, False or None as in SQL), or None for a filter on something else."""
    if isinstance(f, ds.Not):
        inner = _test(f.child)
        return inner and (inner[0], lambda v, t=inner[1]: None if (x := t(v)) is None else not x)
    if len(f.attribute) != 1 or f.attribute[0] not in HEADER_COLUMNS:
        return None
    if isinstance(f, ds.IsNull):
        return f.attribute[0], lambda v: v is None
    if isinstance(f, ds.IsNotNull):
        return f.attribute[0], lambda v: v is not None
    w = f.value
    tests = {
        ds.EqualTo: lambda v: v == w, ds.GreaterThan: lambda v: v > w, ds.GreaterThanOrEqual: lambda v: v >= w, ds.LessThan: lambda v: v < w,
        ds.LessThanOrEqual: lambda v: v <= w, ds.StringStartsWith: lambda v: v.startswith(w), ds.StringEndsWith: lambda v: v.endswith(w),
        ds.StringContains: lambda v: w in v,
    }
    if isinstance(f, ds.EqualNullSafe):
        return f.attribute[0], lambda v: v == w
    if isinstance(f, ds.In):
        return f.attribute[0], lambda v: None if v is None else True if v in w else None if None in w else False
    if type(f) not in tests or w is None:
        return None
    return f.attribute[0], lambda v, t=tests[type(f)]: None if v is None else t(v)


def header_value(fields: dict[str, str], column: str):
    value = fields.get(HEADER_COLUMNS[column])
    return int(value) if column == "content_length" and value is not None else value


# ---- reading


@dataclass
class Span(ds.InputPartition):
    """Byte ranges (file, start, end) that begin and end where records do; end None: to the end of the file."""

    ranges: list[tuple[str, int, int | None]]

    def __init__(self, ranges):
        self.ranges = ranges


def _listed(system: fs.FileSystem, root: str) -> list[dict]:
    """Files under `root`: those the manifests name, with their marks, or all `.warc` and `.warc.gz` files if there is no manifest."""
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [{"name": root, "bytes": info.size, "marks": [0]}]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    found = [i for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File]
    manifests = sorted(i.path for i in found if i.base_name.startswith(MANIFEST))
    if not manifests:
        return [{"name": i.path, "bytes": i.size, "marks": [0]} for i in sorted(found, key=lambda i: i.path) if re.search(r"\.warc(\.gz)?$", i.path)]
    out = []
    for path in manifests:
        with system.open_input_stream(path) as handle:
            out += [{**x, "name": f"{path.rpartition('/')[0]}/{x['name']}"} for x in json.loads(handle.read())]
    return out


def plan(files: list[dict], partition_bytes: int) -> list[Span]:
    """Ranges of about `partition_bytes`, cut at marks; ranges of small files together."""
    ranges = []
    for f in files:
        start = 0
        for mark, after in zip(f["marks"], [*f["marks"][1:], f["bytes"]]):
            if after - start >= partition_bytes or after == f["bytes"]:
                ranges.append((f["name"], start, None if after == f["bytes"] else after, after - start))
                start = after
    spans, size = [], partition_bytes
    for name, start, end, length in ranges:
        if size + length > partition_bytes:
            spans.append(Span([]))
            size = 0
        spans[-1].ranges.append((name, start, end))
        size += length
    return spans


class WarcReader(ds.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.columns, self.path = schema.names, options["path"]
        self.partition_bytes = int(options.get("partition_bytes", 128 << 20))
        self.verify = options.get("verify", "false").lower() == "true"
        known = dict(c.split(" ") for c in SCHEMA.split(", "))
        for f in schema.fields:
            if known.get(f.name) != f.dataType.simpleString().replace("bigint", "long"):
                raise ValueError(f"column {f.name} {f.dataType.simpleString()} is none of: {SCHEMA}")
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[Span]:
        system, root = open_folder(self.path)
        return plan(_listed(system, root), self.partition_bytes) or [Span([])]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(self.path)
        tests = [_test(f) for f in self.filters]
        rows, held = [], 0
        for name, start, end in partition.ranges:
            with system.open_input_file(name) as handle:
                try:
                    for row in self.records(RecordStream(handle, start), end, tests, name):
                        rows.append(row)
                        held += len(row.get("payload") or b"") + 500
                        if held > 8 << 20:
                            yield self.batch(rows)
                            rows, held = [], 0
                except BadRecord as bad:
                    raise BadRecord(f"{name}: {bad}") from bad
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _ARROW.get(c, pa.string())) for c in self.columns], names=self.columns)

    def records(self, stream: RecordStream, end: int | None, tests: list, name: str) -> Iterator[dict]:
        payload_wanted = "payload" in self.columns or self.verify
        http_wanted = payload_wanted or "payload_bytes" in self.columns or "http_status" in self.columns
        while (at := stream.begin()) is not None and (end is None or at < end):
            head = stream.head()
            version, fields = parse_fields(head)
            if not version.startswith("WARC/") or not fields.get("content-length", "").isdigit():
                raise BadRecord(f"no WARC record at {at}")
            size = int(fields["content-length"])
            total, left = len(head) + size + 4, size
            if not all(test(header_value(fields, column)) for column, test in tests):
                stream.skip(left + 4, total)
                continue
            row = {c: header_value(fields, c) for c in self.columns if c in HEADER_COLUMNS} | {"headers": list(fields.items()), "file": name, "http_status": None, "payload_bytes": size, "payload": None}
            if http_wanted:
                is_http = fields.get("content-type", "").replace(" ", "").startswith("application/http")
                if is_http and size:
                    http_head = stream.head(size)
                    left -= len(http_head)
                    status, http = parse_fields(http_head)
                    code = re.match(r"HTTP/\S+ (\d{3})\b", status)
                    row["http_status"], row["payload_bytes"] = code and int(code[1]), left
                    if fields.get("warc-type") == "revisit":
                        length = http.get("content-length", "")
                        row["payload_bytes"] = int(length) if length.isdigit() else None
                if payload_wanted and fields.get("warc-type") != "revisit":
                    payload = stream.take(left)
                    left = 0
                    told = fields.get("warc-payload-digest", "")
                    if self.verify and told.startswith("sha1:") and told[5:] != base32_sha1(payload):
                        raise BadRecord(f"record at {at}: the payload is not the one of its digest")
                    if "payload" in self.columns:
                        row["payload"] = payload
            stream.skip(left + 4, total)
            yield row


# ---- writing


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def as_uri(text: str) -> str:
    """White space and control characters percent-encoded, so that a header line holds it."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def format_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def page_record(row: dict, date: str) -> bytes:
    """A response record, or a revisit record with the headers of the response it stands for."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else row["payload"] or b""
    digest = "sha1:" + base64.b32encode(bytes.fromhex(row["payload_sha1"])).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode() + payload
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", date), ("WARC-Target-URI", row["target_uri"] and as_uri(row["target_uri"])),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None), ("WARC-Refers-To", row["refers_to"]), ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", "sha1:" + base32_sha1(block)), ("Content-Type", "application/http; msgtype=response"),
    ]
    return format_record(fields, block)


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


class WarcWriter(ds.DataSourceArrowWriter):
    """Rows (record_id, record_type, target_uri, refers_to, payload_sha1 in hex, payload_bytes, payload) as records."""

    NEEDS = "record_id string, record_type string, target_uri string, refers_to string, payload_sha1 string, payload_bytes long, payload binary"

    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        if overwrite:
            raise ValueError("archives are only added to: use mode('append')")
        if set(schema.names) != {c.split(" ")[0] for c in self.NEEDS.split(", ")}:
            raise ValueError(f"columns must be: {self.NEEDS}")
        self.path, self.level = options["path"], int(options.get("level", 6))
        self.file_bytes, self.mark_bytes = int(options.get("file_bytes", 1 << 30)), int(options.get("mark_bytes", 64 << 20))
        self.date = options.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = open_folder(self.path)
        system.create_dir(root, recursive=True)
        files, out = [], None
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    if out is None:
                        files.append({"name": f"part-{uuid.uuid4().hex}.warc.gz", "bytes": 0, "records": 0, "marks": [0]})
                        out = system.open_output_stream(f"{root}/{files[-1]['name']}", compression=None)
                        self._add(out, files[-1], self._info(files[-1]["name"]))
                    record = page_record({c: batch.column(c)[i].as_py() for c in batch.schema.names}, self.date)
                    self._add(out, files[-1], record)
                    if files[-1]["bytes"] >= self.file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def _info(self, name: str) -> bytes:
        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
        return format_record(fields, b"software: varve\r\nformat: WARC File Format 1.1\r\n")

    def _add(self, out, file: dict, record: bytes) -> None:
        member = gzip_member(record, self.level)
        if file["bytes"] - file["marks"][-1] >= self.mark_bytes:
            file["marks"].append(file["bytes"])
        out.write(member)
        file["bytes"] += len(member)
        file["records"] += 1

    def commit(self, messages: list[Written | None]) -> None:
        system, root = open_folder(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps([f for m in messages if m is not None for f in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files without manifest entry are never read; those of the tasks that ended go at once."""
        system, root = open_folder(self.path)
        for m in messages:
            for f in m.files if m is not None else ():
                system.delete_file(f"{root}/{f['name']}")


class WarcDataSource(ds.DataSource):
    """Options: `path`; reading: `partition_bytes`, `verify`; writing: `level`, `file_bytes`, `mark_bytes`, `date`."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(schema, dict(self.options), overwrite)


def register_warc(spark: SparkSession) -> None:
    """Make the format `warc` known to the session, and let Spark push filters down to Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA, **options) -> DataFrame:
    """The records under `path`; `columns` (a schema string) says which columns, and so what is decoded."""
    register_warc(spark)
    return spark.read.format("warc").schema(columns).options(**options).load(path)


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """What `write_warc` takes, for each row of `pages(page_id, url, html)`.

    The payload is the html in UTF-8, null as empty. Of rows with equal payloads of at least `min_bytes` bytes, that with the smallest
    page_id is the `response`, and the others are `revisit` records that refer to it; rows that repeat its page_id are responses too.
    A null page_id is never the smallest; where all are null, all are responses. Equal means equal SHA-256. A null url
    leaves the header out; an empty table gives no rows; other columns are not looked at. Payloads are not shuffled for
    the grouping, and not for the join either while the repeated digests are small enough for Spark to broadcast.
    """
    rows = columns_or_null(pages, page_id="long", url="string", html="string").withColumn("payload", F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "same": F.sha2("payload", 256)}).drop("html")
    groups = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("same").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    groups = stage(groups.where("n > 1 and first_id is not null").select("same", "first_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    marked = rows.join(groups, "same", "left").withColumn("again", F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")))
    return marked.select(
        urn("page_id").alias("record_id"), F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        F.when(F.col("again"), urn("first_id")).alias("refers_to"), F.sha1("payload").alias("payload_sha1"), "payload_bytes",
        F.when(~F.col("again"), F.col("payload")).alias("payload"),
    )


def write_warc(records: DataFrame, path: str, **options) -> None:
    """Add `records` (see `WarcWriter.NEEDS`) to the archives under `path`."""
    register_warc(records.sparkSession)
    records.write.format("warc").mode("append").options(**options).save(path)


def page_id_of(column: str) -> Column:
    """The page_id in a record id that `page_records` made; null if it was null."""
    return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
