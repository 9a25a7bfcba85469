"""WARC archives: round trips, foreign files, filters against plain filtering, and what is not inflated."""

import base64
import gzip
import hashlib
import io
import json
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.llm import warc
from varve.llm.warc import (
    SCHEMA, BadRecord, RecordStream, WarcReader, as_uri, format_record, gzip_member, page_id_of, page_records, parse_fields, plan, read_warc, skip_lengths, write_warc,
)

KIND = "page_id long, url string, html string, record_id string, payload string, same string, first_id string, again string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], KIND).repartition(3)


def handle_of(data):
    return pa.PythonFile(io.BytesIO(data), "r")


def made_records(seed=2, n=40):
    """(fields, block) of responses, resources, revisits and requests; blocks of all sizes, some that look like records."""
    rng, out = random.Random(seed), []
    for i in range(n):
        body = bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 3, 400, 5000])))
        if i % 7 == 0:
            body += b"\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n\x1f\x8b\x08\x04"
        kind = rng.choice(["response", "resource", "request", "revisit"])
        http = kind != "resource"
        block = (b"HTTP/1.1 %d OK\r\nX: y\r\nContent-Length: %d\r\n\r\n" % (200 + i % 3, len(body)) if http else b"") + (b"" if kind == "revisit" else body)
        fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:n:{i}>"), ("WARC-Target-URI", f"http://h{i % 3}.test/{i}" if i % 5 else None), ("Content-Type", "application/http; msgtype=response" if http else "text/plain")]
        out.append((fields, block, body if kind != "revisit" else None, len(body), 200 + i % 3 if http else None))
    return out


def packings(records):
    raw = [format_record(f, b) for f, b, *_ in records]
    return {
        "plain": b"".join(raw), "members": b"".join(gzip_member(r) for r in raw), "foreign members": b"".join(gzip.compress(r) for r in raw),
        "one member": gzip.compress(b"".join(raw)), "pairs": b"".join(gzip_member(raw[i] + raw[i + 1]) for i in range(0, len(raw), 2)),
    }


def rows_from(data, columns, filters=(), **options):
    known = dict(c.split(" ") for c in SCHEMA.split(", "))
    schema = T.StructType([T.StructField(c, {"long": T.LongType(), "int": T.IntegerType(), "binary": T.BinaryType()}.get(known[c], T.StringType())) for c in columns])
    reader = WarcReader(schema, {"path": "x", **options})
    stream = RecordStream(handle_of(data))
    return list(reader.records(stream, None, [warc._test(f) for f in filters], "x")), stream


@pytest.mark.parametrize("chunk,feed", [(1 << 18, 1 << 14), (64, 16), (7, 1), (1, 5)])
def test_every_packing_reads_alike(chunk, feed, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    monkeypatch.setattr(warc, "FEED", feed)
    records = made_records()
    for name, data in packings(records).items():
        got, _ = rows_from(data, ["record_id", "record_type", "target_uri", "payload", "payload_bytes", "http_status"])
        want = [(dict(f)["WARC-Record-ID"], dict(f)["WARC-Type"], dict(f)["WARC-Target-URI"], body, n, code) for f, _, body, n, code in records]
        assert [(r["record_id"], r["record_type"], r["target_uri"], r["payload"], r["payload_bytes"], r["http_status"]) for r in got] == want, name
        some, _ = rows_from(data, ["record_id", "payload"], [ds.EqualTo(("record_type",), "resource")])
        assert [(r["record_id"], r["payload"]) for r in some] == [(w[0], w[3]) for w in want if w[1] == "resource"], name
        heads, _ = rows_from(data, ["record_id", "content_length"])
        assert [(r["record_id"], r["content_length"]) for r in heads] == [(dict(f)["WARC-Record-ID"], len(b)) for f, b, *_ in records], name


def test_unwanted_payloads_are_not_inflated():
    body = os.urandom(600_000)
    records = [format_record([("WARC-Type", "response" if i == 3 else "resource"), ("WARC-Record-ID", f"<urn:n:{i}>")], body) for i in range(8)]
    packed = b"".join(gzip_member(r) for r in records)
    got, stream = rows_from(packed, ["record_id", "payload"], [ds.EqualTo(("record_type",), "response")])
    assert [r["payload"] for r in got] == [body]
    assert stream.inflated < 600_300 + 8 * 3 * warc.FEED  # one record, and the first bytes of the others
    _, stream = rows_from(packed, ["record_id"])
    assert stream.inflated < 8 * 3 * warc.FEED
    _, foreign = rows_from(b"".join(gzip.compress(r) for r in records), ["record_id"])
    assert foreign.inflated > 8 * 600_000  # their ends can only be found so


def test_filters_follow_sql():
    values = ["a", "ab", None, "b", ""]
    at = ("target_uri",)
    cases = [
        (ds.EqualTo(at, "a"), [True, False, None, False, False]), (ds.EqualNullSafe(at, "a"), [True, False, False, False, False]), (ds.EqualNullSafe(at, None), [False, False, True, False, False]),
        (ds.In(at, ("a", "b")), [True, False, None, True, False]), (ds.In(at, ("a", None)), [True, None, None, None, None]), (ds.GreaterThan(at, "a"), [False, True, None, True, False]),
        (ds.GreaterThanOrEqual(at, "a"), [True, True, None, True, False]), (ds.LessThan(at, "ab"), [True, False, None, False, True]), (ds.LessThanOrEqual(at, "a"), [True, False, None, False, True]),
        (ds.StringStartsWith(at, "a"), [True, True, None, False, False]), (ds.StringEndsWith(at, "b"), [False, True, None, True, False]), (ds.StringContains(at, "b"), [False, True, None, True, False]),
        (ds.IsNull(at), [False, False, True, False, False]), (ds.IsNotNull(at), [True, True, False, True, True]),
    ]
    for f, want in cases:
        column, test = warc._test(f)
        assert column == "target_uri" and [test(v) for v in values] == want, f
        assert [warc._test(ds.Not(f))[1](v) for v in values] == [None if w is None else not w for w in want], f
    assert warc._test(ds.EqualTo(("payload",), b"x")) is None and warc._test(ds.EqualTo(("headers", "a"), "x")) is None


def test_headers_and_lengths():
    first, fields = parse_fields("WARC/1.0\r\nA: 1\r\n folded\r\nb:2\r\nB: 3\r\nno field\r\nÜ: é:x\r\n\r\n".encode())
    assert first == "WARC/1.0" and fields == {"a": "1 folded", "b": "2", "ü": "é:x"}
    member = gzip_member(b"abc" * 100)
    assert gzip.decompress(member) == b"abc" * 100 and skip_lengths(member) == (len(member), 300)
    assert skip_lengths(gzip.compress(b"abc")) is None and skip_lengths(b"") is None
    assert as_uri("http://a/ b\r\nX: é") == "http://a/%20b%0D%0AX:%20é"


@pytest.mark.parametrize("cut", [1, 3, 40, 200])
def test_cut_files_are_errors(cut):
    records = made_records(n=4)
    records[-1] = (records[-1][0], b"x" * 300, *records[-1][2:])
    for name, data in packings(records).items():
        with pytest.raises(BadRecord):
            rows_from(data[:-cut] if name != "plain" or cut > 4 else data[: -cut - 4], ["record_id", "payload"])
    for junk in (b"junk", b"junk\r\n\r\n", gzip.compress(b"junk\r\n\r\n"), b"WARC/1.0\r\nContent-Length: x\r\n\r\n"):
        with pytest.raises(BadRecord):
            rows_from(junk, ["record_id"])


def test_plan_cuts_at_marks_and_packs_small_files():
    spans = plan([{"name": "big", "bytes": 100, "marks": [0, 30, 55, 90]}, *({"name": f"s{i}", "bytes": 10, "marks": [0]} for i in range(5))], 40)
    assert [s.ranges for s in spans] == [[("big", 0, 55)], [("big", 55, None)], [("s0", 0, None), ("s1", 0, None), ("s2", 0, None), ("s3", 0, None)], [("s4", 0, None)]]
    assert plan([], 40) == []


def by_hand(rows, min_bytes=0):
    payloads = [(i, (html or "").encode()) for i, _, html in rows]
    out = []
    for i, p in payloads:
        ids = [j for j, q in payloads if q == p and j is not None]
        first = min(ids) if ids and len(p) >= min_bytes else i
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((i, len(p), digest, "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_bytes", [0, 1, 4])
def test_pages_round_trip(spark, tmp_path, min_bytes):
    rng = random.Random(1)
    long = "".join(rng.choice("<p>é👍 \r\n") for _ in range(700_000))
    rows = [(1, "http://a/", "<p>x"), (2, "http://b/", "<p>x"), (2, "http://b/", "<p>x"), (9, None, None), (3, "u", ""), (4, "a b\r\nWARC-Type: revisit", long), (5, "", long)]
    rows += [(None, "n", "<p>x"), (None, "n", "only nulls"), (None, "m", "only nulls"), (-8, "é", "WARC/1.1\r\n\r\n"), (7, "z", "abc"), (6, "z", "abc"), (1, "w", "\x00"), (11, "q", "<p>X")]
    path = f"file://{tmp_path}/archive"
    write_warc(page_records(pages_of(spark, rows), min_bytes), path, file_bytes=4000, mark_bytes=600)
    back = read_warc(spark, path, SCHEMA, verify="true", partition_bytes=1500).where("record_type <> 'warcinfo'")
    got = back.select(page_id_of("record_id"), "payload_bytes", F.substring_index("payload_digest", ":", -1), "record_type", page_id_of("refers_to"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand(rows, min_bytes)
    texts = {bytes(r.payload).decode() for r in back.where("record_type = 'response'").select("payload").collect()}
    assert texts == {html or "" for _, _, html in rows}
    urls = {r.target_uri for r in back.select("target_uri").collect()}
    assert urls == {u if u is None else as_uri(u) for _, u, _ in rows}
    assert all(r.content_length is not None and r.date and r.headers["warc-type"] == r.record_type for r in back.collect())
    assert gzip.decompress(next(p for p in (tmp_path / "archive").iterdir() if p.name.endswith(".gz")).read_bytes()).startswith(b"WARC/1.1\r\n")


def test_pushdown_gives_what_a_filter_gives(spark, tmp_path):
    rows = [(i, f"http://h{i % 3}/{i}" if i % 4 else None, f"text {i % 9}") for i in range(60)]
    write_warc(page_records(pages_of(spark, rows)), str(tmp_path))
    every = read_warc(spark, str(tmp_path)).toPandas()
    cases = {
        "record_type = 'revisit'": every.record_type == "revisit", "target_uri like 'http://h1%'": every.target_uri.str.startswith("http://h1", na=False),
        "target_uri is null": every.target_uri.isna(), "not (target_uri = 'http://h1/1')": every.target_uri.notna() & (every.target_uri != "http://h1/1"),
        "record_type in ('response', 'x') and payload_bytes > 5": (every.record_type == "response") & (every.payload_bytes > 5), "content_length > 80": every.content_length > 80,
        "record_type = 'response' or http_status = 200": (every.record_type == "response") | (every.http_status == 200), "record_type in ('warcinfo')": every.record_type == "warcinfo",
    }
    for text, want in cases.items():
        got = read_warc(spark, str(tmp_path)).where(text)
        assert sorted(r.record_id for r in got.collect()) == sorted(every.record_id[want]), text
    only = read_warc(spark, str(tmp_path), "record_id string, record_type string").where("record_type = 'revisit'")
    assert "Filter (record_type" not in only._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="none of"):
        read_warc(spark, str(tmp_path), "no_such string").collect()


def test_leftovers_second_writes_and_no_rows(spark, tmp_path):
    path = str(tmp_path / "a")
    write_warc(page_records(pages_of(spark, [(1, "u", "x")])), path)
    (tmp_path / "a" / "part-lost.warc.gz").write_bytes(b"half a file of a lost executor")
    write_warc(page_records(pages_of(spark, [(2, "u", "y")])), path)
    assert sorted(r.record_id for r in read_warc(spark, path).where("record_type = 'response'").collect()) == ["<urn:page:1>", "<urn:page:2>"]
    write_warc(page_records(pages_of(spark, [])), str(tmp_path / "none"))
    assert read_warc(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="only added to"):
        page_records(pages_of(spark, [])).write.format("warc").mode("overwrite").save(path)
    writer = warc.WarcWriter(page_records(pages_of(spark, [])).schema, {"path": path}, False)
    lost = writer.write(iter([]))
    writer.abort([lost, None])
    foreign = tmp_path / "foreign"
    foreign.mkdir()
    for i, (name, data) in enumerate(packings(made_records()).items()):
        (foreign / f"{i}.warc{'' if name == 'plain' else '.gz'}").write_bytes(data)
    (foreign / "notes.txt").write_text("not an archive")
    assert read_warc(spark, f"file:{foreign}", "record_id string, payload binary").count() == 5 * 40
    files = [f for p in (tmp_path / "a").glob("_written-*") for f in json.loads(p.read_text())]
    assert sum(f["records"] for f in files) == 2 + len(files)  # each file begins with a warcinfo record


def test_wrong_payload_is_found(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\nabc"
    record = format_record([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:" + warc.base32_sha1(b"abd")), ("Content-Type", "application/http")], block)
    (tmp_path / "x.warc").write_bytes(record)
    assert read_warc(spark, str(tmp_path / "x.warc"), "payload binary").head().payload == b"abc"
    with pytest.raises(Exception, match="not the one of its digest"):
        read_warc(spark, str(tmp_path / "x.warc"), "record_type string", verify="true").collect()
