"""Operator 12: what is written comes back, and transactions are assembled wherever their records lie."""

import gzip
import hashlib
from collections import Counter

import pytest

from quirefold.llm import warc


def page_of(metadata):
    return next((h["value"] for m in metadata for h in m["headers"] if h["name"] == "page-id"), None)


PAGES = [
    (1, "http://a.example/x y?q=1", "<p>one</p>" * 20), (2, "https://b.example", "<p>one</p>" * 20), (3, None, "short"), (4, "http://a.example/\r\nX: y", "short"), (5, "http://c.example/", None),
    (None, "http://d.example/", "<p>one</p>" * 20), (7, "http://e.example/", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 9), (8, "http://e.example/é", "\n\n\r\n\r\nÜ😀\x00" * 30), (9, "http://f.example/", "z" * 300_000),
    (10, "http://f.example/", "z" * 300_000), (10, "http://f.example/", "z" * 300_000), (11, "http://g.example/", "one line\n" * 4000), (12, None, ""), (1, "http://a.example/x y?q=1", "<p>one</p>" * 20), (13, "x" * 99, "y" * 99), (14, "w", "y" * 99), (15, "w", "v" * 100), (16, "w", "v" * 100),
]


def test_pages_come_back(spark, tmp_path):
    df = spark.createDataFrame([(*p, "clash", 5) for p in PAGES], "page_id long, url string, html string, type string, payload int").repartition(3)
    warc.write_archive(df, str(tmp_path / "a"))
    records = warc.read_archive(spark, str(tmp_path / "a")).cache()
    assert records.where("problem is not null").count() == 0 and records.count() == 3 * len(PAGES)
    got = warc.captures(records).collect()
    firsts = {}
    for i, url, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0, p[1] is None, p[1] or "")):
        firsts.setdefault(html or "", (i, url))
    want = Counter()
    for i, url, html in PAGES:
        body = (html or "").encode()
        revisit = len(body) >= 100 and firsts[html] != (i, url)
        want[None if i is None else str(i), url and url.replace("\r", "%0D").replace("\n", "%0A"), len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", str(firsts[html][0]) if revisit else None] += 1
    told = Counter()
    for c in got:
        whole = c.refers_to or c.response
        told[page_of(c.metadata), c.target_uri, whole["payload_bytes"], whole["payload_sha256"], c.type, page_of(c.refers_to.metadata) if c.refers_to else None] += 1
        assert c.request.start_line.startswith("GET ") and c.response.start_line == "HTTP/1.1 200 OK"
        assert c.response.payload_digest == "sha256:" + whole["payload_sha256"]
        assert c.type == "revisit" or hashlib.sha256(c.response.payload).hexdigest() == c.response.payload_sha256
    assert told == want
    assert warc.captures(records.drop("payload")).count() == len(PAGES)
    assert b"".join(gzip.open(f).read() for f in (tmp_path / "a").glob("*.gz")).count(b"WARC/1.1\r\nWARC-Type: response") == sum(n for k, n in want.items() if k[4] == "response")


def record(kind, name, to=(), block=b"", more=""):
    head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <{name}>\r\n" + "".join(f"WARC-Concurrent-To:  <{t}>\r\n" for t in to)
    return f"{head}WARC-Date: 2020-01-01T00:00:00Z\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_crawled_archives(spark, tmp_path):
    """One gzip member a record, links in any direction and over files, repeated headers, any bytes, broken files."""
    http = "Content-Type: application/http; msgtype=response\r\n"
    body = bytes(range(256)) * 3
    one = [record("warcinfo", "i"), record("response", "r1", ["q1"], b"HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nSet-Cookie: b\r\nX: c\r\n d\r\n\r\n" + body, http), record("request", "q1", [], b"GET / HTTP/1.1\r\n\r\n", http)]
    two = [record("metadata", "m1", ["q1"], b"k: v\r\n", "Content-Type: application/warc-fields\r\n"), record("metadata", "m0", ["r1"], b"k: w\r\n", "Content-Type: application/warc-fields\r\n"), record("response", "r2", [], b"HTTP/1.1 404 No\r\n\r\n", http),
           record("metadata", "lost", ["none"]), record("revisit", "v", [], b"HTTP/1.1 200 OK\r\n\r\n", http + "WARC-Refers-To: <gone>\r\n"), record("resource", "f", [], b"plain")]
    (tmp_path / "a.gz").write_bytes(b"".join(gzip.compress(x) for x in one))
    (tmp_path / "b.gz").write_bytes(b"".join(gzip.compress(x) for x in two))
    (tmp_path / "c.gz").write_bytes(gzip.compress(record("response", "r3", [], b"12345", http)[:-7]))
    (tmp_path / "d.gz").write_bytes(gzip.compress(record("response", "r4", [], b"HTTP/1.1 200 OK\r\n\r\nx", http) + b"junk\r\nmore: 1\r\n\r\n"))
    (tmp_path / "e.gz").write_bytes(gzip.compress(b""))
    records = warc.read_archive(spark, str(tmp_path)).cache()
    assert sorted((r.file[-4:], r.problem) for r in records.where("problem is not null").collect()) == [("c.gz", "cut off"), ("d.gz", "not a record")]
    got = {r.capture_id: r for r in warc.captures(records).collect()}
    assert sorted(got) == ["<f>", "<r1>", "<r2>", "<r4>", "<v>"]
    r1 = got["<r1>"]
    assert r1.request.record_id == "<q1>" and [m.record_id for m in r1.metadata] == ["<m0>", "<m1>"] and bytes(r1.response.payload) == body
    assert [tuple(h) for h in r1.response.headers] == [("set-cookie", "a"), ("set-cookie", "b"), ("x", "c d")]
    assert got["<r2>"].request is None and got["<r2>"].metadata == [] and got["<v>"].refers_to is None and bytes(got["<f>"].response.payload) == b"plain"


def test_no_pages(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.captures(warc.read_archive(spark, str(tmp_path / "a"))).count() == 0


@pytest.mark.parametrize("size", [1, 7, 10**9])
def test_cutting_at_any_byte(size):
    data = b"".join(record("response", f"r{k}", [], b"x\r\n\r\n" * k) for k in range(6))
    cutter = warc._Cutter("f")
    got = [r for at in range(0, len(data), size) for r in cutter.feed(data[at : at + size])] + list(cutter.close())
    assert [(r["record_id"], r["payload_bytes"]) for r in got] == [(f"<r{k}>", 5 * k) for k in range(6)]
