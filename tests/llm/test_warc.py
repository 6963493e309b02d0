from __future__ import annotations

import base64
import gzip
import hashlib
import zlib

import pytest

from skyledger.llm import warc_index as w

ROWS = [(1, "http://www.A.com/x?q=1#f", "<p>é</p>"), (2, "https://a.com:8080/y", "<p>é</p>"), (3, None, None), (4, "http://b.org", ""), (5, "http://a.com/x?q=1", "long " * 5000), (5, "http://a.com/x?q=1", "long " * 5000), (None, "http://c.net/ü", "<p>é</p>"), (9, "odd\r\nurl", "<p>ü</p>")]


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string")


def plain(rows, least=0):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        top = max(same, default=None)
        kind = "response" if len(data) < least or top is None or page == top else "revisit"
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, top if kind == "revisit" else None))
    return sorted(out, key=str)


def read_all(spark, pages, **kw):
    folder = w.write_archives(pages, **kw)
    return folder, sorted((tuple(r) for r in w.read_captures(w.lookup(w.build_index(spark, folder), pages)).collect()), key=str)


@pytest.mark.parametrize("least", [0, 100])
def test_rows(spark, pages, least):
    assert read_all(spark, pages, least_bytes=least)[1] == plain(ROWS, least)


def test_many_parts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(w, "BLOCK", 3)
    monkeypatch.setattr(w, "PART", 10)
    rows = [(i, f"http://h{i % 5}.com/{'same' if i % 3 else i}", f"body {i % 40}") for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, found = read_all(spark, pages)
    assert found == plain(rows)
    index = w.build_index(spark, folder)
    assert len(index.bounds) > 3
    some = spark.createDataFrame([("http://h1.com/same",), ("http://h1.com/none",)], "url string")
    assert w.read_captures(w.lookup(index, some)).count() == sum(u == "http://h1.com/same" for _, u, _ in rows)


def test_archives_are_plain_gzip(spark, pages):
    folder = w.write_archives(pages)
    data = b"".join(gzip.decompress(bytes(r.content)) for r in spark.read.format("binaryFile").load(folder).collect() if r.length)
    assert data.count(b"WARC/1.1\r\n") == len(ROWS) and data.endswith(b"\r\n\r\n")


def test_keys():
    assert w.url_key("http://www.A.com:80/B?c#d") == "com,a)/b?c"
    assert w.url_key("https://x.y.org:8080") == "org,y,x:8080)/" and w.url_key(None) == w.url_key("") == w.url_key("about:blank") and w.url_key("http://u@h.com/p q") == "com,h)/p%20q"


def test_damage():
    member = w.response(1, "http://a.com", b"payload", w.payload_digest(b"other"), "2024-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        w.parse(member)
    with pytest.raises(ValueError):
        list(w.members(zlib.compress(b"x" * 100, wbits=31)[:-4]))


def test_empty_table(spark, pages):
    assert read_all(spark, pages.limit(0))[1] == []


def test_archives_are_bounded_by_bytes(spark, monkeypatch):
    """Many archives; none is longer than the bound and one record, and one payload holds a third of all rows."""
    monkeypatch.setattr(w, "ARCHIVE_BYTES", 2_000)
    rows = [(i, f"http://h{i}.com/", "the same page" if i % 3 == 0 else f"page {i} " + hashlib.sha256(str(i % 50).encode()).hexdigest() * (i % 9)) for i in range(400)]
    folder, found = read_all(spark, spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert found == plain(rows)
    sizes = [r.length for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("length").collect()]
    assert len(sizes) > 40 and max(sizes) < 2_000 + 1_000


def test_hot_payloads_stay_spread(spark, monkeypatch):
    monkeypatch.setattr(w, "HOT", 0.2)
    rows = [(i, "http://h.com/", "hot" if i % 2 else f"p{i % 30}") for i in range(600)]
    assert read_all(spark, spark.createDataFrame(rows, "page_id long, url string, html string"))[1] == plain(rows)
