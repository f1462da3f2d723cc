"""Archives written and read back, and the two-level index against all captures."""

import gzip
import hashlib
import random

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from tidewatch.llm import warc

SCHEMA = "page_id long, url string, html string, key string, archive string, digest string, salt int"
LONG, SHORT = "<p>same</p>" * 30, "<p>short</p>"


@pytest.fixture(scope="module")
def given():
    rng = random.Random(3)
    rows = [(i, f"http://h{i % 7}.Example.com/p/{i % 40}?q={i % 3}#f", f"<html>{i} {rng.random()}</html>" + "x" * rng.randint(0, 400)) for i in range(300)]
    rows += [(1000 + i, "http://same.example.org/", LONG) for i in range(90)]  # one url and one payload of many pages
    rows += [(2000, None, None), (2001, "", ""), (2002, "no scheme\r\nWARC-Type: x", SHORT), (2003, "https://u:p@Host.EXAMPLE.net:8080", SHORT), (2004, "http://é.example.com/ü ü", "Ä" * 60)]
    rows += [(None, "http://nobody.example.com/a", LONG), (2005, "http://h1.example.com/p/1?q=1", "y" * 3_000_000), rows[3], rows[300]]
    return [(*r, "k", "a", "d", 1) for r in rows]


@pytest.fixture(scope="module")
def written(spark, given, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc"))
    pages = spark.createDataFrame(given, SCHEMA).repartition(5)
    captures = warc.write_archives(pages, folder, archive_bytes=20_000)
    return pages, captures, warc.write_index(captures, folder, block_lines=16, file_lines=70), folder


def test_all_pages_come_back(spark, given, written):
    pages, _, index, folder = written
    records = warc.read_records(warc.lookup(index, pages.select("url")), folder, range_bytes=8_000)
    got = warc.resolved(records).collect()
    first = {}
    for page, _, html, *_ in given:
        raw = (html or "").encode()
        if page is not None and len(raw) >= 100:
            first[raw] = min(first.get(raw, page), page)
    want = []
    for page, _, html, *_ in given:
        raw = (html or "").encode()
        again = page is not None and len(raw) >= 100 and page > first[raw]
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None))
    order = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=order) == sorted(want, key=order)
    held = {r.page_id: bytes(r.payload) for r in records.where("payload is not null").collect()}
    assert all(held[p] == (h or "").encode() for p, _, h, *_ in given if p in held) and len(held) == len({p for p, _, h, *_ in given}) - 89


def test_a_url_finds_its_captures_and_no_others(spark, given, written):
    _, captures, index, _ = written
    keys = {}
    for page, url, *_ in given:
        keys.setdefault(warc.surt(url), []).append(page)
    assert len(index.names) > 3  # the one url of many pages fills blocks, and files
    urls = ["http://same.example.org", "https://h3.example.com/p/3?q=0", None, "http://nowhere.example.com/", "a", "~", "http://h9.example.com/"]
    for url in urls:
        asked = spark.createDataFrame([(url,), (url,)], "url string")
        got = [r.page_id for r in warc.lookup(index, asked).collect()]
        assert sorted(got, key=str) == sorted(keys.get(warc.surt(url), []), key=str), url
    assert warc.lookup(index, captures.select(F.lit("x").alias("url")).limit(0)).count() == 0


def test_index_is_read_again_and_archives_are_plain_warc(written, spark):
    _, captures, index, folder = written
    assert warc.read_index(spark, folder) == index
    files = [f.path for f in fs.LocalFileSystem().get_file_info(fs.FileSelector(f"{folder}/archives"))]
    text = b"".join(gzip.open(f).read() for f in files)
    assert text.count(b"WARC/1.1\r\n") == captures.count() and b"\r\nWARC-Type: x" not in text


def test_broken_payloads_are_noticed(spark, written):
    _, captures, index, folder = written
    row = captures.where("record_type = 'response'").first()
    raw = warc._record("response", 1, "http://a/", "0" * 64, b"other", None, "2024-01-01T00:00:00Z")
    with open(f"{folder}/archives/broken", "wb") as f:
        f.write(raw)
    bad = spark.createDataFrame([(1, "broken", 0, len(raw))], warc.FOUND)
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_records(bad, folder).collect()
    lost = spark.createDataFrame([(5, "u", "revisit", 4, row.digest, 1)], warc.RECORD)
    with pytest.raises(Exception, match="response is missing"):
        warc.resolved(lost).collect()


def test_revisits_by_a_join_of_pages(spark, given, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    pages = spark.createDataFrame(given, SCHEMA)
    assert warc.write_archives(pages, str(tmp_path)).where("record_type = 'revisit'").count() == 89


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], SCHEMA)
    index = warc.write_index(warc.write_archives(pages, str(tmp_path)), str(tmp_path))
    assert index.names == [] and warc.lookup(index, spark.createDataFrame([("http://a/",)], "url string")).count() == 0


def test_keys():
    assert warc.surt("HTTP://www.Example.com:80/a?b=c#d") == "com,example,www)/a?b=c"
    assert warc.surt("https://u@x.org:8080") == "org,x:8080)/" and warc.surt(None) == warc.surt("") == "-)"
    assert warc.surt("mailto:a b") == "-)mailto:a%20b"
