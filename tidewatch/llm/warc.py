"""WARC archives of pages, and a two-level index of their captures.

Writing. Equal payloads are found by SHA-256: minima of page ids are taken before any shuffle, with
a salt, so that a payload of a third of all pages is no hot key. Only pages that revisit an earlier
one need to be told; a table of few revisits is broadcast, a larger one is joined by page, where
nothing is hot. Every task writes its pages, a gzip member a record, to archives of its own names in
the shared folder, and returns where each record lies. A task that runs again writes new archives;
what no returned row names is never read.

Index. Captures are sorted by key, the url with its host reversed, and dealt by ranges into at most
``MAX_FILES`` index files; a key of many captures is spread over files by page id. A file is a row of
compressed blocks of ``BLOCK_LINES`` lines; beside it stands its sparse directory, the first key of
each block and the block's range. What the driver knows is the first and last key of each file.

Reading. A question goes to the files whose keys enclose it, its task looks it up in their directory
by binary search, reads the range of the blocks that may hold it, one at a time, and searches them
likewise. The captures found are dealt by archive and sorted by place, so that neighbours are read
in one range of at most ``RANGE_BYTES``.

Paths are opened by pyarrow's file systems, so the folder may be anything that these reach.

Defined cases: null html is an empty payload; null and empty urls have the target urn:x-page:ID and
one key; blanks and control characters in urls are escaped, so a url can't end a header; rows of a
null page id are always responses, and so is every repeated row of the page that is the response;
payloads shorter than ``LEAST`` bytes are never revisited; a payload is held whole while its record is
written or read; an empty table gives no archive and an empty index; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewatch.llm.common import small_batches, tidy
from tidewatch.session import ensure_checkpoint_dir, table

LEAST = 100
ARCHIVE_BYTES, RANGE_BYTES, GAP_BYTES = 256_000_000, 4_000_000, 64_000
BLOCK_LINES, FILE_LINES, MAX_FILES = 3000, 10_000, 4096
#: Revisits that are broadcast, about 100 bytes each; more are joined by page.
BROADCAST_ROWS = 200_000
SALTS = 32

CAPTURE = "key string, page_id long, archive string, offset long, length long, digest string, record_type string"
FOUND = "page_id long, archive string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path on it); Hadoop's file:/x is a local path."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


def escaped(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", text)


def surt(url: str | None) -> str:
    """The key of a url: its host's labels from the last to the first, its port unless 80 or 443, then path and query."""
    _, there, rest = (url or "").partition("://")
    if not there:
        return escaped(f"-){url or ''}")
    host, path = re.match("([^/?#]*)([^#]*)", rest, re.S).groups()
    name, _, port = host.rpartition("@")[2].partition(":")
    labels = re.sub("[A-Z]", lambda m: m[0].lower(), ",".join(name.split(".")[::-1]))
    return escaped(labels + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (path or "/"))


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload has an earlier page."""
    slim = pages.where(F.octet_length("html") >= LEAST).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), (F.xxhash64("page_id") % SALTS).alias("salt"))
    slim = slim.where("page_id is not null").distinct().checkpoint()
    parts = slim.groupBy("digest", "salt").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    shared = parts.groupBy("digest").agg(F.min("first").alias("refers_to"), F.max("last").alias("last")).where("refers_to < last").drop("last")
    near = parts.select("digest", "salt").join(shared, "digest")  # at most SALTS rows a payload
    return slim.join(near, ["digest", "salt"]).where("page_id > refers_to").select("page_id", "digest", "refers_to")


def _record(kind: str, page: int | None, url: str | None, digest: str, payload: bytes, refers: int | None, date: str) -> bytes:
    name = lambda p: f"urn:x-page:{'' if p is None else p}"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name(page)}:{digest}>", f"WARC-Date: {date}", f"WARC-Target-URI: {escaped(url) if url else name(page)}", f"WARC-Payload-Digest: sha256:{digest}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{name(refers)}:{digest}>"]
    else:
        block += payload
    head = "\r\n".join([*lines, "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]).encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([packer.compress(head), packer.compress(block), packer.compress(b"\r\n\r\n"), packer.flush()])


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each of pages (page_id, url, html) under folder; returns the table of captures (CAPTURE), which is stored there, too."""
    small_batches(pages.sparkSession)
    store, root = opened(folder)
    store.create_dir(f"{root}/archives")
    again = revisits(pages).checkpoint()
    again = F.broadcast(again) if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else again
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    schema = to_arrow_schema(StructType.fromDDL(CAPTURE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                told = []
                for page, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/archives/{name}", compression=None)
                    kind = "response" if refers is None else "revisit"
                    raw = _record(kind, page, url, digest, html, refers, date)
                    out.write(raw)
                    told.append({"key": surt(url), "page_id": page, "archive": name, "offset": at, "length": len(raw), "digest": digest, "record_type": kind})
                    at += len(raw)
                yield pa.RecordBatch.from_pylist(told, schema)
        finally:
            if out is not None:
                out.close()

    rows.mapInArrow(tidy(run), CAPTURE).write.parquet(f"{folder}/captures")
    return pages.sparkSession.read.schema(CAPTURE).parquet(f"{folder}/captures")


@dataclass
class Index:
    """folder, and the first and last key and name of each index file, by first key."""

    folder: str
    first: list[str]
    last: list[str]
    names: list[str]


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES, file_lines: int = FILE_LINES) -> Index:
    """Write index files and their directories under folder."""
    spark = captures.sparkSession
    store, root = opened(folder)
    store.create_dir(f"{root}/index")
    files = min(MAX_FILES, max(1, -(-captures.count() // file_lines)))
    order = ["key", "page_id", "archive", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        name, lines, directory, at, first, last = uuid.uuid4().hex, [], [], 0, None, None
        out = None

        def block() -> None:
            nonlocal at
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            raw = packer.compress("".join(x for _, x in lines).encode()) + packer.flush()
            directory.append(f"{lines[0][0]} {at} {len(raw)}\n")
            out.write(raw)
            at += len(raw)
            lines.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out, first = store.open_output_stream(f"{root}/index/{name}.cdx.gz", compression=None), row["key"]
                key = last = row.pop("key")
                lines.append((key, f"{key} {json.dumps(row, separators=(',', ':'))}\n"))
                if len(lines) >= block_lines:
                    block()
        if out is None:
            return
        if lines:
            block()
        out.close()
        with store.open_output_stream(f"{root}/index/{name}.idx", compression=None) as f:
            f.write("".join(directory).encode())
        yield pa.RecordBatch.from_pydict({"first": [first], "last": [last], "name": [name]})

    dealt = captures.repartitionByRange(files, *order).sortWithinPartitions(*order)
    dealt.mapInArrow(tidy(run), "first string, last string, name string").write.parquet(f"{folder}/files")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> Index:
    """The index of a folder: of each of its files one row comes to the driver."""
    rows = spark.read.schema("first string, last string, name string").parquet(f"{folder}/files").orderBy("first", "last").collect()
    return Index(folder, [r["first"] for r in rows], [r["last"] for r in rows], [r["name"] for r in rows])


class _File:
    """One index file, opened: its directory, and the block that was read last."""

    def __init__(self, folder: str, name: str):
        store, root = opened(folder)
        with store.open_input_stream(f"{root}/index/{name}.idx", compression=None) as f:
            rows = [line.split(b" ") for line in f.read().splitlines()]
        self.keys, self.ranges = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]
        self.data, self.at, self.lines = store.open_input_file(f"{root}/index/{name}.cdx.gz"), -1, []

    def block(self, n: int) -> list[bytes]:
        if n != self.at:
            offset, length = self.ranges[n]
            self.at, self.lines = n, zlib.decompress(self.data.read_at(length, offset), 31).splitlines()
        return self.lines

    def captures(self, key: bytes) -> Iterator[dict]:
        """Captures of a key: the first may stand in the block before the first that begins with the key."""
        start = key + b" "
        n = max(bisect.bisect_left(self.keys, key) - 1, 0)
        while n < len(self.keys) and self.keys[n] <= key:
            lines = self.block(n)
            for k in range(bisect.bisect_left(lines, start), len(lines)):
                if not lines[k].startswith(start):
                    return
                yield json.loads(lines[k][len(start) :])
            n += 1


def lookup(index: Index, urls: DataFrame) -> DataFrame:
    """Captures (FOUND) of the keys of urls (url), each key's once."""
    small_batches(urls.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(FOUND))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, files = [], []
            for url in batch.column(0).to_pylist():
                key = surt(url)
                # Files are in order and overlap in their ends alone, so those that enclose a key are neighbours.
                for n in range(bisect.bisect_left(index.last, key), bisect.bisect_right(index.first, key)):
                    keys.append(key)
                    files.append(n)
            yield pa.RecordBatch.from_pydict({"file": pa.array(files, pa.int32()), "key": pa.array(keys, pa.string())})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file, out = None, None, []
        for batch in batches:
            for n, key in zip(batch.column("file").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if n != at:
                    at, file = n, _File(index.folder, index.names[n])
                for row in file.captures(key.encode()):
                    out.append({c: row[c] for c in schema.names})
                    if len(out) >= BLOCK_LINES:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    asked = urls.select("url").distinct().mapInArrow(ask, "file int, key string").distinct()
    return asked.repartitionByRange("file", "key").sortWithinPartitions("file", "key").mapInArrow(tidy(find), FOUND)


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a record, whose lengths are checked."""
    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block, end = rest[: int(headers["Content-Length"])], rest[int(headers["Content-Length"]) :]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    if end != b"\r\n\r\n" or (headers["WARC-Type"] == "response" and len(payload) != int(fields["Content-Length"])):
        raise ValueError(f"broken record {headers['WARC-Record-ID']}")
    return headers, fields, payload


def read_records(captures: DataFrame, folder: str, payloads: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """RECORD, and the payload if wanted, of captures (FOUND). A payload that differs from its digest fails the job."""
    small_batches(captures.sparkSession)
    ddl = RECORD + (", payload binary" if payloads else "")
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def page_of(uri: str) -> int | None:
        page = uri.strip("<>").split(":")[2]
        return int(page) if page else None

    def record(raw: bytes) -> dict:
        headers, fields, payload = parsed(raw)
        digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"]
        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
        row = {"page_id": page_of(headers["WARC-Record-ID"]), "url": headers["WARC-Target-URI"], "record_type": kind, "payload_digest": digest, "payload_bytes": int(fields["Content-Length"])}
        row["refers_to"] = page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None
        return row | ({"payload": payload if kind == "response" else None} if payloads else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        at, file = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True))
            while rows:
                archive, begin, length = rows[0]
                n, end = 1, begin + length
                while n < len(rows) and rows[n][0] == archive and rows[n][1] - end <= GAP_BYTES and rows[n][1] + rows[n][2] - begin <= range_bytes:
                    end = max(end, rows[n][1] + rows[n][2])
                    n += 1
                if archive != at:
                    at, file = archive, store.open_input_file(f"{root}/archives/{archive}")
                raw = file.read_at(end - begin, begin)
                yield pa.RecordBatch.from_pylist([record(raw[o - begin : o - begin + size]) for _, o, size in rows[:n]], schema)
                rows = rows[n:]

    return captures.repartition("archive").sortWithinPartitions("archive", "offset").mapInArrow(tidy(run), ddl)


def resolved(records: DataFrame) -> DataFrame:
    """records (RECORD) of which revisits have the size that their response has; the job fails if there is none."""
    response = records.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("size"))
    met = records.join(response, ["refers_to", "payload_digest"], "left")
    lost = (F.col("record_type") == "revisit") & F.col("size").isNull()
    size = F.when(lost, F.raise_error(F.lit("a revisited response is missing"))).otherwise(F.coalesce("size", "payload_bytes"))
    return met.withColumn("payload_bytes", size).drop("size")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives and index of all pages in the shared folder, read back by the urls of all pages."""
    pages = table(spark, sf_dir, "pages")
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = write_index(write_archives(pages, folder), folder)
    records = read_records(lookup(index, pages.select("url")), folder, payloads=False).checkpoint()
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f, sha256(h) AS d, strlen(h)::BIGINT AS n FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > f THEN f END AS refers_to FROM q
"""
