"""Exact substring deduplication with suffix arrays.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else, in any
text, as the input stands. Suffix arrays are built per shard; what makes shards complete is that a
string's least hash of GRAM bytes is the same wherever it stands:

1. Neighbouring strings of a text that have the same least hash form a segment, named by it. A
   string that stands twice has its segments under one name, and that name has two places.
2. Names with one place are left out, which loses nothing. Segments that are equal as a whole are
   counted: with two of them all their strings are repeats, whatever else there is.
3. The distinct contents of the other names are dealt into shards by name. Each shard sorts the
   suffixes of its contents by external induced sorting (see ``induced``); strings that stand twice
   are neighbours there, and neighbours are compared over ``length`` bytes.
4. Repeats go back to the texts as ranges of places, are merged, and their bytes are cut out.

A name's first filter is a bit table of fixed size that may let single names through but never
loses one. Copies of a text cost a row a segment, but their content travels once per task at
most, and only texts that may lose bytes are shuffled. Shards have about SHARD_BYTES, in which one
name's contents stay together; a name of more bytes than that (a short passage in many different
surroundings) isn't sorted but has its strings' hashes counted, which is a sum over all tasks and
bounds every shard by a few times SHARD_BYTES. Common-prefix values are used only against ``length``,
so they are not carried through the induction.

Segments and strings count as equal if their 64-bit hashes (and lengths) are.

Defined cases: null and empty texts have no bytes; texts shorter than ``length`` lose none;
repeated rows repeat each other like any two texts; null ids are ids like others; matches never
cross texts; cuts may split a character, so what is kept is bytes; extra columns stay, in
``remove_repeats`` unless they are called n_bytes, n_removed, n_spans or kept, and all of them in
``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.bits import in_table, marked, table_of
from tidewatch.llm.common import small_batches, tidy, tidy_group
from tidewatch.llm.hashing import mix
from tidewatch.llm.induced import suffix_order
from tidewatch.session import ensure_checkpoint_dir, table

LENGTH, GRAM = 400, 32
SHARD_BYTES = 2_000_000
#: Bytes of text that are hashed at a time; a longer text is hashed alone.
SLICE = 1_500_000

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(4_400).integers(1, 1 << 63, 256, np.uint64)


class Hashes:
    """Hashes of any range of bytes, from one running sum."""

    def __init__(self, raw: np.ndarray):
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(len(raw) + 1, _STEP)) * _BACK
            self.down = np.cumprod(np.full(len(raw) + 1, _BACK)) * _STEP
            self.total = np.r_[_U(0), np.cumsum(_BYTE[raw] * up[:-1])]

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[end] - self.total[begin]) * self.down[begin])

    def each(self, size: int) -> np.ndarray:
        """Of every range of one size."""
        with np.errstate(over="ignore"):
            return mix((self.total[size:] - self.total[:-size]) * self.down[: len(self.total) - size])


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) of every run of ``width`` values."""
    have = 1
    while have * 2 <= width:
        x, have = least(x[:-have], x[have:]), have * 2
    rest = width - have
    return least(x[:-rest], x[rest:]) if rest else x


def _gathered(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, start, bytes) of the texts of at least ``length`` bytes, some megabytes at a time."""
    rows, parts, size = [], [], 0
    texts = batch.column("text").cast(pa.large_binary()).to_pylist()
    for n, raw in enumerate(texts):
        if raw is not None and len(raw) >= length:
            rows.append(n)
            parts.append(raw)
            size += len(raw)
        if parts and (size >= SLICE or n == len(texts) - 1):
            yield np.array(rows), np.cumsum([0, *map(len, parts)]), np.frombuffer(b"".join(parts), np.uint8)
            rows, parts, size = [], [], 0
    if parts:
        yield np.array(rows), np.cumsum([0, *map(len, parts)]), np.frombuffer(b"".join(parts), np.uint8)


def _segments(starts: np.ndarray, raw: np.ndarray, length: int, gram: int):
    """Hashes, least hashes of all strings, and (text, begin, end) of segments; strings across texts are left out."""
    hashes = Hashes(raw)
    grams = hashes.each(gram)
    least = _slide(grams, length - gram + 1, np.minimum)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = text[: len(least)] == text[length - 1 :]
    new = np.r_[True, (least[1:] != least[:-1]) | (text[1 : len(least)] != text[: len(least) - 1]) | (inside[1:] != inside[:-1])]
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(least)]
    own = inside[begin]
    return hashes, grams, least, inside, text[begin[own]], begin[own], end[own]


def _names(length: int, gram: int):
    """A row for each place of a name in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, starts, raw in _gathered(batch, length):
                _, grams, least, inside, *_ = _segments(starts, raw, length, gram)
                width = length - gram + 1
                pad = np.zeros(width - 1, np.uint64)
                most = _slide(np.r_[pad, np.where(inside, least, _U(0)), pad], width, np.maximum)
                yield pa.RecordBatch.from_arrays([pa.array(grams[most[: len(grams)] == grams].astype(np.int64))], ["name"])

    return run


SEGMENT = pa.schema([("name", pa.int64()), ("content", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("bytes", pa.binary())])


def _shared(length: int, gram: int, bits: np.ndarray):
    """Segments of names that may have a second place; bytes only with the first of a content in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for rows, starts, raw in _gathered(batch, length):
                hashes, _, least, _, text, begin, end = _segments(starts, raw, length, gram)
                own = in_table(bits, least[begin])
                text, begin, end = text[own], begin[own], end[own]
                with np.errstate(over="ignore"):
                    content = mix(hashes.of(begin, end + length - 1) + (end - begin).astype(np.uint64)).astype(np.int64)
                sent = []
                for c, b, e in zip(content.tolist(), begin.tolist(), end.tolist(), strict=True):
                    sent.append(None if c in seen else raw[b : e + length - 1].tobytes())
                    seen.add(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least[begin].astype(np.int64)), pa.array(content), pa.array(keys[rows[text]]), pa.array(begin - starts[text]), pa.array((end - begin).astype(np.int32)), pa.array(sent, pa.binary())], schema=SEGMENT
                )

    return run


def repeated_places(contents: list[bytes], length: int) -> list[np.ndarray]:
    """For each content the starts of strings of ``length`` bytes that start at another place, too."""
    sizes = np.array([len(c) for c in contents])
    symbols = np.zeros(int(sizes.sum()) + len(contents) + 1, np.uint16)
    first = np.r_[0, np.cumsum(sizes + 1)]
    raw = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    symbols[:-1] = raw
    symbols[:-1] += 2
    symbols[first[1:] - 1] = 1  # between contents, less than any byte; 0 ends the whole
    order = suffix_order(symbols)
    del symbols
    order = order[order < len(raw)]
    whole = np.ones(len(raw), bool)  # places with at least length bytes to their content's end
    for end in first[1:]:
        whole[max(end - length, 0) : end] = False
    order = order[whole[order]]
    hashed = Hashes(raw).of(order, order + length)
    same = np.r_[False, hashed[1:] == hashed[:-1], False]
    found = np.sort(order[same[1:] | same[:-1]])
    cut = np.searchsorted(found, first)
    return [found[a:b] - s for a, b, s in zip(cut[:-1], cut[1:], first[:-1], strict=True)]


def _ranges(places: np.ndarray) -> tuple[list[int], list[int]]:
    if not len(places):
        return [], []
    cut = np.flatnonzero(np.diff(places) > 1)
    return places[np.r_[0, cut + 1]].tolist(), (places[np.r_[cut, len(places) - 1]] + 1).tolist()


def _sort_shard(length: int):
    def run(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        found = [_ranges(p) for p in repeated_places(list(shard["bytes"]), length)]
        return pd.DataFrame({"name": shard["name"], "content": shard["content"], "begins": [f[0] for f in found], "ends": [f[1] for f in found]})

    return run


def _hash_strings(length: int):
    """The hash and start of every string of contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, contents = batch.column("name").to_numpy(), batch.column("content").to_numpy()
            for n, raw in enumerate(batch.column("bytes").to_pylist()):
                hashed = Hashes(np.frombuffer(raw, np.uint8)).each(length).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashed), names[n])), pa.array(np.full(len(hashed), contents[n])), pa.array(np.arange(len(hashed))), pa.array(hashed)], ["name", "content", "begin", "string"])

    return run


FOUND = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])


def _cut(length: int):
    """Bytes kept of each text, from ranges of starts of repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, spans = [], [], []
            ranges = batch.column("__tw_ranges")
            cut = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(ranges), 0).to_numpy())]
            begins, ends = (ranges.flatten().field(c).to_numpy() for c in ("begin", "end"))
            for row, raw in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
                raw, out, at, n = raw or b"", [], 0, 0
                begin, end = begins[cut[row] : cut[row + 1]], ends[cut[row] : cut[row + 1]] + length - 1
                order = np.argsort(begin)
                for x, y in zip(begin[order].tolist(), end[order].tolist(), strict=True):
                    if x > at or not n:
                        out.append(raw[at:x])
                        n += 1
                    at = max(at, y)
                out.append(raw[at:])
                whole = b"".join(out)
                kept.append(whole)
                removed.append(len(raw) - len(whole))
                spans.append(n)
            names = [n for n in batch.schema.names if n != "__tw_ranges"]
            sizes = pa.array([len(k) + r for k, r in zip(kept, removed, strict=True)], pa.int64())
            found = pa.StructArray.from_arrays([sizes, pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], FOUND.names)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), found], [*names, "__tw_found"])

    return run


def repeat_ranges(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """keyed: key, text. Returns key and ranges: array<struct<begin, end>> of starts of repeated strings, for keys that have any."""
    names = keyed.select("text").mapInArrow(tidy(_names(length, gram)), "name long")
    twice = names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name").checkpoint()
    bits = table_of(twice, "name")
    found = keyed.mapInArrow(tidy(_shared(length, gram, bits)), "name long, content long, key long, at long, n int, bytes binary").checkpoint()
    segments = found.select("name", "content", "key", "at", "n")
    counts = segments.groupBy("name", "content").agg(F.count("*").alias("copies"), F.max("n").alias("n"))
    # A name needs sorting if it has several contents, or several places within one content.
    places = twice.join(counts.groupBy("name").agg(F.count("*").alias("contents")), "name")
    contents = found.where("bytes is not null").select("name", "content", "bytes").dropDuplicates(["name", "content"])
    alone = counts.where("copies = 1").select("name").distinct()  # without one, every string is known to repeat
    to_sort = contents.join(places.join(alone, "name").select("name"), "name").checkpoint()
    size = to_sort.agg(F.sum(F.length("bytes")).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // shard_bytes))
    heavy = to_sort.groupBy("name").agg(F.sum(F.length("bytes")).alias("n")).where(F.col("n") > shard_bytes).select("name")
    dealt = to_sort.join(heavy, "name", "left_anti").withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int"))
    sorted_ = dealt.groupBy("shard").applyInPandas(tidy_group(_sort_shard(length)), "name long, content long, begins array<long>, ends array<long>")
    strings = to_sort.join(heavy, "name").select("name", "content", "bytes").mapInArrow(tidy(_hash_strings(length)), "name long, content long, begin long, string long")
    standing_twice = strings.groupBy("name", "string").agg(F.count("*").alias("n")).where("n > 1").select("name", "string")
    in_content = Window.partitionBy("name", "content").orderBy("begin")
    in_rows = strings.join(standing_twice, ["name", "string"]).withColumn("run", F.col("begin") - F.row_number().over(in_content))
    runs = in_rows.groupBy("name", "content", "run").agg(F.min("begin").alias("begin"), (F.max("begin") + 1).alias("end"))
    counted = runs.groupBy("name", "content").agg(F.collect_list(F.struct("begin", "end")).alias("own"))
    some = sorted_.where(F.size("begins") > 0).select("name", "content", F.arrays_zip(F.col("begins").alias("begin"), F.col("ends").alias("end")).alias("own")).unionByName(counted)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n").cast("long").alias("end")))
    verdict = (
        counts.join(some, ["name", "content"], "left")
        .withColumn("own", F.when(F.col("copies") > 1, whole).otherwise(F.col("own")))
        .where("own is not null").select("name", "content", "own")
    )
    ranges = segments.join(verdict, ["name", "content"]).select("key", F.transform("own", lambda r: F.struct((r["begin"] + F.col("at")).alias("begin"), (r["end"] + F.col("at")).alias("end"))).alias("own"))
    return ranges.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("__tw_ranges"))


def _searched(docs: DataFrame, length: int, gram: int, shard_bytes: int) -> DataFrame:
    """docs with __tw_found, a struct of n_bytes, n_removed, n_spans and kept. Only texts that a bit table doesn't clear are shuffled."""
    ensure_checkpoint_dir(docs.sparkSession)
    keyed = docs.withColumn("__tw_key", F.xxhash64("doc_id", "text"))
    ranges = repeat_ranges(keyed.select(F.col("__tw_key").alias("key"), "text"), length, gram, shard_bytes).checkpoint()
    may = marked(keyed, "__tw_key", table_of(ranges, "key"), "__tw_may")
    losing = may.where("__tw_may").join(ranges.withColumnRenamed("key", "__tw_key"), "__tw_key", "left")
    staying = may.where("not __tw_may").withColumn("__tw_ranges", F.lit(None).cast(ranges.schema["__tw_ranges"].dataType))
    rows = losing.select(*docs.columns, "__tw_ranges").unionByName(staying.select(*docs.columns, "__tw_ranges"))
    return rows.mapInArrow(tidy(_cut(length)), T.StructType([*docs.schema.fields, T.StructField("__tw_found", FOUND)]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (binary) for each row."""
    found = _searched(docs.drop(*FOUND.names), length, gram, shard_bytes)
    return found.select(*[c for c in found.columns if c != "__tw_found"], "__tw_found.*")


def _as_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [k.decode(errors="ignore") for k in batch.column("__tw_found").field("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names], batch.schema.names)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows and columns of docs with what is kept for text, less characters that a cut splits, and n_chars to match; null stays null."""
    found = _searched(docs, length, gram, shard_bytes)
    cut = found.where("__tw_found.n_removed > 0")
    cut = cut.mapInArrow(tidy(_as_text), cut.schema)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(found.schema["n_chars"].dataType))
    return found.where("__tw_found.n_removed = 0").select(*docs.columns).unionByName(cut.select(*docs.columns))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _doubled_sql() -> str:
    """Keys of strings of 2, 4, ... 256 bytes, each from two halves, and of 400 from three of these."""
    steps, of, by = [], "p1", "OVER (PARTITION BY r ORDER BY i)"
    for n in (2, 4, 8, 16, 32, 64, 128, 256):
        kept = ", k16" if n > 16 else ""
        kept += ", k128" if n > 128 else ""
        steps.append(f"p{n} AS (SELECT r, i{kept}, hash(k{n // 2}, lead(k{n // 2}, {n // 2}) {by}) AS k{n}{f', k{n // 2}' if n == 256 else ''} FROM {of})".replace(", k128, hash", ", hash"))
        of = f"p{n}"
    return ",\n".join(steps) + f",\np400 AS (SELECT r, i, hash(k256, lead(k128, 256) {by}, lead(k16, 384) {by}) AS k FROM p256)"


OP4_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h FROM documents),
p1 AS (SELECT r, unnest(range(0, len(h) // 2)) AS i, hash(unnest(regexp_extract_all(h, '..'))) AS k1 FROM d WHERE len(h) >= 800),
{_doubled_sql()},
full_ AS (SELECT p400.* FROM p400 JOIN d USING (r) WHERE i <= len(h) // 2 - 400),
twice AS (SELECT k FROM full_ GROUP BY k HAVING count(*) > 1),
starts AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM full_ JOIN twice USING (k)),
islands AS (SELECT r, i, sum((before IS NULL OR i > before + 400)::INT) OVER (PARTITION BY r ORDER BY i) AS island FROM starts),
spans AS (SELECT r, island, min(i) AS a, max(i) + 400 AS b, coalesce(lag(max(i) + 400) OVER (PARTITION BY r ORDER BY island), 0) AS kept_from FROM islands GROUP BY r, island),
cut AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS ended, string_agg(substring(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) AS head FROM spans JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE head || substring(h, 2 * ended + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
