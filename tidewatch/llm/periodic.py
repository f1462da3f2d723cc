"""Runs of periodic words: every maximal stretch that repeats with some period.

A run is a stretch of consecutive words with smallest period q, at least max(``least``, 2 q) words
long, that neither neighbour extends. All runs of a text are found from its longest previous
factors:

1. A run of that length has a string of least / 2 words that stands again q words later, and such
   strings cover it. So the rest of the method looks at *zones*, the stretches that are covered by
   strings standing twice in their text; elsewhere there is nothing to find.
2. Words are ranked, then strings of 2, 4, 8, ... words, each from the ranks of their halves; strings
   that stand once are settled and aren't sorted again. The last ranks are the suffix array. The
   ranks of all widths give the longest common extension of two places, ahead or back, and so the
   common prefixes (LCP) of neighbouring suffixes.
3. One pass over suffixes and LCP with a stack gives the longest previous factor (LPF) of each place
   and where it stands. Hopping from place to place by LPF cuts the zone into Lempel-Ziv blocks.
4. A run that touches a border of blocks has a period of at most the two blocks' length: a longer
   one would show the earlier block, and the word after it, one period before. So at each border
   every such period is tried, by extending the pairs (border, border + q) and (border - q, border)
   both ways; pairs are four a word at most.
5. A run strictly inside a block is a copy of one in the block's earlier place. Runs lie in buckets by
   start, and blocks take theirs over from left to right.

All of it is arrays over an Arrow batch of texts, but for a step of the stack a word of a zone and a
step a block. Nothing is shuffled. A text is read whole by one task; of a text without repeats only
its words are held, of one that is periodic all over some 4 (log2 n + 10) bytes a word.

Defined cases: null, empty and blank texts have no words, no runs, and the empty text collapsed;
texts shorter than ``least`` words have no runs; repeated rows are rows like others; an empty table
gives an empty one; extra columns stay, but for ones called ``runs`` or ``collapsed``, which are replaced.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import small_batches, tidy
from tidewatch.llm.hashing import mix
from tidewatch.session import table

LEAST = 12
#: Pairs of places that are extended at a time.
PAIRS = 1_000_000
RUNS = "runs array<struct<start: bigint, length: bigint, period: bigint>>"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after another, and where each text's begin (one more at the end)."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    flat, offsets = parts.flatten(), np.asarray(parts.offsets)
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))  # blanks at either end leave empty words
    return flat.filter(pa.array(full)), np.r_[0, np.cumsum(full)][offsets - offsets[0]]


class Extensions:
    """Ranks of the strings of 1, 2, 4, ... words of some pieces, the order of their suffixes, and common extensions of places of one piece."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray):
        n = len(ids)
        piece = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.begin, self.end = bounds[piece].astype(np.int32), bounds[piece + 1].astype(np.int32)
        key = piece * (int(ids.max()) + 1) + ids  # strings of different pieces never have one rank
        order = np.argsort(key, kind="stable")
        fresh = np.r_[True, np.diff(key[order]) != 0]
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        self.levels, width = [rank], 1
        open_ = order[~(fresh & np.r_[fresh[1:], True])]
        while len(open_):
            after = open_ + width
            follow = np.where(after < self.end[open_], rank[np.minimum(after, n - 1)] + 1, 0)
            key = rank[open_].astype(np.int64) * (n + 1) + follow
            order = np.argsort(key)
            open_, key = open_[order], key[order]
            old = rank[open_]
            at, fresh = np.arange(len(open_)), np.r_[True, np.diff(key) != 0]
            group = np.maximum.accumulate(np.where(np.r_[True, np.diff(old) != 0], at, 0))
            rank = rank.copy()
            rank[open_] = old + np.maximum.accumulate(np.where(fresh, at, 0)) - group
            self.levels.append(rank)
            open_, width = open_[~(fresh & np.r_[fresh[1:], True])], 2 * width
        self.suffixes = np.empty(n, np.int32)
        self.suffixes[rank] = np.arange(n, dtype=np.int32)

    def ahead(self, i: np.ndarray, j: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many words are the same from i and from j > i on; end: of their piece."""
        far, last = np.zeros(len(i), np.int64), len(self.suffixes) - 1
        for level in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[level]
            same = (j + far < end) & (rank[np.minimum(i + far, last)] == rank[np.minimum(j + far, last)])
            far += same.astype(np.int64) << level
        return far

    def back(self, i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """How many words are the same before i and before j > i; begin: of their piece."""
        far = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            rank, to = self.levels[level], far + (1 << level)
            same = (i - to >= begin) & (rank[np.maximum(i - to, 0)] == rank[np.maximum(j - to, 0)])
            far += same.astype(np.int64) << level
        return far

    def previous_factors(self) -> tuple[np.ndarray, np.ndarray]:
        """(length, place) of the longest string from each place on that also starts earlier in its piece."""
        sa, n = self.suffixes, len(self.suffixes)
        a, b = np.minimum(sa[:-1], sa[1:]).astype(np.int64), np.maximum(sa[:-1], sa[1:]).astype(np.int64)
        lcp = np.zeros(n + 1, np.int32)
        one = self.begin[a] == self.begin[b]
        lcp[1:n][one] = self.ahead(a[one], b[one], self.end[a[one]])
        length, place = np.zeros(n, np.int32), np.full(n, -1, np.int32)
        suffix, common, out, of = (memoryview(x) for x in (np.r_[sa, np.int32(-1)], lcp, length, place))
        tops, lens = [suffix[0]], [0]
        for k in range(1, n + 1):
            now, low = suffix[k], common[k]
            while tops and tops[-1] > now:
                p, own = tops.pop(), lens.pop()
                if own > low:  # what is below in the stack has more in common than what comes
                    out[p], of[p] = own, tops[-1]
                else:
                    out[p], of[p], low = low, now, own if own < low else low
            tops.append(now)
            lens.append(low)
        return length, place


def _borders(ext: Extensions, cuts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, period) of all runs that touch a border of blocks; cuts: where blocks begin, and the end of all."""
    size = np.diff(cuts)
    first = np.r_[ext.begin[cuts[:-1]] == cuts[:-1]]
    # A border is where a block ends: the next block of the same piece, if there is one, adds to the periods.
    here = cuts[1:]
    most = size + np.where(np.r_[first[1:], True], 0, np.r_[size[1:], 0])
    begin, end = ext.begin[cuts[:-1]].astype(np.int64), ext.end[cuts[:-1]].astype(np.int64)
    total, two = np.r_[0, np.cumsum(most)], ext.levels[min(1, len(ext.levels) - 1)]
    found, n = [], len(two)
    for at in range(0, int(total[-1]), PAIRS):
        flat = np.arange(at, min(at + PAIRS, int(total[-1])))
        k = np.searchsorted(total, flat, side="right") - 1
        q, b = flat - total[k] + 1, here[k].astype(np.int64)
        for i, j in ((b, b + q), (b - q, b)):
            ok = (i >= begin[k]) & (j <= end[k])
            i, j, kk, period = i[ok], j[ok], k[ok], q[ok]
            # Six words that agree have two before the place or two after it: their ranks say so at once.
            two_before = (i - 2 >= begin[kk]) & (two[np.maximum(i - 2, 0)] == two[np.maximum(j - 2, 0)])
            two_after = (j < end[kk]) & (two[np.minimum(i, n - 1)] == two[np.minimum(j, n - 1)])
            ok = two_before | two_after
            i, j, kk, period = i[ok], j[ok], kk[ok], period[ok]
            left, right = ext.back(i, j, begin[kk]), ext.ahead(i, j, end[kk])
            ok = (left + right >= period) & (left + right + period >= least)
            found.append((i[ok] - left[ok], j[ok] + right[ok], period[ok]))
    s, e, q = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    once = np.r_[True, (np.diff(s) != 0) | (np.diff(e) != 0)][: len(s)]  # of one stretch the smallest period
    return s[once], e[once], q[once]


def runs_of(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (begin, end, period) of all runs of pieces of word numbers, by begin, then period."""
    if not len(ids):
        return np.zeros((0, 3), np.int64)
    ext = Extensions(ids, bounds)
    length, place = ext.previous_factors()
    cuts, hop, at = [], memoryview(length), 0
    while at < len(ids):
        cuts.append(at)
        at += hop[at] or 1
    cuts = np.array([*cuts, len(ids)])
    s, e, q = _borders(ext, cuts, least)
    buckets: dict[int, list[tuple[int, int]]] = {}
    for begin, end, period in zip(s.tolist(), e.tolist(), q.tolist(), strict=True):
        buckets.setdefault(begin, []).append((end, period))
    starts = sorted(buckets)
    wide = np.flatnonzero(np.diff(cuts) >= least + 2)
    for block, size in zip(cuts[wide].tolist(), np.diff(cuts)[wide].tolist(), strict=True):
        source = int(place[block])
        k = bisect.bisect_right(starts, source)
        while k < len(starts) and starts[k] + least < source + size:
            for end, period in tuple(buckets[starts[k]]):
                if end < source + size:
                    to = starts[k] + block - source
                    if to not in buckets:
                        bisect.insort(starts, to)
                    buckets.setdefault(to, []).append((end + block - source, period))
            k += 1
    rows = np.array([(b, *r) for b in starts for r in buckets[b]], np.int64).reshape(-1, 3)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def zones(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(places, where zones begin among them) of words that strings of least / 2 words standing twice in a text cover."""
    n, width = len(ids), least // 2
    if n < least:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    with np.errstate(over="ignore"):
        word, step = mix(ids.astype(np.uint64) + np.uint64(1)), np.uint64(0x9E3779B97F4A7C15)
        total = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            total = total * step + word[k : n - width + 1 + k]
        total = mix(total ^ mix(text[: len(total)].astype(np.uint64) * step + np.uint64(7)))
    whole = np.flatnonzero(text[: len(total)] == text[width - 1 :])
    order = whole[np.argsort(total[whole])]
    same = total[order][1:] == total[order][:-1]
    twice = order[np.r_[same, False] | np.r_[False, same]]
    change = np.zeros(n + 1, np.int32)
    change[twice] += 1
    change[twice + width] -= 1
    places = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    if not len(places):
        return places, np.zeros(1, np.int64)
    new = np.r_[True, (np.diff(places) > 1) | (np.diff(text[places]) > 0)]
    cut = np.r_[np.flatnonzero(new), len(places)]
    long = np.diff(cut) >= least
    return places[np.repeat(long, np.diff(cut))], np.r_[0, np.cumsum(np.diff(cut)[long])]


def text_runs(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (begin, end, period) of all runs of texts of word numbers."""
    places, cut = zones(ids, bounds, least)
    found = runs_of(ids[places], cut, least)
    return np.c_[places[found[:, 0]], places[found[:, 0]] + found[:, 1] - found[:, 0], found[:, 2]] if len(found) else found


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with ``runs``, by start, then period, and ``collapsed``: the words without those that a run holds after its first period, joined by blanks."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in ("runs", "collapsed")]
    schema = T.StructType([*kept, *T.StructType.fromDDL(RUNS).fields, T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words, bounds = words_of(batch.column(text))
            ids = np.asarray(words.dictionary_encode().indices, np.int64)
            found = text_runs(ids, bounds, least)
            drop = np.zeros(len(ids) + 1, np.int32)
            np.add.at(drop, found[:, 0] + found[:, 2], 1)
            np.add.at(drop, found[:, 1], -1)
            stays = np.cumsum(drop[:-1]) == 0
            offsets = np.r_[0, np.cumsum(stays)][bounds]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.filter(pa.array(stays))), pa.scalar(" ", pa.large_string()))
            of = np.searchsorted(bounds, found[:, 0], side="right") - 1
            parts = [found[:, 0] - bounds[of], found[:, 1] - found[:, 0], found[:, 2]]
            rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in parts], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)), pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), runs, joined.cast(pa.string())], names=schema.names)

    return docs.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(tidy(run), schema)


def with_periods(docs: DataFrame) -> DataFrame:
    """docs whose texts, where crc32 of the id ends in 0, go on periodically from some word, as op13's contract says; a null id goes by the empty text."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    df = docs.withColumns({"__tw_w": F.when(h % 10 == 0, words), "__tw_g": F.floor(h / 10)})
    n = F.size("__tw_w")
    df = df.withColumn("__tw_a", F.when(n > 0, F.col("__tw_g") % n))
    df = df.withColumn("__tw_p", 1 + F.floor((n - F.col("__tw_a")) / (3 + F.col("__tw_g") % 8)))
    source = lambda i: F.when(i < F.col("__tw_a"), i).otherwise(F.col("__tw_a") + (i - F.col("__tw_a")) % F.col("__tw_p")).cast("int")
    again = F.array_join(F.transform("__tw_w", lambda w, i: F.get("__tw_w", source(i))), " ")
    return df.withColumn("text", F.when(n > 0, again).otherwise(F.col("text"))).drop("__tw_w", "__tw_g", "__tw_a", "__tw_p")


def digests(docs: DataFrame) -> DataFrame:
    """op13's columns of docs with runs and collapsed."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return docs.withColumn("__tw_best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("__tw_best.start")).alias("start"), F.col("__tw_best.length").alias("length"), (-F.col("__tw_best.period")).alias("period"),
        F.expr("(1000 * __tw_best.length) div -__tw_best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(with_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))))


#: A brute-force form: words that agree at a distance, in stretches of at least six.
OP13_SQL = r"""
WITH given AS (
  SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ascii(x)::UBIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))) AS h
  FROM documents),
cut AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM given),
damaged AS (
  SELECT doc_id, d, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i:
    w[1 + (CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END)::BIGINT]) END AS w FROM cut),
word AS (SELECT d, n, unnest(w) AS w, unnest(range(n)) AS i FROM damaged),
gram AS (
  SELECT d, i, md5(w || ' ' || lead(w, 1) OVER s || ' ' || lead(w, 2) OVER s || ' ' || lead(w, 3) OVER s || ' ' || lead(w, 4) OVER s || ' ' || lead(w, 5) OVER s) AS k, n
  FROM word WINDOW s AS (PARTITION BY d ORDER BY i)),
pair AS (SELECT x.d, x.i, y.i - x.i AS q FROM gram x JOIN gram y ON x.d = y.d AND x.k = y.k AND x.i < y.i WHERE x.i + 6 <= x.n AND y.i + 6 <= y.n),
island AS (SELECT d, q, min(i) AS s, max(i) + 6 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY d, q ORDER BY i) AS k FROM pair) GROUP BY d, q, k),
run AS (SELECT d, s, e, min(q) AS q FROM island WHERE e - s >= greatest(12, 2 * q) GROUP BY d, s, e),
told AS (
  SELECT d, count(*) AS n_runs, max(struct_pack(l := e - s, s := -s, q := -q)) AS best, sha256(string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256
  FROM run GROUP BY d),
gone AS (SELECT DISTINCT d, unnest(range(s + q, e)) AS i FROM run),
kept AS (SELECT w.d, string_agg(w.w, ' ' ORDER BY w.i) AS t FROM word w ANTI JOIN gone USING (d, i) GROUP BY w.d)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, (-best.s)::BIGINT AS "start", best.l::BIGINT AS length, (-best.q)::BIGINT AS period, ((1000 * best.l) // -best.q)::BIGINT AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM damaged LEFT JOIN told USING (d) LEFT JOIN kept USING (d)
"""
