"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are hashed, every run of GRAM words gets a hash, and such a gram is a fingerprint if its hash
is the least of some window of SPAN - GRAM + 1 neighbouring grams. Any SPAN words that a document
and an item share hold the same fingerprint at the same offset in both, so joining fingerprints
finds every shared span. Each joined pair of places is extended word by word to both sides, as far
as a span that holds the gram can reach, and kept if at least SPAN words in a row agree; the
union of the kept runs are the hit words. Items of fewer than SPAN words are one window: every
place of a document is a fingerprint for grams of such a length, if the benchmark has any.

A document's fingerprints carry the words around them, so candidates are settled where they are
found: one pass over the texts, in which fingerprints meet the benchmark's. Those are broadcast
only while they are no more than ``broadcast_rows``, which is counted first; beyond that the join
shuffles. Only matches and one row per document are shuffled after it.

Defined cases: null and empty texts have no words; an item without words is never hit; repeated
document rows get a row each, with the same figures; repeated item ids count once; null item ids
are left out; doc_ids may be null; extra columns don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import ascii_lower
from tidewatch.session import table

SPAN, GRAM = 10, 5
REACH = SPAN - GRAM
#: What separates words: everything of ASCII but digits and small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_hashes(text: Column) -> Column:
    words = F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _upto(n: Column) -> Column:
    """0 to n - 1, or nothing."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _gram(i: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *(F.get("h", i + k) for k in range(n)))


def _around(i: Column) -> Column:
    """The hashed words from REACH before place i to SPAN - 1 after it; null beyond the ends."""
    return F.array(*(F.get("h", i + k) for k in range(-REACH, SPAN)))


def fingerprints(texts: DataFrame, short: list[int]) -> DataFrame:
    """texts: (keys, h) to (keys, n_words, place, size, print, around). Each row of texts also gives a row without a place."""
    keys = [c for c in texts.columns if c != "h"]
    grams = texts.withColumn("n_words", F.size("h")).withColumn("g", F.transform(_upto(F.col("n_words") - (GRAM - 1)), lambda i: _gram(i, GRAM)))
    least = grams.withColumn("m", F.transform(_upto(F.col("n_words") - (SPAN - 1)), lambda i: F.least(*(F.get("g", i + k) for k in range(REACH + 1)))))
    chosen = F.filter(_upto(F.col("n_words") - (GRAM - 1)), lambda j: F.get("g", j) == F.greatest(*(F.get("m", j - k) for k in range(REACH + 1))))
    of = lambda j, n, p: F.struct(j.alias("place"), F.lit(n).alias("size"), p.alias("print"), _around(j).alias("around"))
    found = [F.transform(chosen, lambda j: of(j, SPAN, F.get("g", j)))]
    every = lambda n: F.transform(_upto(F.col("n_words") - (n - 1)), lambda j: of(j, n, _gram(j, n)))
    found += [every(n) for n in short]
    none = F.array(of(F.lit(None).cast("int"), SPAN, F.lit(None).cast("long")))
    return least.select(*keys, "n_words", F.inline(F.concat(none, *found)))


def _run(same: Column, places: range) -> Column:
    """How many of the places, in their order, agree before the first that doesn't."""
    out = F.lit(len(places))
    for n, k in reversed(list(enumerate(places))):
        out = F.when(~F.get(same, F.lit(k)), n).otherwise(out)
    return out


def hits(documents: DataFrame, benchmark: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """row, doc_id, n_words, item_id, begin, end of every matched run, and for each row of documents one row without a match."""
    items = benchmark.where("item_id is not null").select("item_id", word_hashes(F.col("text")).alias("h"))
    lengths = items.select(F.size("h").alias("n")).where(F.col("n").between(1, SPAN - 1)).distinct()
    short = sorted(r["n"] for r in lengths.collect())  # SPAN - 1 numbers at most
    of_items = fingerprints(items, short).where((F.col("size") == F.when(F.col("n_words") < SPAN, F.col("n_words")).otherwise(SPAN)) & F.col("place").isNotNull())
    of_items = of_items.select("item_id", "size", "print", F.col("around").alias("item_around")).distinct()
    if of_items.count() <= broadcast_rows:
        of_items = F.broadcast(of_items)
    texts = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", word_hashes(F.col("text")).alias("h"))
    met = fingerprints(texts, short).join(of_items, ["size", "print"], "left").where("item_id is not null or place is null")
    same = F.zip_with("around", "item_around", lambda a, b: F.coalesce(a == b, F.lit(False)))
    left, right = _run(F.col("same"), range(REACH - 1, -1, -1)), _run(F.col("same"), range(REACH + GRAM, REACH + SPAN))
    agree = reduce(lambda x, k: x & ((F.col("size") <= k) | F.get("same", F.lit(REACH + k))), range(SPAN), F.lit(True))
    gram_agrees = reduce(lambda x, k: x & F.get("same", F.lit(REACH + k)), range(GRAM), F.lit(True))
    short_one = F.col("size") < SPAN
    ends = met.withColumn("same", same).select(
        "row", "doc_id", "n_words", "item_id", "place",
        F.when(short_one, F.col("place")).otherwise(F.col("place") - left).alias("begin"),
        F.when(short_one, F.col("place") + F.col("size")).otherwise(F.col("place") + GRAM + right).alias("end"),
        F.when(short_one, agree).otherwise(gram_agrees & (left + GRAM + right >= SPAN)).alias("kept"),
    )
    return ends.where("place is null or kept").select("row", "doc_id", "n_words", "item_id", "begin", "end")


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids and contaminated for each row of documents."""
    key = ["row", "doc_id", "n_words"]
    words = hits(documents, benchmark).withColumn("word", F.explode_outer(F.when(F.col("item_id").isNotNull(), F.sequence(F.col("begin"), F.col("end") - 1))))
    by_word = words.repartition("row").groupBy(*key, "word").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    return (
        by_word.groupBy(*key)
        .agg(F.count("word").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
        .select("doc_id", F.col("n_words").cast("long"), "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.col("n_hit") > 0).alias("contaminated"))
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of documents without a hit word. Rows are told apart by id and text, so ids may be null or repeat."""
    keyed = documents.withColumn("__tw_key", F.xxhash64("doc_id", "text"))
    hit = hits(keyed.select(F.col("__tw_key").alias("doc_id"), "text"), benchmark).where("item_id is not null").select(F.col("doc_id").alias("__tw_key")).distinct()
    return keyed.join(hit, "__tw_key", "left_anti").select(*documents.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP2_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id AS id, 0 AS item, text FROM documents
  UNION ALL SELECT row_number() OVER (), item_id, 1, text FROM benchmark WHERE item_id IS NOT NULL),
w AS (
  SELECT r, id, item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM split),
sizes AS (SELECT DISTINCT least(len(w), 10) AS n FROM w WHERE item = 1 AND len(w) > 0),
iw AS (
  SELECT DISTINCT id AS item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE item = 1 AND len(w) > 0),
dw AS (
  SELECT r, n, i, list_slice(w, i, i + n - 1) AS win
  FROM w JOIN sizes ON len(w) >= n, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE item = 0),
hit AS (SELECT r, item_id, i, n FROM dw JOIN iw USING (n, win)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS u(p) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit) GROUP BY r)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (r) LEFT JOIN items USING (r) WHERE item = 0
"""
