"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order. A row's fractional rank is its place in
that order over the size of its source; sorting all rows by it interleaves the sources in
proportion, so that every contiguous cut has the mixture of the whole. The law is ``rows``:
shards differ by one row at most.

No window covers a source or the corpus. The order of a source is cut into ``buckets`` ranges of
the shuffle key and the interleaved order into as many ranges of the rank; rows are ranked within
a range, and small tables of range counts give the places before it. A source with a third of
all rows is spread over all its ranges. Text is read for its size and checksum and never moved.

Defined cases: null text has size 8 and checksum 0; a null source is a stratum of its own; null
ids order before others; rows that agree in source, id and text are interchangeable; an empty
table gives an empty result; other columns are ignored. Copies get no common shard: the law is
about counts, and a group with a third of all rows would break it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.session import table


def interleaved_shards(docs: DataFrame, n_shards: int = 24, seed: str = "mix-1", buckets: int = 4096) -> DataFrame:
    """Return doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    digits = next(d for d in range(1, 9) if 16**d >= buckets)
    # Rows without an id go by their text, so that they don't all share one key.
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.sha1(F.coalesce("text", F.lit("")))))))
    rows = docs.select(
        "doc_id",
        F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source")).alias("stratum"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        key.alias("key"),
        F.substring(key, 1, digits).alias("part"),
    )
    before = Window.partitionBy("stratum").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        rows.groupBy("stratum", "part")
        .agg(F.count("*").alias("n"))
        .select(
            "stratum", "part",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"),
            F.sum("n").over(Window.partitionBy("stratum")).alias("stratum_rows"),
        )
    )
    in_part = Window.partitionBy("stratum", "part").orderBy("key", "doc_id", "text_crc32", "size")
    ranked = (
        rows.join(parts, ["stratum", "part"])
        .withColumn("odd", 2 * (F.col("ahead") + F.row_number().over(in_part)) - 1)
        .withColumn("rank", F.col("odd") / (2 * F.col("stratum_rows")))
        .withColumn("range", F.expr(f"(odd * {buckets}L) div (2 * stratum_rows)"))
    )
    # At most `buckets` rows reach this window without a key.
    ranges = ranked.groupBy("range").agg(F.count("*").alias("n")).select(
        "range",
        F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"),
    )
    in_range = Window.partitionBy("range").orderBy("rank", "stratum", "key", "doc_id", "text_crc32", "size")
    return (
        ranked.join(ranges, "range")
        .withColumn("place", F.col("start") + F.row_number().over(in_range) - 1)
        .withColumn("shard", F.expr(f"cast((place * {n_shards}L) div total as int)"))
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
            F.expr(f"place - (shard * total + {n_shards - 1}) div {n_shards}").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            F.expr("if(stratum = '-', null, substring(stratum, 2))").alias("source"),
        )
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved_shards(table(spark, sf_dir, "documents"))


#: The fixed numbers are the reflected polynomial of CRC-32 and its all-ones start; each byte's table entry comes from eight steps.
OP9_SQL = r"""
WITH entry AS (
  SELECT list(list_reduce(list_prepend(b, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1))) ORDER BY b) AS t
  FROM (SELECT unnest(range(256))::UBIGINT AS b)),
given AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS stratum, octet_length(encode(coalesce(text, ''))) + 8 AS size, coalesce(text, '') AS text,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, '-' || sha1(coalesce(text, '')))) AS key
  FROM documents),
summed AS (
  SELECT * EXCLUDE (text, t), xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(string_split(regexp_replace(hex(encode(text)), '(..)', '\1 ', 'g'), ' ')[:-2], lambda x: ('0x' || x)::UBIGINT)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)::BIGINT]))) AS text_crc32
  FROM given, entry),
ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id, text_crc32, size) - 1) / (2 * count(*) OVER (PARTITION BY stratum)) AS rank FROM summed),
placed AS (
  SELECT *, row_number() OVER (ORDER BY rank, stratum, key, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS total FROM ranked),
dealt AS (SELECT *, place * 24 // total AS s FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, s::INTEGER AS shard, (place - (s * total + 23) // 24)::BIGINT AS slot,
  NULL::INTEGER AS grown_shard, source
FROM dealt
"""
