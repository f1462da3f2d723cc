"""Sources of metric points, registries and calendars."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schemas import CALENDAR, POINT, RCA, REGISTRY
from tidewatch.session import table

#: How the event types of the test tables stand for metrics: type, priority, core, forced, business line.
EVENT_METRICS = {
    "error": ("rate", "P0", True, True, "AA"),
    "purchase": ("count", "P0", True, False, "AA"),
    "click": ("ratio", "P1", True, False, "BB"),
    "view": ("latency", "P2", False, False, "CC"),
    "signup": ("gauge", "P3", False, False, "BB"),
}
DEMO_START, DEMO_SECONDS = 1711180800, 1800
#: Rows of a micro-batch of a table that is streamed; keyed operators hold a metric's rows of one in Python.
BATCH_ROWS = 500_000
#: Files of such a micro-batch, and the rows that one holds at least.
BATCH_FILES, FILE_ROWS = 8, 50_000


def with_defaults(points: DataFrame, *more: str) -> DataFrame:
    return points.select(
        "metric_name", "timestamp", "value", "business_line",
        F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"),
        F.coalesce("priority", F.lit("P1")).alias("priority"), F.coalesce("metric_type", F.lit("gauge")).alias("metric_type"),
        F.coalesce("granularity", F.lit("1s")).alias("granularity"), F.coalesce("trusted", F.lit(True)).alias("trusted"),
        F.coalesce("is_interpolated", F.lit(False)).alias("is_interpolated"), *more,
    )


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Points of JSON lines; blank lines are skipped, a malformed one fails the read. ingest_seq is the order of reading."""
    read = spark.read.schema(POINT).option("mode", "FAILFAST").json(path)
    return with_defaults(read).withColumn("ingest_seq", F.monotonically_increasing_id())


def read_jsonl_lenient(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points, rejected lines)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("p", F.from_json("value", POINT, {"mode": "PERMISSIVE"}))
    whole = F.col("p").isNotNull() & F.col("p.metric_name").isNotNull() & F.col("p.timestamp").isNotNull() & F.col("p.value").isNotNull()
    good = with_defaults(parsed.where(whole).select("p.*"))
    return good.withColumn("ingest_seq", F.monotonically_increasing_id()), parsed.where(~whole).select("value")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return registry_defaults(spark.read.schema(REGISTRY).option("multiLine", True).json(path))


def registry_defaults(df: DataFrame) -> DataFrame:
    return df.select(
        "metric_name", F.coalesce("business_line", F.lit("default")).alias("business_line"), F.coalesce("priority", F.lit("P1")).alias("priority"),
        F.coalesce("metric_type", F.lit("gauge")).alias("metric_type"), F.coalesce("core_link", F.lit(True)).alias("core_link"),
        F.coalesce("force_ai", F.lit(False)).alias("force_ai"), F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"),
    )


def empty_calendar(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], CALENDAR), spark.createDataFrame([], RCA)


def demo_points(spark: SparkSession, seconds: int = DEMO_SECONDS, start: int = DEMO_START) -> DataFrame:
    """Two deterministic metrics: a success rate with a dip, and a count that falls to zero."""
    i = F.col("id").cast("double")
    rate = 0.962 + 0.008 * F.sin(i / 45) + 0.002 * F.sin(i / 7) - F.when(F.col("id").between(720, 779), 0.14).otherwise(0.0)
    count = F.when(F.col("id") >= 1200, 0.0).otherwise(40 + 4 * F.sin(i / 30))

    def of(name: str, value, line: str, priority: str, kind: str, tags: dict[str, str]):
        tag = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
        return F.struct(F.lit(name).alias("metric_name"), F.greatest(value, F.lit(0.0)).alias("value"), F.lit(line).alias("business_line"), F.lit(priority).alias("priority"), F.lit(kind).alias("metric_type"), tag.alias("tags"))

    both = F.array(
        of("payment.success_rate", rate, "AA", "P0", "rate", {"force_ai": "true", "channel": "alipay"}),
        of("payment.long_tail_count", count, "AA", "P2", "count", {"channel": "legacy"}),
    )
    rows = spark.range(seconds).select("id", F.posexplode(both).alias("n", "p"))
    return rows.select(
        "p.metric_name", (F.col("id") + start).alias("timestamp"), "p.value", "p.business_line", "p.tags", "p.priority", "p.metric_type",
        F.lit("1s").alias("granularity"), F.lit(True).alias("trusted"), F.lit(False).alias("is_interpolated"), (F.col("id") * 2 + F.col("n")).alias("ingest_seq"),
    )


def demo_registry(spark: SparkSession) -> DataFrame:
    rows = [("payment.success_rate", "AA", "P0", "rate", True, True, {"channel": "alipay"}), ("payment.long_tail_count", "AA", "P2", "count", False, False, {"channel": "legacy"})]
    return spark.createDataFrame(rows, REGISTRY)


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of events as metric points, one metric for each type."""
    return as_points(table(spark, sf_dir, "events"))


def paced_stream(points: DataFrame, folder: str, rows: int = BATCH_ROWS) -> DataFrame:
    """A table of points, and of commands, as a stream with event time: some ``rows`` of them a micro-batch, in order of time.

    Rows of one second stay together. The folder's name is that of no earlier stream. It gets a few files for each
    micro-batch, as many for every one, for a stream takes so many files at a time, and takes them by their times.
    """
    spark = points.sparkSession
    total, files = points.count(), max(1, min(BATCH_FILES, rows // FILE_ROWS))
    n = max(1, math.ceil(total / rows))
    ranges = points.repartitionByRange(n * files, "timestamp").withColumn("range", F.spark_partition_id())
    ranges.write.partitionBy("range").parquet(f"{folder}/ranges")
    held = spark.read.schema(ranges.schema).parquet(f"{folder}/ranges")
    pieces, before = {}, 0  # ranges of each micro-batch, whatever their number and sizes
    for number, size in sorted(map(tuple, held.groupBy("range").count().collect())) or [(0, 0)]:
        pieces.setdefault(int((before + size / 2) * n / max(total, 1)), []).append((number, size))
        before += size
    for name, span in pieces.items():  # one after another
        piece = held.where(F.col("range").between(span[0][0], span[-1][0])).drop("range")
        enough = sum(size for _, size in span) >= FILE_ROWS
        for part in [piece.repartition(files)] if enough else [piece.coalesce(1), *[piece.limit(0).coalesce(1)] * (files - 1)]:
            part.write.mode("append").parquet(f"{folder}/files/{name}")
    at = F.col("modificationTime")
    written = spark.read.format("binaryFile").load(f"{folder}/files/*").groupBy(F.regexp_extract("path", r"/(\d+)/[^/]*$", 1).cast("int").alias("piece"))
    times = written.agg(F.count("*"), F.min(at), F.max(at)).orderBy("piece").collect()
    if any(t[1] != files for t in times) or any(later[2] <= earlier[3] for earlier, later in itertools.pairwise(times)):
        raise ValueError(f"times or numbers of files in {folder} don't tell their order")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/files/*")
    return stream.withColumn("event_time", F.timestamp_seconds("timestamp"))


def as_points(events: DataFrame) -> DataFrame:
    pick = lambda n: F.create_map(*[F.lit(x) for k, v in EVENT_METRICS.items() for x in (k, v[n])])[F.col("event_type")]
    return events.where(F.col("event_type").isin(*EVENT_METRICS)).select(
        F.concat(F.lit("events."), "event_type").alias("metric_name"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("timestamp"), "value", pick(4).alias("business_line"),
        F.create_map(F.lit("core_link"), pick(2).cast("string"), F.lit("force_ai"), pick(3).cast("string")).alias("tags"),
        pick(1).alias("priority"), pick(0).alias("metric_type"), F.lit("1s").alias("granularity"), F.lit(True).alias("trusted"),
        F.lit(False).alias("is_interpolated"), F.col("event_id").alias("ingest_seq"),
    )
