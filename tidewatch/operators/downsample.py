"""Tumbling buckets of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import floor_timestamp, granularity_label


def downsample(points: DataFrame, seconds: str = "granularity_sec") -> DataFrame:
    """One row per metric, granularity and bucket.

    Counters are summed, rates averaged, latencies cut at P95, others take the last value. A bucket
    has its first point's attributes and its last point's time. A batch is complete, so its last
    buckets are closed.
    """
    at = F.struct("timestamp", "ingest_seq")
    first = F.min_by(F.struct("business_line", "tags", "priority", "metric_type", "trusted", "is_interpolated"), at)
    rows = points.withColumn("bucket", floor_timestamp(F.col("timestamp"), F.col(seconds)))
    got = rows.groupBy("metric_name", F.col(seconds).alias("granularity_sec"), "bucket").agg(
        first.alias("first"), F.max("timestamp").alias("timestamp"), F.count("*").alias("bucket_size"), F.sum("value").alias("total"), F.avg("value").alias("mean"),
        F.percentile("value", F.lit(0.95)).alias("p95"), F.max_by("value", at).alias("last"), F.max("ingest_seq").alias("ingest_seq"),
    )
    kind = F.col("first.metric_type")
    value = F.when(kind.isin("count", "qps"), F.col("total")).when(kind.isin("rate", "ratio"), F.col("mean")).when(kind == "latency", F.col("p95")).otherwise(F.col("last"))
    old = F.map_filter("first.tags", lambda k, _: ~k.isin("bucket_size", "downsampled"))
    return got.select(
        "metric_name", "timestamp", value.alias("value"), "first.business_line",
        F.map_concat(old, F.create_map(F.lit("bucket_size"), F.col("bucket_size").cast("string"), F.lit("downsampled"), F.lit("true"))).alias("tags"),
        "first.priority", "first.metric_type", granularity_label(F.col("granularity_sec")).alias("granularity"), "first.trusted", "first.is_interpolated", "ingest_seq", "bucket", "bucket_size", "granularity_sec",
    )
