"""Structured Streaming of single operators: watermarked buckets, incidents, and zero-rule monitoring with idempotent sinks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.functions.exprs import granularity_label
from tidewatch.operators.history import HistoryStore
from tidewatch.operators.zero_rule import zero_rule
from tidewatch.schemas import POINT
from tidewatch.settings import DEFAULTS, Settings
from tidewatch.sources.points import with_defaults
from tidewatch.streaming.engine import ALERTED, LATENESS, Incidents, keyed, schema_of


#: Keys that a metric's buckets are dealt out to.
SHARES = 32
HELD = ["timestamp", "ingest_seq", "value", "business_line", "metric_type", "granularity_sec"]
TOLD = "metric_name string, bucket long, timestamp long, value double, business_line string, metric_type string, bucket_size long, granularity_sec long"


def read_points(spark: SparkSession, path: str, files_per_batch: int = 10) -> DataFrame:
    """A folder of JSON lines as a stream of points, and of commands, with event time."""
    lines = spark.readStream.schema(T.StructType([*POINT.fields, T.StructField("command", T.StringType())])).option("maxFilesPerTrigger", files_per_batch).json(path)
    return with_defaults(lines, "command").withColumn("event_time", F.timestamp_seconds("timestamp"))


def _keep(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Tell the buckets whose end the watermark has passed, and keep the last ingested point of each second of the others."""
    held = [pa.ipc.open_stream(state.get[0]).read_pandas()] if state.exists else []
    points = pd.concat([*held, *([] if state.hasTimedOut else (x[HELD] for x in rows))])
    points = points.sort_values(["timestamp", "ingest_seq"], kind="stable").drop_duplicates("timestamp", keep="last")
    end = (_bucket(points) + points["granularity_sec"]) * 1000
    closed = end <= state.getCurrentWatermarkMs()
    if closed.all():
        state.remove()
    else:
        table = pa.Table.from_pandas(points[~closed], preserve_index=False)
        with pa.ipc.new_stream(sink := pa.BufferOutputStream(), table.schema) as writer:
            writer.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
        state.setTimeoutTimestamp(int(end[~closed].iloc[0]))
    if closed.any():
        yield _told(key[0], points[closed])


def _bucket(points: pd.DataFrame) -> pd.Series:
    return points["timestamp"] - points["timestamp"] % points["granularity_sec"]


def _told(metric: str, points: pd.DataFrame) -> pd.DataFrame:
    """Buckets of one metric's points, which are in order of time."""
    bucket, values = _bucket(points).to_numpy(), points["value"].tolist()
    begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    end = np.r_[begin[1:], len(bucket)]
    first, last = points.iloc[begin], points.iloc[end - 1]
    return pd.DataFrame({
        "metric_name": metric, "bucket": bucket[begin], "timestamp": last["timestamp"].to_numpy(),
        "value": [_value(kind, values[i:j]) for kind, i, j in zip(first["metric_type"], begin.tolist(), end.tolist(), strict=True)],
        "business_line": first["business_line"].to_numpy(), "metric_type": first["metric_type"].to_numpy(),
        "bucket_size": end - begin, "granularity_sec": first["granularity_sec"].to_numpy(),
    })


def _value(kind: str, values: list[float]) -> float:
    """What stands for a bucket's values; sums are those of the exact values, whatever their order."""
    if kind in ("count", "qps"):
        return math.fsum(values)
    if kind in ("rate", "ratio"):
        return math.fsum(values) / len(values)
    if kind != "latency":
        return values[-1]
    values, at = sorted(values), 0.95 * (len(values) - 1)
    low = values[int(at)]
    return low + (at - int(at)) * (values[min(int(at) + 1, len(values) - 1)] - low)


def stream_buckets(points: DataFrame, seconds: int | Column, lateness: str = LATENESS) -> DataFrame:
    """Closed tumbling buckets of a stream; a bucket closes when the watermark passes its end.

    Of a metric's points in one second the last stays, as in a batch: by ``ingest_seq`` where the stream has it, else as they
    come. ``seconds`` may be a column whose widths differ by metric. A metric's buckets are dealt out to SHARES keys; the
    state of one is an Arrow table of its open buckets' points.
    """
    width = F.lit(seconds) if isinstance(seconds, int) else seconds
    seq = F.coalesce("ingest_seq", F.lit(2**63 - 1)) if "ingest_seq" in points.columns else F.lit(0)
    known = points.where("value is not null").withWatermark("event_time", lateness)
    rows = known.select("metric_name", "event_time", "timestamp", "value", "business_line", "metric_type", width.cast("long").alias("granularity_sec"), seq.cast("long").alias("ingest_seq"))
    share = F.pmod(F.floor(F.col("timestamp") / F.col("granularity_sec")), F.lit(SHARES))
    got = rows.withColumn("share", share).groupBy("metric_name", "share").applyInPandasWithState(_keep, TOLD, "points binary", "append", GroupStateTimeout.EventTimeTimeout)
    closed = F.timestamp_seconds(F.col("bucket") + F.col("granularity_sec")).alias("closed")
    return got.select("metric_name", "bucket", "timestamp", "value", "business_line", "metric_type", "bucket_size", granularity_label(F.col("granularity_sec")).alias("granularity"), closed)


def stream_incidents(levelled: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Incidents of a stream of (metric_name, timestamp, event_time, level, core_link). Needs the RocksDB state store."""
    rows = levelled.withWatermark("event_time", LATENESS)
    return keyed(rows, Incidents, f"{schema_of(rows)}, {ALERTED}", settings).where("status is not null").drop("level", "core_link")


class ZeroRuleMonitor:
    """Zero-rule monitoring of a stream of buckets: history is appended per batch, and each batch is judged with the six buckets before it."""

    def __init__(self, store: HistoryStore, settings: Settings = DEFAULTS):
        self.store, self.settings = store, settings

    def on_batch(self, buckets: DataFrame, batch: int) -> None:
        buckets.persist()
        if not buckets.isEmpty():
            self.store.append("series_points", buckets.select("metric_name", "granularity", "timestamp", "value"), batch)
            judged = self.judged(buckets)
            self.store.append("anomalies", judged.select("metric_name", "granularity", "timestamp", "value", "predict_value", "global_abnormal", "z_score", "confidence_score"), batch)
        buckets.unpersist()

    def judged(self, buckets: DataFrame) -> DataFrame:
        """The batch's buckets, judged after the stored ones of the same metrics."""
        keys = buckets.select("metric_name", "granularity").distinct()
        series = self.store.read("series_points").join(keys, ["metric_name", "granularity"], "left_semi")
        return zero_rule(series, self.settings).join(buckets.select("metric_name", "granularity", "timestamp"), ["metric_name", "granularity", "timestamp"], "left_semi")

    def start(self, buckets: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = buckets.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if available_now else writer).start()
