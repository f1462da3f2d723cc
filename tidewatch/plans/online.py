"""Monitoring that goes on from what is stored: batch after batch, or as a stream of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators import ingest
from tidewatch.operators.folds import STATE, Carry
from tidewatch.operators.history import KEYS, HistoryStore
from tidewatch.plans.replay import Past, Replay, replay
from tidewatch.schemas import ANOMALY, POINT, PREDICTION, REGISTRY
from tidewatch.session import ensure_checkpoint_dir
from tidewatch.settings import DEFAULTS, Settings


KEY = "metric_name string, granularity string, timestamp long"
#: Columns of stored raw points.
_TEXT, _LONG, _FLAG = T.StringType(), T.LongType(), T.BooleanType()
_ADDED = {"ingest_seq": _LONG, "force_ai": _FLAG, "core_link": _FLAG, "registry_line": _TEXT, "eligible": _FLAG, "mode": _TEXT, "granularity_sec": T.IntegerType(), "label": _TEXT}
ROUTED = T.StructType([*POINT.fields, *(T.StructField(n, t) for n, t in _ADDED.items())])


class Monitor:
    """Points in, alerts out; raw and series points, predictions, anomalies, registry, assessments and states go to the store.

    Each batch reads what the store has of its metrics: raw points of the retained time, the last judged
    rows of each series, and the states that the ordered folds left (clipping, assessments, corrections
    and learned bounds, incidents). So batches give what one replay of all their points gives, whether
    they come from one process or from several, one after the other. A batch that is run again under
    its number replaces what it wrote.
    """

    def __init__(self, store: HistoryStore, registry: DataFrame | None = None, calendar: DataFrame | None = None, rca: DataFrame | None = None, settings: Settings = DEFAULTS, cleanup_every: int = 100):
        self.store, self.registry, self.calendar, self.rca, self.settings, self.cleanup_every = store, registry, calendar, rca, settings, cleanup_every
        ensure_checkpoint_dir(store.spark)

    def _before(self, name: str, names: DataFrame, batch: int, none: str) -> DataFrame:
        """The latest rows of earlier batches for some metrics; none: the columns of a table that isn't there."""
        if not self.store.has(name):
            return self.store.spark.createDataFrame([], none)
        return self.store.read(name, before=batch, metrics=names).drop("batch", "date")

    def _past(self, points: DataFrame, batch: int, flush: bool) -> Past:
        names = points.select("metric_name")
        if flush and self.store.has("states"):  # metrics without a point in this batch have open buckets, too
            names = names.union(self.store.read("states", before=batch).select("metric_name"))
        names = names.distinct().checkpoint()
        series = self._before("series_points", names, batch, f"{KEY}, value double, mode string, bucket long").select("metric_name", "granularity", "timestamp", "value", "bucket")
        last = Window.partitionBy("metric_name", "granularity").orderBy(F.desc("timestamp"))
        tail = series.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= self.settings.anomaly_window).drop("_n")
        key = list(KEYS["predictions"])
        judged = (
            tail.join(self._before("predictions", names, batch, f"{KEY}, predict_value double").select(*key, "predict_value"), key, "left")
            .join(self._before("anomalies", names, batch, f"{KEY}, global_abnormal boolean, local_score double").select(*key, (F.col("global_abnormal") | (F.col("local_score") > 0)).alias("flag")), key, "left")
        )
        raw = self._before("raw_points", names, batch, ROUTED)
        return Past(raw.checkpoint(), judged.checkpoint(), self._before("assessments", names, batch, "metric_name string, since long, eligible boolean"), Carry(self._before("states", names, batch, STATE)))

    def process(self, points: DataFrame, batch: int, flush: bool = False) -> DataFrame:
        """Alerts of a batch of points (POINT and ingest_seq). With flush the open buckets of all metrics close, not only of those in the batch."""
        if batch and batch % self.cleanup_every == 0:
            self.clean_up(batch - 1)  # of what is whole, so that this batch may run again
        past = self._past(points, batch, flush)
        registry = self.store.read("registry", before=batch).drop("batch") if self.store.has("registry") else None
        if self.registry is not None:  # what is given counts before what is stored
            registry = self.registry if registry is None else ingest.upsert_registry(registry, self.registry)
        found = replay(points, registry, self.calendar, self.rca, self.settings, past, flush)
        alerts = found.alerts.checkpoint()
        self._write(found, past.carry, batch)
        return alerts

    def _write(self, found: Replay, carry: Carry, batch: int) -> None:
        rows = found.judged
        put = lambda name, df: self.store.append(name, df, batch)
        put("raw_points", found.raw)
        put("series_points", found.series.select("metric_name", "granularity", "timestamp", "value", "mode", "bucket"))
        put("predictions", rows.select("metric_name", "timestamp", "granularity", F.col("value").alias("actual_value"), "predict_value", F.col("predict_lower").alias("lower_bound"), F.col("predict_upper").alias("upper_bound"), "model_name", "model_version", "features").select(*PREDICTION.names))
        put("anomalies", rows.select(*ANOMALY.names))
        put("registry", found.registry.select(*REGISTRY.names))
        put("assessments", found.assessed)
        states = None
        for df in carry.left.values():
            states = df if states is None else states.unionByName(df)
        put("states", states)

    def clean_up(self, batch: int, now: int | None = None) -> None:
        """Forget the states of idle metrics and drop points beyond the retained time."""
        now = self.store.newest("raw_points") if now is None else now
        self.store.forget_idle(now, self.settings.state_ttl_sec, batch)
        if self.settings.data_retention_sec > 0:
            self.store.retain(now - self.settings.data_retention_sec, batch)

    def start(self, points: DataFrame, checkpoint: str, tell, available_now: bool = True) -> StreamingQuery:
        """A stream of points as micro-batches; tell(alerts, batch) gets each one's alerts."""
        run = lambda df, n: tell(self.process(df.drop("event_time").withColumn("ingest_seq", F.monotonically_increasing_id()), n), n)
        writer = points.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
