"""Replay of a batch of points: from raw points to series, predictions, anomalies and alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.exprs import feature_factor
from tidewatch.operators import alerts as al
from tidewatch.operators import calendars, detect, features, ingest, routing
from tidewatch.operators.downsample import downsample
from tidewatch.operators.folds import Carry
from tidewatch.operators.zero_rule import zero_rule
from tidewatch.plans.prediction import predict_and_judge
from tidewatch.schemas import FEATURES, POINT
from tidewatch.session import ensure_checkpoint_dir
from tidewatch.settings import DEFAULTS, Settings
from tidewatch.sources.points import empty_calendar

ANOMALY = [
    "metric_name", "timestamp", "granularity", "ingest_seq", "value", "predict_value", "global_abnormal", "local_score", "is_periodic", "z_score", "lower_bound", "upper_bound",
    "severity", "direction", "abnormal_labels", "confidence_score", "confidence_components", "model_name",
]
JUDGED = [*ANOMALY, "predict_lower", "predict_upper", "model_version", "features", "bucket"]


SERIES = ["metric_name", "timestamp", "value", "granularity", "ingest_seq", "mode", "base_value", "factor", "bucket", "isHoliday", "isRCA", "isHotSpot", "hour", "weekday", "registry_line"]
POINT_COLUMNS = [*POINT.names, "ingest_seq"]


@dataclass
class Past:
    """What earlier batches have left of the metrics of this one: routed raw points, judged rows, assessments, and the folds' states."""

    raw: DataFrame
    judged: DataFrame
    assessed: DataFrame
    carry: Carry


@dataclass
class Replay:
    raw: DataFrame
    series: DataFrame
    judged: DataFrame
    alerts: DataFrame
    registry: DataFrame
    assessed: DataFrame


def repaired(points: DataFrame, settings: Settings = DEFAULTS, past: Past | None = None) -> DataFrame:
    """Valid, deduplicated points with small gaps filled and jumps clipped."""
    valid = ingest.deduplicate(ingest.validate(points))
    if past is None:
        return ingest.clip_jumps(ingest.fill_gaps(valid, settings), settings)
    # The last stored point of each metric is where its next gap begins; it isn't a point of this batch.
    newest = Window.partitionBy("metric_name").orderBy(F.desc("timestamp"))
    last = past.raw.select(*POINT_COLUMNS).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n").checkpoint()
    filled = ingest.fill_gaps(valid.select(*POINT_COLUMNS).unionByName(last), settings).join(last.select("metric_name", "timestamp"), ["metric_name", "timestamp"], "left_anti")
    return ingest.clip_jumps(filled, settings, past.carry)


def routed(raw: DataFrame, registry: DataFrame, times: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """raw with the mode and granularity that the metric's priority and latest assessment give each point.

    Points and assessments meet in one pass over each metric in order of time, an assessment before the points of its second.
    """
    known = registry.select("metric_name", "force_ai", "core_link", F.col("priority").alias("registry_priority"), F.col("business_line").alias("registry_line"))
    both = raw.withColumn("_point", F.lit(True)).unionByName(times.select("metric_name", F.col("since").alias("timestamp"), "eligible").withColumn("_point", F.lit(False)), allowMissingColumns=True)
    in_order = Window.partitionBy("metric_name").orderBy("timestamp", "_point")
    latest = both.withColumn("eligible", F.last("eligible", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0))).where("_point").drop("_point")
    named = latest.join(known, "metric_name").withColumn("_own", F.col("priority")).withColumn("priority", F.col("registry_priority"))
    return routing.route(named, settings).withColumn("priority", F.col("_own")).drop("_own", "registry_priority")


def _buckets(on_route: DataFrame, past: Past | None, flush: bool) -> DataFrame:
    """Closed buckets: those before a metric's last one, or all of them with flush."""
    rows = on_route.where("mode <> 'ai'")
    if past is not None:
        ended = past.judged.groupBy("metric_name", F.col("granularity").alias("label")).agg(F.max("bucket").alias("_ended"))
        still = past.raw.where("mode <> 'ai'").join(ended, ["metric_name", "label"], "left").where("_ended is null or timestamp >= _ended + granularity_sec")
        rows = still.select(*rows.columns).unionByName(rows)
    slow = downsample(rows)
    if flush:
        return slow
    last = Window.partitionBy("metric_name", "granularity_sec")
    return slow.withColumn("_last", F.max("bucket").over(last)).where("bucket < _last").drop("_last")


def replay(
    points: DataFrame, registry: DataFrame | None = None, calendar: DataFrame | None = None, rca: DataFrame | None = None, settings: Settings = DEFAULTS, past: Past | None = None, flush: bool = True
) -> Replay:
    """From raw points to alerts. With a past, the points go on from it; without flush, a metric's last bucket stays open."""
    spark = points.sparkSession
    no_days, no_rca = empty_calendar(spark)
    calendar, rca = calendar if calendar is not None else no_days, rca if rca is not None else no_rca
    ensure_checkpoint_dir(spark)
    carry = past.carry if past is not None else None
    of_past = lambda new, *names: new if past is None else past.judged.select(*names).withColumn("_old", F.lit(True)).unionByName(new.withColumn("_old", F.lit(False)), allowMissingColumns=True)
    of_now = lambda df: df if past is None else df.where("not _old").drop("_old")
    # Three plans read the repaired points and two the judged ones; each is written once to the shared folder.
    raw = repaired(points, settings, past).select(*POINT_COLUMNS).checkpoint()
    registry = ingest.register(points, registry).checkpoint()
    unknown = None if past is None else past.raw.join(carry.states.where("kind = 'eligibility'").select("metric_name"), "metric_name", "left_anti")
    assessed = routing.eligibility_times(raw, registry, settings, carry, unknown).checkpoint()
    on_route = routed(raw, registry, assessed if past is None else past.assessed.select(*assessed.columns).unionByName(assessed), settings).checkpoint()
    facts = registry.select("metric_name", "core_link", F.col("business_line").alias("registry_line"))

    # Seconds keep their points; everything else meets in buckets.
    dated = calendars.with_calendar(on_route if past is None else past.raw.select(*on_route.columns).withColumn("_old", F.lit(True)).unionByName(on_route.withColumn("_old", F.lit(False))), calendar, rca, settings.timezone)
    by_second = on_route.where("mode = 'ai'").select("metric_name").distinct()  # the others need no baselines
    seconds = of_now(features.aligned_baseline(dated.join(F.broadcast(by_second), "metric_name", "left_semi"))).where("mode = 'ai'")
    seconds = seconds.withColumns({"factor": feature_factor(F.col("isHoliday"), F.col("isHotSpot"), F.col("isRCA"), F.col("registry_line")), "granularity": F.lit("1s"), "bucket": F.lit(None).cast("long")}).select(*SERIES)
    slow = calendars.with_calendar(_buckets(on_route, past, flush), calendar, rca, settings.timezone).join(facts.drop("core_link"), "metric_name")
    slow = slow.withColumn("mode", F.when(F.col("granularity_sec") >= 600, "zero_rule").otherwise("minute_ai")).withColumns({"base_value": F.col("value"), "factor": F.lit(1.0)}).select(*SERIES).checkpoint()

    modelled = of_now(detect.local_detectors(of_past(seconds.unionByName(slow.where("mode = 'minute_ai'")), "metric_name", "granularity", "timestamp", "value"), settings))
    judged = predict_and_judge(modelled.select(*SERIES, "local_score", "local_labels"), settings, carry)
    judged = of_past(judged.withColumn("flag", F.col("global_abnormal") | (F.col("local_score") > 0)), "metric_name", "granularity", "timestamp", "value", "predict_value", "flag")
    judged = detect.periodic(judged, settings)
    record = F.struct(
        "isHoliday", "isRCA", "isHotSpot", F.col("registry_line").alias("business_unit"), "baseDayDiff", F.col("hour").alias("hour_of_day"), F.col("weekday").alias("day_of_week"),
        "rolling_mean_7d", "rolling_std_7d", "rolling_p70_7d", "rolling_p30_7d",
    )
    version = F.when(F.col("model_name") == "seasonal_adjustment", "sec_v1").otherwise("min_v1")
    modelled = of_now(detect.confidence(detect.graded(judged))).withColumns({"features": record, "model_version": version})
    ruled = of_now(zero_rule(of_past(slow.where("mode = 'zero_rule'"), "metric_name", "granularity", "timestamp", "value"), settings))
    ruled = ruled.withColumns({"predict_lower": F.lit(0.0), "predict_upper": F.col("predict_value"), "features": F.lit(None).cast(FEATURES)})
    whole = modelled.select(*JUDGED).unionByName(ruled.select(*JUDGED)).checkpoint()
    with_facts = whole.join(facts, "metric_name").withColumnRenamed("registry_line", "business_line")
    return Replay(on_route, seconds.unionByName(slow), whole, al.alert_events(with_facts, settings, carry), registry, assessed)
