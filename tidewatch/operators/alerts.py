"""Alerts: levels, the incident of each metric, suppression, escalation and recovery."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import alert_level, alert_message, alert_type, fixed, humanize_duration
from tidewatch.operators.folds import Carry, fold_by_key
from tidewatch.settings import DEFAULTS, LEVELS, Settings


@dataclass
class Incident:
    opened: int | None = None
    level: str = "P3"
    normal: int = 0
    emitted: int | None = None


def advance(i: Incident, now: int, level: str | None, core: bool, settings: Settings = DEFAULTS) -> tuple[str, str, int] | None:
    """The next state of an incident; (status, level, duration) if there is something to tell."""
    if level is None:
        if i.opened is None:
            return None
        i.normal += 1
        if i.normal < settings.recovery_normal_points:
            return None
        told = ("recovered", i.level, max(now - i.opened, 0))
        i.opened, i.level, i.normal, i.emitted = None, "P3", 0, None
        return told
    i.normal, status = 0, "firing"
    if i.opened is None:
        i.opened, i.level = now, level
    elif LEVELS.index(level) < LEVELS.index(i.level):
        i.level, status = level, "escalated"
    elif i.level == "P1" and core and now - i.opened >= settings.alert_upgrade_window_sec:
        i.level, status = "P0", "escalated"
    if status == "firing" and i.emitted is not None and now - i.emitted < settings.alert_merge_window_sec:
        return None
    i.emitted = now
    return status, i.level, max(now - i.opened, 0)


def with_level(judged: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return judged.withColumn("level", alert_level(F.col("global_abnormal"), F.col("local_score"), F.col("abnormal_labels"), F.col("confidence_score"), F.col("core_link"), settings))


def incidents(levelled: DataFrame, settings: Settings = DEFAULTS, carry: Carry | None = None) -> DataFrame:
    """Rows at which an incident tells something, with status, alert_level and duration_sec."""
    step = lambda i, row: advance(i, int(row.timestamp), row.level, bool(row.core_link), settings)
    slim = levelled.select("metric_name", "timestamp", "granularity", "ingest_seq", "level", "core_link")
    return fold_by_key(slim, ["metric_name"], ["timestamp", "ingest_seq"], Incident, step, "status string, alert_level string, duration_sec long", carry, "incident").drop("level", "core_link")


def alert_events(judged: DataFrame, settings: Settings = DEFAULTS, carry: Carry | None = None) -> DataFrame:
    """Alerts of judged points (series, prediction and anomaly columns, core_link and business_line of the registry)."""
    levelled = with_level(judged, settings)
    told = incidents(levelled, settings, carry)
    return alert_rows(told.join(levelled.drop("level"), ["metric_name", "timestamp", "granularity", "ingest_seq"]))


def alert_rows(rows: DataFrame) -> DataFrame:
    """Alerts of judged rows at which an incident tells something (status, alert_level, duration_sec)."""
    back = F.col("status") == "recovered"
    gone = F.concat(F.col("metric_name"), F.lit(" recovered after "), humanize_duration(F.col("duration_sec")))
    text = alert_message(F.col("business_line"), F.col("metric_name"), F.col("value"), F.col("predict_value"), F.col("z_score"), F.col("confidence_score"), F.col("duration_sec"))
    return rows.select(
        "metric_name", "timestamp", "granularity", "alert_level", F.when(back, "recovery").otherwise(alert_type(F.col("abnormal_labels"))).alias("alert_type"), "confidence_score",
        "duration_sec", F.when(back, gone).otherwise(text).alias("message"), "status", F.col("value").alias("current_value"), "predict_value", "z_score",
    )


def console_lines(alerts: DataFrame) -> DataFrame:
    """One line of text per alert."""
    numbers = [fixed(F.col(c), n) for c, n in (("current_value", 4), ("predict_value", 4), ("confidence_score", 3), ("z_score", 3))]
    line = F.format_string("[%s] %s %s value=%s predict=%s confidence=%s z=%s", "alert_level", "metric_name", "status", *numbers)
    return alerts.select(line.alias("line"))
