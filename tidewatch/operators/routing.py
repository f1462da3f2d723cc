"""AI eligibility and routing of metrics to processing modes."""

from __future__ import annotations

import bisect
import math
from array import array

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.exprs import coefficient_of_variation, granularity_label, priority_score, route_seconds
from tidewatch.operators.folds import Carry, fold_by_key
from tidewatch.settings import DEFAULTS, EPS, PRIORITY_SCORES, Settings

SECOND_LAGS, MINUTE_LAGS = (86400, 604800), (1440, 10080)
LEAST_SCORE = 0.65


def median_gaps(points: DataFrame) -> DataFrame:
    """Upper median of the seconds between a metric's points."""
    gap = F.col("timestamp") - F.lag("timestamp").over(Window.partitionBy("metric_name").orderBy("timestamp"))
    gaps = points.select("metric_name", gap.alias("gap")).where("gap is not null")
    # Ranked rather than collected, so a long series is never one array.
    ranked = gaps.withColumn("n", F.row_number().over(Window.partitionBy("metric_name").orderBy("gap"))).join(gaps.groupBy("metric_name").agg(F.count("*").alias("all")), "metric_name")
    return ranked.where("n = all div 2 + 1").select("metric_name", F.col("gap").alias("median_gap"))


def autocorrelations(points: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """Pearson correlation of each metric with itself ``lag`` rows earlier; 0 where either side is constant or missing."""
    in_order = Window.partitionBy("metric_name").orderBy("timestamp")
    pairs = points.select("metric_name", "value", *(F.lag("value", n).over(in_order).alias(f"lag_{n}") for n in lags))

    def r(n: int):
        late, early = F.when(F.col(f"lag_{n}").isNotNull(), F.col("value")), F.col(f"lag_{n}")
        return F.when((F.stddev_pop(late) > EPS) & (F.stddev_pop(early) > EPS), F.corr(late, early)).otherwise(0.0).alias(f"r_{n}")

    return pairs.groupBy("metric_name").agg(*(r(n) for n in lags))


def assess(points: DataFrame, registry: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """metric_name, eligible, score, forced, reasons, breakdown from all points given."""
    gaps = median_gaps(points)
    facts = points.groupBy("metric_name").agg(
        F.count("*").alias("n"), (F.max("timestamp") - F.min("timestamp")).alias("span"), F.avg((F.col("value") > 0).cast("int")).alias("nonzero"), coefficient_of_variation(F.col("value")).alias("cv")
    )
    lagged = autocorrelations(points, SECOND_LAGS + MINUTE_LAGS)
    best = lambda lags: F.greatest(*(F.col(f"r_{n}") for n in lags), F.lit(0.0))
    whole = registry.join(facts, "metric_name").join(gaps, "metric_name", "left").join(lagged, "metric_name")
    part = {
        "periodicity": F.when(F.col("median_gap") <= 1, best(SECOND_LAGS)).otherwise(best(MINUTE_LAGS)), "nonzero": F.least(F.col("nonzero") / 0.7, F.lit(1.0)),
        "priority": priority_score(F.col("priority")), "stability": F.greatest(F.lit(0.0), 1 - F.col("cv") / 0.8),
    }
    total = 0.30 * part["periodicity"] + 0.25 * part["nonzero"] + 0.20 * part["priority"] + 0.25 * part["stability"]
    short = F.col("span") < settings.history_weeks_required * 604800
    score = F.when(F.col("force_ai"), 1.0).when((F.col("n") < 2) | short, 0.0).otherwise(total)
    reason = F.when(F.col("force_ai"), "manual_override").when(F.col("n") < 2, "insufficient_history").when(short, f"history_lt_{settings.history_weeks_required}_weeks").when(score >= LEAST_SCORE, "score_passed").otherwise("score_low")
    return whole.select(
        "metric_name", (F.col("force_ai") | (score >= LEAST_SCORE)).alias("eligible"), score.alias("score"), F.col("force_ai").alias("forced"), F.array(reason).alias("reasons"),
        F.create_map(*[x for k, c in part.items() for x in (F.lit(k), c.cast("double"))]).alias("breakdown"),
    )


def assess_due(points: DataFrame, registry: DataFrame, assessed: DataFrame, now: int, settings: Settings = DEFAULTS) -> DataFrame:
    """Commands (metric_name, timestamp, command) for a stream, of the metrics whose assessment is due: at first sight, then a day later, or a week after a success.

    points: stored raw points; assessed: metric_name, since, eligible of earlier assessments. Forced metrics need none.
    """
    last = assessed.groupBy("metric_name").agg(F.max("since").alias("since"), F.max_by("eligible", "since").alias("eligible"))
    wait = F.when(F.col("eligible"), settings.eligibility_refresh_interval_sec).otherwise(settings.eligibility_retry_interval_sec)
    due = registry.where(~F.col("force_ai")).join(last, "metric_name", "left").where(F.col("since").isNull() | (F.lit(now) - F.col("since") >= wait)).select(*registry.columns)
    history = points.where(F.col("timestamp").between(now - settings.eligibility_history_sec, now)).join(due.select("metric_name"), "metric_name", "left_semi")
    return assess(history, due, settings).select("metric_name", F.lit(now).cast("long").alias("timestamp"), F.when(F.col("eligible"), "eligible").otherwise("ineligible").alias("command"))


def eligibility_times(points: DataFrame, registry: DataFrame, settings: Settings = DEFAULTS, carry: Carry | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """Throttled assessments: metric_name, since, eligible. At first sight, then a day later, or a week after a success.

    A forced metric is assessed once. History is what lies within eligibility_history_sec before a point;
    the fold keeps as much of a metric, and what came since its last assessment. earlier: stored points
    of metrics that the carry has no state of; they are history and aren't assessed themselves.
    """

    def start() -> dict:
        return {"due": None, "ts": array("q"), "v": array("d")}

    def step(s: dict, row) -> tuple | None:
        now = int(row.timestamp)
        s["ts"].append(now)
        s["v"].append(row.value)
        if row.earlier:
            return None
        if s["due"] is not None and now < s["due"]:
            return None
        first = bisect.bisect_left(s["ts"], now - settings.eligibility_history_sec)
        s["ts"], s["v"] = s["ts"][first:], s["v"][first:]
        ok = bool(row.force_ai) or _score(np.asarray(s["ts"]), np.asarray(s["v"]), row.priority, settings) >= LEAST_SCORE
        s["due"] = math.inf if row.force_ai else now + (settings.eligibility_refresh_interval_sec if ok else settings.eligibility_retry_interval_sec)
        return now, ok

    rows = points.select("metric_name", "timestamp", "value", F.lit(False).alias("earlier"))
    if earlier is not None:
        rows = rows.unionByName(earlier.select("metric_name", "timestamp", "value", F.lit(True).alias("earlier")))
    known = rows.join(registry.select("metric_name", "priority", "force_ai"), "metric_name")
    return fold_by_key(known, ["metric_name"], ["timestamp"], start, step, "since long, eligible boolean", carry, "eligibility").select("metric_name", "since", "eligible")


def _score(ts: np.ndarray, v: np.ndarray, priority: str, settings: Settings) -> float:
    if len(ts) < 2 or ts[-1] - ts[0] < settings.history_weeks_required * 604800:
        return 0.0
    gap = np.sort(np.diff(ts))[(len(ts) - 1) // 2]
    period = 0.0
    for lag in SECOND_LAGS if gap <= 1 else MINUTE_LAGS:
        if len(v) > lag and v[lag:].std() > EPS and v[:-lag].std() > EPS:
            period = max(period, float(np.corrcoef(v[lag:], v[:-lag])[0, 1]))
    size = np.abs(v).mean()
    cv = v.std() / size if size > EPS else 0.0
    return 0.30 * period + 0.25 * min((v > 0).mean() / 0.7, 1.0) + 0.20 * PRIORITY_SCORES.get(priority, 0.5) + 0.25 * max(0.0, 1 - cv / 0.8)


def route(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """df (with priority, force_ai and eligible of its metric) with mode, granularity_sec and label."""
    seconds = route_seconds(F.col("priority"), settings)
    ai = F.coalesce(F.col("force_ai"), F.lit(False)) | F.coalesce(F.col("eligible"), F.lit(False))
    mode = F.when(ai, "ai").when(seconds >= 600, "zero_rule").otherwise("minute_ai")
    return df.withColumn("mode", mode).withColumn("granularity_sec", F.when(ai, 1).otherwise(seconds)).withColumn("label", granularity_label(F.col("granularity_sec")))
