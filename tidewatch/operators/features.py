"""Windowed features and seasonal baselines; every frame ends before the current point."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.exprs import last_rows
from tidewatch.functions.ranks import rolling_stats
from tidewatch.operators.folds import fold_by_key
from tidewatch.settings import ALIGNED_LIMIT, DEFAULTS, RECENT_LIMIT, SAME_SECOND_LIMIT, Settings


ROLLING = ("rolling_mean_7d", "rolling_std_7d", "rolling_p70_7d", "rolling_p30_7d")


class Tail:
    """Times and values of the last rows of a series, from which the next ones' windows reach back."""

    def __init__(self, most: int, times=(), values=()):
        self.most, self.times, self.values = most, np.asarray(times, np.int64), np.asarray(values, float)

    @classmethod
    def of(cls, label: str, settings: Settings, times=(), values=()) -> Tail:
        return cls(settings.second_history_window if label == "1s" else settings.minute_history_window, times, values)

    def take(self, times: np.ndarray, values: np.ndarray) -> np.ndarray:
        """ROLLING of new rows in order, which the tail then ends with."""
        old = len(self.times)
        times, values = np.r_[self.times, times.astype(np.int64)], np.r_[self.values, values.astype(float)]
        found = rolling_stats(times, values, self.most, old)
        self.times, self.values = times[-self.most :], values[-self.most :]
        return found


def rolling_features(series: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Mean, deviation, P70 and P30 of the rows of the last week among the last ones that a granularity keeps; the point's own value without any.

    Series are dealt out and sorted, and a batch of rows is answered at once from a tree of ranks over it and the tail before it.
    """

    def prepare(s: dict, rows: pd.DataFrame) -> dict[str, np.ndarray]:
        tail = s.setdefault("tail", Tail.of(rows["granularity"].iloc[0], settings))
        return dict(zip(ROLLING, tail.take(rows["timestamp"].to_numpy(), rows["value"].to_numpy()).T, strict=True))

    return fold_by_key(series, ["metric_name", "granularity"], ["timestamp"], dict, None, ", ".join(f"{c} double" for c in ROLLING), prepare=prepare)


def aligned_baseline(points: DataFrame) -> DataFrame:
    """points (with calendar fields) with base_value: what the season says before the point is seen.

    The median of the last values at the same weekday, time and kind of day, else of those at the same
    second of the minute, else the mean of the last raw values, else the point's own value.
    """
    slot = last_rows(ALIGNED_LIMIT, "metric_name", "weekday", "hour", "minute", "second", "isHoliday")
    second = last_rows(SAME_SECOND_LIMIT, "metric_name", "second")
    recent = last_rows(RECENT_LIMIT, "metric_name")
    middle = lambda w: F.percentile("value", F.lit(0.5)).over(w)
    return points.withColumn("base_value", F.coalesce(middle(slot), middle(second), F.avg("value").over(recent), F.col("value")))


def residual_tail_mean(pairs: DataFrame) -> DataFrame:
    """Given actual and predicted values of a series: baseDayDiff, the mean of the last residuals, bounded by a fifth of the level."""
    mean = F.coalesce(F.avg(F.col("value") - F.col("predict_value")).over(last_rows(RECENT_LIMIT, "metric_name")), F.lit(0.0))
    bound = 0.2 * F.greatest(F.abs("rolling_mean_7d"), F.abs("value"), F.lit(1e-3))
    return pairs.withColumn("_mean", mean).withColumn("baseDayDiff", F.least(F.greatest(F.col("_mean"), -bound), bound)).drop("_mean")


def ewma_correction(observed: DataFrame) -> DataFrame:
    """Final clipped moving correction of each key from its observed rates in order."""
    def step(s: list, row) -> tuple:
        s[0] = min(max(0.9 * s[0] + 0.1 * row.rate, 0.5), 1.5)
        return (s[0],)

    folded = fold_by_key(observed.select("metric_name", "timestamp", "rate"), ["metric_name"], ["timestamp"], lambda: [1.0], step, "correction double")
    return folded.groupBy("metric_name").agg(F.max_by("correction", "timestamp").alias("correction_rate"))


def recent(df: DataFrame, n: int, keys: tuple[str, ...], since: int | None = None) -> DataFrame:
    """The last n rows of each key, oldest first."""
    if since is not None:
        df = df.where(F.col("timestamp") >= since)
    last = Window.partitionBy(*keys).orderBy(F.desc("timestamp"))
    return df.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= n).drop("_n")
