"""Calendar context of points: local date flags and intervals of known causes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import local_time
from tidewatch.settings import DEFAULTS


def with_calendar(df: DataFrame, calendar: DataFrame, rca: DataFrame, timezone: str = DEFAULTS.timezone) -> DataFrame:
    """df with isHoliday, isHotSpot, isRCA and the local fields weekday (Monday 0), hour, minute and second.

    An interval with the metric's name and start <= time <= end counts. Its rows meet those of the
    metric in a join on the name and are reduced to one flag a point before anything else is joined.
    """
    local = local_time(F.col("timestamp"), timezone)
    dated = df.withColumns({"_date": F.to_date(local), "weekday": F.weekday(local), "hour": F.hour(local), "minute": F.minute(local), "second": F.second(local)})
    days = calendar.groupBy(F.col("date").alias("_date")).agg(F.bool_or("is_holiday").alias("isHoliday"), F.bool_or("is_hotspot").alias("isHotSpot"))
    spans = rca.select(F.col("metric_name").alias("_metric"), "start_ts", "end_ts")
    inside = (F.col("metric_name") == F.col("_metric")) & F.col("timestamp").between(F.col("start_ts"), F.col("end_ts"))
    hit = df.select("metric_name", "timestamp").join(spans, inside, "left_semi").distinct().withColumn("isRCA", F.lit(True))
    off = lambda c: F.coalesce(F.col(c), F.lit(False))
    return dated.join(days, "_date", "left").join(hit, ["metric_name", "timestamp"], "left").withColumns({c: off(c) for c in ("isHoliday", "isHotSpot", "isRCA")}).drop("_date")
