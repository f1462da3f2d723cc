"""Column expressions of the engine's scalar formulas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidewatch.settings import BUSINESS_UNIT_FACTORS, CANDIDATE_PERIODS, DEFAULTS, EPS, PRIORITY_SCORES, Settings


def floor_timestamp(ts: Column, seconds: int | Column) -> Column:
    return ts - F.pmod(ts, F.lit(seconds) if isinstance(seconds, int) else seconds)


def granularity_label(seconds: Column) -> Column:
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m")))


def local_time(ts: Column, timezone: str = DEFAULTS.timezone) -> Column:
    """Wall clock of the zone, for a session in UTC."""
    return F.from_utc_timestamp(F.timestamp_seconds(ts), timezone)


def humanize_duration(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0)).cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.expr("1") * F.floor(s / 60), F.lit("m"), F.pmod(s, F.lit(60)), F.lit("s")))


def fixed(x: Column, digits: int) -> Column:
    """x with so many decimals, rounded as the double that it is: 18.0175 lies below that number, so three decimals are 18.017. (%.3f rounds its shortest decimal form.)"""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits))


def route_seconds(priority: Column, settings: Settings = DEFAULTS) -> Column:
    return reduce(lambda c, kv: F.when(priority == kv[0], kv[1]).otherwise(c), settings.priority_route_seconds.items(), F.lit(300))


def priority_score(priority: Column) -> Column:
    return reduce(lambda c, kv: F.when(priority == kv[0], kv[1]).otherwise(c), PRIORITY_SCORES.items(), F.lit(0.5))


def z_score(actual: Column, predicted: Column) -> Column:
    return (actual - predicted) / F.greatest(F.sqrt(F.abs(predicted)), F.lit(EPS))


def severity(z: Column, lower: Column, upper: Column) -> Column:
    one = F.lit(1.0)
    width = F.greatest((upper - lower) / 2, F.lit(EPS))
    return (
        F.when(lower >= upper, F.least(F.abs(z) / 3, one))
        .when(z < lower, F.least(F.abs(z - lower) / (F.abs(lower) + EPS), one))
        .when(z > upper, F.least(F.abs(z - upper) / (F.abs(upper) + EPS), one))
        .otherwise(F.least(F.abs(z - (upper + lower) / 2) / width, one))
    )


def segment(predicted: Column, p70: Column, p30: Column) -> Column:
    return F.when(predicted >= p70, "peak").when(predicted <= p30, "valley").otherwise("mid")


def feature_factor(holiday: Column, hotspot: Column, rca: Column, business_line: Column) -> Column:
    unit = reduce(lambda c, kv: F.when(business_line == kv[0], kv[1]).otherwise(c), BUSINESS_UNIT_FACTORS.items(), F.lit(1.0))
    on = lambda flag, factor: F.when(flag, factor).otherwise(1.0)
    return on(holiday, 1.02) * on(hotspot, 1.05) * on(rca, 0.97) * unit


def mann_kendall_z(values: Column) -> Column:
    """Mann-Kendall statistic of an array with continuity correction, without ties' correction; null below five values."""
    n = F.size(values)
    of = lambda i: F.aggregate(F.slice(values, i + 1, F.greatest(n - i, F.lit(0))), F.lit(0.0), lambda a, x: a + F.signum(x - F.get(values, i - 1)))
    s = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(0.0), lambda a, i: a + of(i))
    sd = F.sqrt(n * (n - 1) * (2 * n + 5) / 18.0)
    return F.when(n >= 5, F.when(s > 0, (s - 1) / sd).when(s < 0, (s + 1) / sd).otherwise(0.0))


def coefficient_of_variation(value: Column) -> Column:
    """An aggregate: population deviation over the mean of magnitudes."""
    mean = F.avg(F.abs(value))
    return F.when((F.count(value) <= 1) | (mean <= EPS), 0.0).otherwise(F.stddev_pop(value) / mean)


def alert_level(global_abnormal: Column, local_score: Column, labels: Column, confidence: Column, core_link: Column, settings: Settings = DEFAULTS) -> Column:
    zero, p0, p1 = F.array_contains(labels, "zero_rule"), settings.confidence_p0, settings.confidence_p1
    return (
        F.when(~(global_abnormal | (local_score >= 0.5) | zero), None)
        .when(zero, "P2")
        .when((confidence >= p0) & core_link, "P0")
        .when((confidence >= p1) & core_link, "P1")
        .when(confidence >= p0, "P1")
        .when(confidence >= p1, "P2")
    )


def alert_type(labels: Column) -> Column:
    return F.when(F.size(labels) > 0, F.array_join(labels, "+")).otherwise("global")


def alert_message(business_line: Column, metric: Column, actual: Column, predicted: Column, z: Column, confidence: Column, duration: Column) -> Column:
    label = F.when(F.coalesce(business_line, F.lit("")) != "", F.concat(business_line, F.lit(" "), metric)).otherwise(metric)
    numbers = (fixed(actual, 4), fixed(predicted, 4), fixed(z, 3), fixed(confidence, 3))
    return F.concat(F.format_string("%s abnormal: current=%s, predict=%s, z=%s, confidence=%s, duration=", label, *numbers), humanize_duration(duration))


def candidate_periods(granularity: Column) -> Column:
    known = lambda p: F.array(*map(F.lit, p))
    return reduce(lambda c, kv: F.when(granularity == kv[0], known(kv[1])).otherwise(c), CANDIDATE_PERIODS.items(), known((60,)))


def last_rows(n: int, *keys: str, order: tuple[str, ...] = ("timestamp",)):
    """The n rows before the current one, per key."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)
