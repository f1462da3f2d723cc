"""Declared schemas; nothing is inferred. Built from types, so that importing them needs no session."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
_TAGS = T.MapType(_S, _S)


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


POINT = _of(metric_name=_S, timestamp=_L, value=_D, business_line=_S, tags=_TAGS, priority=_S, metric_type=_S, granularity=_S, trusted=_B, is_interpolated=_B)
REGISTRY = _of(metric_name=_S, business_line=_S, priority=_S, metric_type=_S, core_link=_B, force_ai=_B, tags=_TAGS)
CALENDAR = _of(date=T.DateType(), is_holiday=_B, is_hotspot=_B)
RCA = _of(metric_name=_S, start_ts=_L, end_ts=_L)
FEATURES = _of(
    isHoliday=_B, isRCA=_B, isHotSpot=_B, business_unit=_S, baseDayDiff=_D, hour_of_day=T.IntegerType(), day_of_week=T.IntegerType(),
    rolling_mean_7d=_D, rolling_std_7d=_D, rolling_p70_7d=_D, rolling_p30_7d=_D,
)
PREDICTION = _of(
    metric_name=_S, timestamp=_L, granularity=_S, actual_value=_D, predict_value=_D, lower_bound=_D, upper_bound=_D, model_name=_S, model_version=_S, features=FEATURES
)
ANOMALY = _of(
    metric_name=_S, timestamp=_L, granularity=_S, global_abnormal=_B, local_score=_D, is_periodic=_B, z_score=_D, lower_bound=_D, upper_bound=_D, severity=_D, direction=_S,
    abnormal_labels=T.ArrayType(_S), confidence_score=_D, confidence_components=_of(metric_reliability=_D, anomaly_severity=_D, volatility_level=_D, is_periodic=_D),
)
ALERT = _of(
    metric_name=_S, timestamp=_L, granularity=_S, alert_level=_S, alert_type=_S, confidence_score=_D, duration_sec=_L, message=_S, status=_S, current_value=_D, predict_value=_D, z_score=_D
)
