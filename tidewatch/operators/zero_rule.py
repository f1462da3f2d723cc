"""Zero rule for metrics of low priority: a bucket at nothing, or far below the mean of the last six."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import last_rows
from tidewatch.settings import DEFAULTS, Settings


def rule_columns(mean: Column, settings: Settings = DEFAULTS) -> dict[str, Column]:
    """Prediction and anomaly columns of a row's value; mean: of the six values before it, null without any."""
    predicted = F.greatest(F.coalesce(mean, F.col("value")), F.lit(0.0))
    ratio = F.when(predicted > 0, F.col("value") / predicted)
    hit = (F.col("value") <= settings.zero_rule_floor) | F.coalesce(ratio <= settings.zero_rule_drop_ratio, F.lit(False))
    one = F.when(hit, 1.0).otherwise(0.0)
    none = F.array().cast("array<string>")
    return {
        "predict_value": predicted, "global_abnormal": hit, "local_score": one, "is_periodic": F.lit(False), "z_score": F.col("value") - predicted, "lower_bound": F.lit(0.0), "upper_bound": predicted,
        "severity": one, "direction": F.when(hit, "down").otherwise("normal"), "abnormal_labels": F.when(hit, F.array(F.lit("zero_rule"))).otherwise(none),
        "confidence_score": F.when(hit, 0.75).otherwise(0.0),
        "confidence_components": F.struct(F.when(mean.isNotNull(), 1.0).otherwise(0.5).alias("metric_reliability"), one.alias("anomaly_severity"), F.lit(1.0).alias("volatility_level"), F.lit(1.0).alias("is_periodic")),
        "model_name": F.lit("zero_rule_baseline"), "model_version": F.lit("rule_v1"),
    }


def zero_rule(series: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """series (metric_name, granularity, timestamp, value) with prediction and anomaly columns."""
    known = series.withColumn("_mean", F.avg("value").over(last_rows(6, "metric_name", "granularity")))
    return known.withColumns(rule_columns(F.col("_mean"), settings)).drop("_mean")
