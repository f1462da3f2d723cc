"""Versioned model parameters: publishing, the active version, and rollback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def publish(params: DataFrame, prefix: str, at: int) -> DataFrame:
    """params (metric_name, params) as a new version, named by its time."""
    return params.withColumns({"version": F.lit(f"{prefix}_{at}"), "published": F.lit(at).cast("long")})


def active(versions: DataFrame) -> DataFrame:
    """The latest published version of each metric."""
    return versions.groupBy("metric_name").agg(F.max_by(F.struct("version", "published", "params"), "published").alias("v")).select("metric_name", "v.*")


def rollback(versions: DataFrame, version: str, at: int) -> DataFrame:
    """versions with one of them published again, so that it is active where it exists."""
    return versions.unionByName(versions.where(F.col("version") == version).withColumn("published", F.lit(at).cast("long")))
