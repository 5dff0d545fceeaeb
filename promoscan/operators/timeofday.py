"""Scans by local hour and weekday."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_TZ
from ..functions.columns import local_time


def _with_hour(work: DataFrame, tz: str) -> DataFrame:
    local = local_time(F.col("win_date"), tz)
    return work.where(F.col("win_date").isNotNull()).select(
        F.weekday(local).alias("dow"), F.hour(local).alias("hour")
    )


def hourly_counts(work: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """Hours without scans are left out."""
    counts = _with_hour(work, tz).groupBy("hour").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy("hour")


def dow_hour_counts(work: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """Weekday 0 is Monday."""
    counts = _with_hour(work, tz).groupBy("dow", "hour").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy("dow", "hour")
