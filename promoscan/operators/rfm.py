"""Recency, frequency and prizes per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MICROS_PER_DAY, micros_between, ntz, segment_label


def rfm(filtered: DataFrame, u: str, end=None) -> DataFrame:
    """One row per user. Recency counts whole days up to ``end``, by default the last scan of anyone.

    Scans without a user count for the overall last scan, which reads one column only.
    """
    scanned = filtered.where(F.col("win_date").isNotNull())
    end = scanned.agg(F.max("win_date").alias("end")).scalar() if end is None else ntz(end)
    days = F.floor(micros_between(F.col("last_scan"), F.col("end")) / MICROS_PER_DAY)
    return (
        scanned.where(F.col(u).isNotNull())
        .groupBy(u)
        .agg(
            F.max("win_date").alias("last_scan"),
            F.count(F.lit(1)).alias("frequency"),
            F.count_if(F.col("is_real_prize")).alias("real_prizes"),
        )
        .withColumn("end", end)
        .select(
            u,
            "last_scan",
            "frequency",
            "real_prizes",
            days.alias("recency_days"),
            segment_label(F.col("frequency")).alias("segment"),
        )
    )


def rfm_segment_counts(users: DataFrame) -> DataFrame:
    counts = users.groupBy("segment").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "segment")
