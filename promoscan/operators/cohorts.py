"""Weekly cohorts: who comes back how many weeks after the first scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_TZ
from ..functions.columns import local_time, week_start
from ..functions.skew import attach_by_key, hot_keys


def _local_scans(filtered: DataFrame, tz: str) -> DataFrame:
    return filtered.where(F.col("win_date").isNotNull()).withColumn(
        "win_local", local_time(F.col("win_date"), tz)
    )


def first_scan(
    filtered: DataFrame, u: str, tz: str = DEFAULT_TZ, hot_rows: int | None = None
) -> DataFrame:
    """Scanned rows with ``win_local`` and the user's ``first_scan``; no user, no row."""
    rows = _local_scans(filtered, tz).where(F.col(u).isNotNull())
    first = local_time(F.min("win_date"), tz)
    per_user = rows.groupBy(u).agg(first.alias("first_scan"), F.count(F.lit(1)).alias("_n"))
    hot = hot_keys(per_user, u, "_n", hot_rows)
    return attach_by_key(rows, per_user, hot, u, "inner").select(*rows.columns, "first_scan")


def cohort_counts(filtered: DataFrame, u: str, tz: str = DEFAULT_TZ) -> DataFrame:
    """(cohort_week, weeks_since_first, users).

    Rows shrink to one per user and week before anything else, so the window over a user sees
    at most the weeks of the calendar, and counting rows counts users.
    """
    weeks = (
        _local_scans(filtered, tz)
        .where(F.col(u).isNotNull())
        .select(u, week_start(F.col("win_local")).alias("activity_week"))
        .distinct()
    )
    first = F.min("activity_week").over(Window.partitionBy(u))
    offset = F.date_diff("activity_week", "cohort_week") / 7
    return (
        weeks.withColumn("cohort_week", first)
        .groupBy("cohort_week", offset.cast("bigint").alias("weeks_since_first"))
        .agg(F.count(F.lit(1)).alias("users"))
    )


def _wide(long: DataFrame, value: str, max_weeks: int | None) -> DataFrame:
    """One row per cohort, one column per offset (``w0``, ``w1``, ...); empty cells are null.

    The columns must be known beforehand. Without ``max_weeks`` a small job finds the largest
    offset, which the calendar bounds. An offset above ``max_weeks`` raises; no cell is dropped.
    """
    if max_weeks is None:
        max_weeks = long.agg(F.max("weeks_since_first")).first()[0] or 0
    names = [f"w{k}" for k in range(max_weeks + 1)]
    weeks = F.col("weeks_since_first")
    too_far = F.raise_error(F.concat(F.lit(f"max_weeks is {max_weeks}, but there is an offset of "), weeks.cast("string")))
    offset = F.when(weeks > max_weeks, too_far).otherwise(F.concat(F.lit("w"), weeks.cast("string")))
    return (
        long.withColumn("_offset", offset)
        .groupBy("cohort_week")
        .pivot("_offset", names)
        .agg(F.max(value))
    )


def cohort_matrix(counts: DataFrame, max_weeks: int | None = None) -> DataFrame:
    """The counts with one column per offset."""
    return _wide(counts, "users", max_weeks).orderBy("cohort_week")


def cohort_retention(counts: DataFrame) -> DataFrame:
    """Long form with the cohort's size and the share of it that came back."""
    size = F.max(F.when(F.col("weeks_since_first") == 0, F.col("users"))).over(
        Window.partitionBy("cohort_week")
    )
    return counts.withColumn("cohort_size", size).withColumn(
        "retention", F.col("users") / F.col("cohort_size")
    )


def cohort_retention_matrix(counts: DataFrame, max_weeks: int | None = None) -> DataFrame:
    """Shares with one column per offset, the cohort as ``yyyy-MM-dd`` text."""
    wide = _wide(cohort_retention(counts), "retention", max_weeks)
    return wide.withColumn("cohort_week", F.date_format("cohort_week", "yyyy-MM-dd")).orderBy(
        "cohort_week"
    )
