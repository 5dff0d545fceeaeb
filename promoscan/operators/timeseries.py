"""Counts per local day, week or month, without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_TZ, GRANULARITIES, SKETCH_PRECISION
from ..functions.columns import bucket_step, local_time
from ..functions.columns import time_bucket as bucket_of


def time_bucket(df: DataFrame, col: str, granularity: str, name: str = "date") -> DataFrame:
    """Add the bucket start (a date) of a local wall clock."""
    return df.withColumn(name, bucket_of(F.col(col), granularity))


def _bucketed(df: DataFrame, granularity: str, tz: str) -> DataFrame:
    local = local_time(F.col("win_date"), tz)
    return df.where(F.col("win_date").isNotNull()).withColumn(
        "date", bucket_of(local, granularity)
    )


def count_by_time(df: DataFrame, granularity: str, tz: str = DEFAULT_TZ) -> DataFrame:
    rows = _bucketed(df, granularity, tz)
    return rows.groupBy("date").agg(F.count(F.lit(1)).alias("count"))


def users_by_time(
    df: DataFrame, granularity: str, tz: str, u: str, approximate: bool = False
) -> DataFrame:
    """Distinct users per bucket; rows without a user keep the bucket but add nobody."""
    users = F.approx_count_distinct(u) if approximate else F.countDistinct(F.col(u))
    return _bucketed(df, granularity, tz).groupBy("date").agg(users.alias("count"))


def user_sketches(df: DataFrame, tz: str, u: str, precision: int = SKETCH_PRECISION) -> DataFrame:
    """(date, sketch): HyperLogLog sketches of the users of each local day.

    They can be stored and merged later. ``precision`` is the base-2 logarithm of the buckets, 4 to 21. Rows
    without a user keep the day but add nobody.
    """
    return _bucketed(df, "Day", tz).groupBy("date").agg(F.hll_sketch_agg(F.col(u), precision).alias("sketch"))


def users_from_sketches(sketches: DataFrame) -> DataFrame:
    """(granularity, date, count): estimated distinct users per day, week and month from daily sketches.

    The standard error is 1.04 / sqrt(2 ** precision), 1.6 % by default; small numbers are exact. All three granularities
    come from one pass over the sketches, the scans are not read again.
    """
    buckets = [F.struct(F.lit(g).alias("granularity"), bucket_of(F.col("date"), g).alias("date")) for g in GRANULARITIES]
    merged = sketches.select(F.explode(F.array(*buckets)).alias("b"), "sketch").groupBy("b.granularity", "b.date")
    return merged.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("count"))


def _series(counts: DataFrame, lo: Column, hi: Column, granularity: str) -> DataFrame:
    """Every bucket from ``lo`` to ``hi`` (aggregates over ``counts``), zero where absent.

    The calendar is one row exploded; its length is bounded by the calendar, not by the data.
    """
    ends = counts.agg(lo.alias("lo"), hi.alias("hi"))
    days = F.when(
        F.col("lo") <= F.col("hi"), F.sequence("lo", "hi", bucket_step(granularity))
    )
    calendar = ends.select(F.explode(days).alias("day"))
    filled = F.coalesce(F.col("count"), F.lit(0)).cast("bigint")
    # Null-safe, so that no null check is pushed into `counts` here: its aggregate stays the
    # same plan in both places and runs once.
    joined = calendar.join(counts, F.col("day").eqNullSafe(F.col("date")), "left")
    return joined.select(F.col("day").alias("date"), filled.alias("count"))


def fill_time_gaps(df: DataFrame, granularity: str) -> DataFrame:
    return _series(df, F.min("date"), F.max("date"), granularity).orderBy("date")


def _first_kept() -> Column:
    """First non-zero bucket, or the first one when all are zero."""
    return F.coalesce(F.min(F.when(F.col("count") > 0, F.col("date"))), F.min("date"))


def trim_leading_zeros(df: DataFrame) -> DataFrame:
    first = df.agg(_first_kept().alias("first")).scalar()
    return df.where(F.col("date") >= first).orderBy("date")


def trim_trailing_zero(df: DataFrame) -> DataFrame:
    """Drop the last bucket if it is zero; an earlier zero before it stays."""
    last = df.agg(F.max("date").alias("last")).scalar()
    return df.where((F.col("date") < last) | (F.col("count") > 0)).orderBy("date")


def aggregate_time(
    df: DataFrame, granularity: str, unique: bool = False, tz: str = DEFAULT_TZ, u: str | None = None
) -> DataFrame:
    """Gap-free trimmed series of events, or of distinct users when ``unique``.

    The trims are worked out on the buckets that exist, so the calendar is built once.
    """
    if unique and u:
        counts = users_by_time(df, granularity, tz, u)
    else:
        counts = count_by_time(df, granularity, tz)
    last = F.max("date")
    last_is_zero = F.max_by("count", "date") == 0
    before = (last - bucket_step(granularity)).cast("date")
    hi = F.when(last_is_zero, before).otherwise(last)
    return _series(counts, _first_kept(), hi, granularity).orderBy("date")


def real_prize_series(
    df: DataFrame, granularity: str, unique: bool = False, tz: str = DEFAULT_TZ, u: str | None = None
) -> DataFrame:
    return aggregate_time(df.where(F.col("is_real_prize")), granularity, unique, tz, u)


def series_export(series: DataFrame) -> DataFrame:
    return series.withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss"))


def series_preview(series: DataFrame, head: int = 10, tail: int = 5) -> DataFrame:
    """First and last buckets, marked by ``part``."""
    first = series.orderBy("date").limit(head).withColumn("part", F.lit("head"))
    last = series.orderBy(F.desc("date")).limit(tail).withColumn("part", F.lit("tail"))
    return first.unionByName(last).select("part", "date", "count").orderBy("part", "date")
