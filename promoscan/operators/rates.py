"""Scan counts per user, made comparable by the time each user was present.

Rows come from the metrics scope; days and weeks are those of the display zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_TZ, SPAN_BASES, check_choice
from ..functions.columns import local_time, week_start
from ..functions.quantiles import exact_quantiles, value_counts

QUARTILES = (0.25, 0.5, 0.75)
STATS = ("mean", "q25", "median", "q75", "count")


def scans_per_user(metrics: DataFrame, u: str) -> DataFrame:
    known = F.col(u).isNotNull() & F.col("win_date").isNotNull()
    return metrics.where(known).groupBy(u).agg(F.count(F.lit(1)).alias("total_scans"))


def _stat_columns(quantiles: DataFrame) -> list[Column]:
    """Mean, quartiles and count; zeros when there are no numbers."""
    values = [F.col("mean"), *[F.col("q")[i] for i in range(len(QUARTILES))]]
    zero = F.lit(0.0)
    return [
        *[F.coalesce(v, zero).alias(name) for v, name in zip(values, STATS)],
        F.coalesce("total", F.lit(0)).alias("count"),
    ]


def span_stats(df: DataFrame, col: str) -> DataFrame:
    """One row: mean, exact quartiles and count. Nulls and text that is no number are left out."""
    value = F.col(col)
    if isinstance(df.schema[col].dataType, T.StringType):
        value = value.try_cast("double")
    stats = exact_quantiles(value_counts(df, value), QUARTILES)
    return stats.select(*_stat_columns(stats))


def describe_scans(per_user: DataFrame, col: str = "total_scans") -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles, maximum; no deviation for one user.

    The quartiles work on (value, how many) pairs: K different counts add up to at least K*K/2
    scans, so the weighted percentile holds few entries however many users there are.
    """
    v = F.col(col)
    probs = F.array(*[F.lit(p) for p in QUARTILES])
    values = value_counts(per_user, v)
    quartiles = values.agg(F.percentile("v", probs, F.col("n")).alias("q")).scalar()
    moments = per_user.agg(
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    return moments.withColumn("q", quartiles).select(
        "count",
        "mean",
        "std",
        "min",
        *[F.col("q")[i].alias(name) for i, name in enumerate(STATS[1:4])],
        "max",
    )


def user_spans(
    metrics: DataFrame, u: str, basis: str = "global", tz: str = DEFAULT_TZ
) -> DataFrame:
    """Per user: first and last local day and week, and how many days and weeks they span.

    The span ends at the last scan of anyone (``global``) or at the user's own (``own``).
    """
    check_choice("basis", basis, SPAN_BASES)
    scanned = metrics.where(F.col("win_date").isNotNull())
    users = (
        scanned.where(F.col(u).isNotNull())
        .groupBy(u)
        .agg(
            local_time(F.min("win_date"), tz).alias("first_win"),
            local_time(F.max("win_date"), tz).alias("last_win"),
            F.count(F.lit(1)).alias("total_scans"),
        )
    )
    if basis == "global":
        # Scans without a user count here. Reads one column and shuffles nothing.
        end = scanned.agg(local_time(F.max("win_date"), tz).alias("end")).scalar()
        users = users.withColumn("last_win", F.to_date(end).cast("timestamp_ntz"))
    first, last = F.col("first_win"), F.col("last_win")
    days = users.select(
        u,
        "first_win",
        F.to_date(first).alias("first_day"),
        week_start(first).alias("first_week_start"),
        "last_win",
        F.to_date(last).alias("last_day"),
        week_start(last).alias("last_week_start"),
        "total_scans",
    )
    span_days = F.date_diff("last_day", "first_day").cast("bigint") + 1
    span_weeks = F.floor(F.date_diff("last_week_start", "first_week_start") / 7) + 1
    one = F.lit(1).cast("bigint")
    return days.select(
        "*",
        F.greatest(one, span_days).alias("span_days"),
        F.greatest(one, span_weeks).alias("span_weeks"),
    )


def scan_rates(spans: DataFrame) -> DataFrame:
    scans = F.col("total_scans")
    return spans.withColumns(
        {
            "daily_rate_span": scans / F.col("span_days"),
            "weekly_rate_span": scans / F.col("span_weeks"),
        }
    )


def full_weeks(spans: DataFrame) -> DataFrame:
    """Whole Monday-to-Sunday weeks from the first to the last day."""
    first_monday = F.date_add("first_day", F.pmod(-F.weekday("first_day"), F.lit(7)))
    whole = F.floor((F.date_diff(F.col("last_day"), first_monday) + 1) / 7)
    return spans.withColumn("full_weeks", F.greatest(F.lit(0).cast("bigint"), whole))


def full_week_rate(spans: DataFrame) -> DataFrame:
    """Scans per whole week; null without one. Needs ``full_weeks``."""
    scans, weeks = F.col("total_scans"), F.col("full_weeks")
    return spans.withColumn("weekly_rate_full_weeks", F.try_divide(scans, weeks))


def rate_stats(rates: DataFrame) -> DataFrame:
    """Two rows: the statistics of the daily and of the weekly rate, read in one pass."""
    columns = {"daily": "daily_rate_span", "weekly": "weekly_rate_span"}
    pairs = [F.struct(F.lit(k).alias("rate"), F.col(c).alias("value")) for k, c in columns.items()]
    values = value_counts(rates.select(F.inline(F.array(*pairs))), F.col("value"), ["rate"])
    stats = exact_quantiles(values, QUARTILES, ["rate"])
    names = rates.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, columns))).alias("rate"))
    return names.join(stats, "rate", "left").select("rate", *_stat_columns(stats))
