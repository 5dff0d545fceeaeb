"""Key figures and prize pick-up.

Rows without ``win_date`` are gone before these run, so every event is a win and
``win_rate`` is one unless there are no events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TOP_PENDING
from ..functions.columns import rate


def _count(flag: str) -> Column:
    return F.count_if(F.col(flag))


_TOTALS = {
    "wins_total": "has_win",
    "real_prizes_total": "is_real_prize",
    "real_prizes_received": "is_real_prize_received",
    "real_prizes_pending": "is_real_prize_pending",
}


def kpi_summary(metrics: DataFrame, u: str | None) -> DataFrame:
    """One row of totals. Rows are combined per user before the shuffle, then summed."""
    events = F.count(F.lit(1)).alias("total_events")
    totals = [_count(flag).alias(name) for name, flag in _TOTALS.items()]
    if u is None:
        return metrics.agg(events, *totals)
    per_user = metrics.groupBy(u).agg(events, *totals)

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).alias(name)

    users = F.count(F.col(u)).alias("unique_users")
    return per_user.agg(total("total_events"), users, *[total(c) for c in _TOTALS])


def kpi_rates(metrics: DataFrame) -> DataFrame:
    """One row of shares, zero where there is nothing to divide by."""
    sums = metrics.agg(
        F.count(F.lit(1)).alias("events"), *[_count(f).alias(n) for n, f in _TOTALS.items()]
    )
    wins, real = F.col("wins_total"), F.col("real_prizes_total")
    return sums.select(
        rate(wins, F.col("events")).alias("win_rate"),
        rate(real, wins).alias("real_share"),
        rate(F.col("real_prizes_received"), real).alias("received_rate"),
        rate(F.col("real_prizes_pending"), real).alias("pending_rate"),
    )


def user_kpis(metrics: DataFrame, u: str) -> DataFrame:
    """One row of user counts.

    ``users_pending_but_ever_received_real`` also counts users with nothing pending, as the
    dashboard does; ``users_pending_and_received_real`` is the true overlap.
    """
    per_user = (
        metrics.where(F.col(u).isNotNull())
        .groupBy(u)
        .agg(
            F.max("has_win").alias("won"),
            F.max("is_win_received").alias("got"),
            F.max("is_real_prize_pending").alias("pending"),
            F.max("is_real_prize_received").alias("got_real"),
        )
    )
    return per_user.agg(
        _count("won").alias("users_won_any"),
        _count("got").alias("users_received_any"),
        _count("pending").alias("users_pending_real"),
        _count("got_real").alias("users_pending_but_ever_received_real"),
        F.count_if(F.col("pending") & F.col("got_real")).alias("users_pending_and_received_real"),
    )


def pending_events(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("is_real_prize_pending"))


def pending_events_count(metrics: DataFrame) -> DataFrame:
    return metrics.agg(_count("is_real_prize_pending").alias("pending_events"))


def pending_users(metrics: DataFrame, u: str) -> DataFrame:
    """Users with a pending or received real prize, with both counts."""
    received = F.col("received_real_before_count")
    return (
        metrics.where(F.col(u).isNotNull() & F.col("is_real_prize"))
        .groupBy(u)
        .agg(
            _count("is_real_prize_pending").alias("pending_real_prizes"),
            _count("is_real_prize_received").alias("received_real_before_count"),
        )
        .withColumn("has_received_real_before", received > 0)
    )


def top_pending_users(pending: DataFrame, u: str, n: int = TOP_PENDING) -> DataFrame:
    return pending.orderBy(F.desc("pending_real_prizes"), F.col(u)).limit(n)


def consistency_check(metrics: DataFrame, u: str, scope: str) -> DataFrame:
    """One row; it is an anomaly if more users wait than there are waiting prizes."""
    per_user = pending_events(metrics).groupBy(u).agg(F.count(F.lit(1)).alias("n"))
    sums = per_user.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("pending_events"),
        F.count(F.col(u)).alias("pending_unique_users"),
    )
    return sums.select(
        "*",
        F.lit(u).alias("user_field"),
        F.lit(scope).alias("scope"),
        (F.col("pending_unique_users") > F.col("pending_events")).alias("anomaly"),
    )
