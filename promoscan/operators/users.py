"""Activity and history of users.

A window per user would put all rows of one user in one task. Here every user's time line is cut
into minutes: gaps are taken inside a minute, then between the outer scans of minutes. No window
partition can hold more than the calendar allows, whatever share of the rows a user has.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import HISTORY_COLS
from ..functions.columns import hours, micros_between, round_even

REPEAT_CHUNK = 10_000


def _scanned(metrics: DataFrame, u: str) -> DataFrame:
    return metrics.where(F.col("win_date").isNotNull() & F.col(u).isNotNull())


def _sliced_gaps(rows: DataFrame, u: str, *sums: Column) -> DataFrame:
    """(u, win_date, n, sums..., prev) per distinct scan time; ``prev`` is the time before it.

    ``n`` scans share the time; the gap before it belongs to the first of them. A minute holds at
    most 6 * 10**7 distinct times, and the outer times of a user's minutes are two per minute of
    the calendar: these bound the two windows.
    """
    t = F.col("win_date")
    minute = (F.unix_date(F.to_date(t)) * 24 + F.hour(t)) * 60 + F.minute(t)
    inside = Window.partitionBy(u, "minute").orderBy("win_date")
    # Outer times of all minutes follow each other under the null slice, the others keep theirs.
    across = Window.partitionBy(u, "slice").orderBy("win_date")
    outer = F.col("before").isNull() | F.col("after").isNull()
    return (
        rows.groupBy(u, "win_date")
        .agg(F.count(F.lit(1)).alias("n"), *sums)
        .withColumn("minute", minute)
        .withColumns({"before": F.lag("win_date").over(inside), "after": F.lead("win_date").over(inside)})
        .withColumn("slice", F.when(~outer, F.col("minute")))
        .withColumn("prev", F.coalesce("before", F.lag("win_date").over(across)))
        .drop("minute", "before", "after", "slice")
    )


def _one_row_per_scan(sliced: DataFrame, u: str) -> DataFrame:
    """(u, win_date, prev) with ``n`` rows for each of ``_sliced_gaps``.

    The first scan at an instant keeps the gap, the others follow the instant itself. Long
    runs of copies are cut into chunks that spread over tasks before they are written out.
    """
    copies, chunk = F.col("n") - 1, F.col("chunk")
    chunks = F.sequence(F.lit(0).cast("bigint"), F.ceil(copies / REPEAT_CHUNK))
    size = F.when(chunk == 0, F.lit(1)).otherwise(
        F.least(copies - (chunk - 1) * REPEAT_CHUNK, F.lit(REPEAT_CHUNK)).cast("int")
    )
    return (
        sliced.withColumn("chunk", F.explode(chunks))
        .select(u, "win_date", F.when(chunk == 0, F.col("prev")).otherwise(F.col("win_date")).alias("prev"), "chunk", size.alias("size"))
        .repartition(u, "win_date", "chunk")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("size"))))
        .select(u, "win_date", "prev")
    )


def scan_gaps(metrics: DataFrame, u: str) -> DataFrame:
    """One row per scan: the user's previous scan and the hours since it (null for the first).

    Scans of one user at the same instant follow each other with a gap of zero.
    """
    gaps = _one_row_per_scan(_sliced_gaps(_scanned(metrics, u).select(u, "win_date"), u), u)
    delta = hours(micros_between(F.col("prev"), F.col("win_date")))
    return gaps.select(u, "win_date", F.col("prev").alias("prev_win_date"), delta.alias("delta_hours"))


def user_activity(metrics: DataFrame, u: str) -> DataFrame:
    """Scans, wins, real prizes and typical gaps per user; gaps are zero after one scan only.

    The gaps of a user add up to the time from first to last scan, so the mean needs no window.
    For the median, equal gaps of a user become one row with their number. As these different
    gaps add up to no more than the user's span of time, d of them need d * d / 2 microseconds:
    ten years hold 25 million, which bounds the window over them.
    """
    sums = ("scans", "wins_any", "real_prizes")
    times = _sliced_gaps(
        _scanned(metrics, u).select(u, "win_date", "has_win", "is_real_prize"),
        u,
        F.count_if(F.col("has_win")).alias("wins_any"),
        F.count_if(F.col("is_real_prize")).alias("real_prizes"),
    ).withColumnRenamed("n", "scans")
    gaps = (
        times.groupBy(u, micros_between(F.col("prev"), F.col("win_date")).alias("gap"))
        .agg(
            *[F.sum(c).alias(c) for c in sums],
            F.count(F.lit(1)).alias("n"),
            F.min("win_date").alias("first"),
            F.max("win_date").alias("last"),
        )
        # Scans at the same instant follow each other with a gap of zero. The row without a gap
        # is the first time of the user.
        .withColumns({"zeros": F.col("scans") - F.col("n"), "n": F.when(F.col("gap").isNull(), 0).otherwise(F.col("n"))})
    )
    whole = Window.partitionBy(u)
    running = whole.orderBy(F.col("gap").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = gaps.withColumns(
        {"zeros": F.sum("zeros").over(whole), "end": F.sum("zeros").over(whole) + F.sum("n").over(running)}
    ).withColumn("total", F.sum("scans").over(whole) - 1)

    def at(rank: str) -> Column:
        """The gap of a zero-based rank; ranks below ``zeros`` hold gaps of zero."""
        rank = f"floor((total - 1 + {rank}) / 2)"
        return F.expr(f"max(CASE WHEN {rank} < zeros THEN 0 WHEN {rank} >= end - n AND {rank} < end THEN gap END)")

    total = hours(micros_between(F.col("first"), F.col("last")))
    mean = F.coalesce(F.try_divide(total, F.col("scans") - 1), F.lit(0.0))
    median = F.coalesce(hours(F.col("low") + (F.col("high") - F.col("low")) / 2), F.lit(0.0))
    return (
        ranked.groupBy(u)
        .agg(
            *[F.sum(c).alias(c) for c in sums],
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            at("0").alias("low"),
            at("1").alias("high"),
        )
        .select(
            u,
            *sums,
            round_even(mean, 2).alias("avg_hours_between_scans"),
            round_even(median, 2).alias("median_hours_between_scans"),
            round_even(mean / 24, 2).alias("avg_days_between_scans"),
        )
        # A sort first samples its input. One row per user is cheap to shuffle; without this
        # the sample would run all the windows a second time.
        .hint("rebalance", u)
        .orderBy(F.desc("scans"), F.desc("wins_any"), F.desc("real_prizes"), u)
    )


def cast_user_id(df: DataFrame, u: str, text: str) -> int | str:
    """A typed id as a number if the column holds integers and the text is one."""
    whole = isinstance(df.schema[u].dataType, T.IntegralType) and re.fullmatch(r"\s*[+-]?[0-9]+\s*", text)
    return int(text) if whole else text


def user_history(work: DataFrame, u: str, user_id: int | str) -> DataFrame:
    """The rows of one user in time order, with the history columns that exist."""
    cols = list(dict.fromkeys(c for c in (u, *HISTORY_COLS) if c in work.columns))
    integral = isinstance(work.schema[u].dataType, T.IntegralType)
    if integral and not (isinstance(user_id, int) and -(2**63) <= user_id < 2**63):
        match = F.lit(False)
    else:
        match = F.col(u) == F.lit(user_id)
    # The other columns only make the order repeatable.
    order = ["win_date", *[c for c in cols if c not in (u, "win_date")]]
    return work.where(match).select(*cols).orderBy(*order)
