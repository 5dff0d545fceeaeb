"""How long winners take to collect, and prizes left behind."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FORGOTTEN_DAYS, HISTOGRAM_BINS
from ..functions.columns import hours, micros_between, ntz
from ..functions.quantiles import exact_quantiles, value_counts
from ..sources.readers import optional_columns


def time_to_claim(filtered: DataFrame) -> DataFrame:
    """Received real prizes with both dates: ``hours_to_claim``, negative ones dropped."""
    delta = hours(micros_between(F.col("win_date"), F.col("prize_receive_date")))
    return (
        optional_columns(filtered, ["prize_receive_date"])
        .where(
            F.col("is_real_prize")
            & F.col("is_win_received")
            & F.col("prize_receive_date").isNotNull()
            & F.col("win_date").isNotNull()
        )
        .withColumn("hours_to_claim", delta)
        .where(F.col("hours_to_claim") >= 0)
    )


def claim_stats(claims: DataFrame) -> DataFrame:
    """One row: mean and exact median hours, null without claims."""
    values = value_counts(claims, F.col("hours_to_claim"))
    return exact_quantiles(values, [0.5]).select(
        F.coalesce("total", F.lit(0)).alias("claims"),
        F.col("mean").alias("mean_hours"),
        F.col("q")[0].alias("median_hours"),
    )


def nice_step(span: Column, max_bins: int = HISTOGRAM_BINS) -> Column:
    """Bin width of the form 1, 2 or 5 times a power of ten, giving at most ``max_bins``."""
    level = math.ceil(math.log10(max_bins))
    step = F.pow(F.lit(10.0), F.round(F.log10(span)) - level)
    for _ in range(2):
        step = F.when(F.ceil(span / step) > max_bins, step * 10).otherwise(step)
    for part in (5, 2):
        step = F.when(span / (step / part) <= max_bins, step / part).otherwise(step)
    return step


def claim_histogram(
    claims: DataFrame, max_bins: int = HISTOGRAM_BINS, step: float | None = None
) -> DataFrame:
    """(bin_start, bin_end, count) in equal bins; the largest value belongs to the last bin."""
    x = F.col("hours_to_claim")
    lo, hi = F.col("lo"), F.col("hi")
    span = F.when(hi > lo, hi - lo).when(lo != 0, F.abs(lo)).otherwise(F.lit(1.0))
    width = nice_step(span, max_bins) if step is None else F.lit(float(step))
    grid = (
        claims.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
        .withColumn("step", width)
        .withColumn("start", F.floor(lo / F.col("step")) * F.col("step"))
        .withColumn("last", F.ceil((hi - F.col("start")) / F.col("step")) - 1)
        .select(F.struct("step", "start", "last").alias("g"))
    )
    k = F.greatest(
        F.lit(0), F.least(F.floor((x - F.col("g.start")) / F.col("g.step")), F.col("g.last"))
    )
    counts = (
        claims.select("hours_to_claim")
        .withColumn("g", grid.scalar())
        .groupBy((F.col("g.start") + k * F.col("g.step")).alias("bin_start"), "g.step")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    bin_end = F.col("bin_start") + F.col("step")
    return counts.select("bin_start", bin_end.alias("bin_end"), "count").orderBy("bin_start")


def forgotten_prizes(filtered: DataFrame, as_of, days: int = FORGOTTEN_DAYS) -> DataFrame:
    """Pending real prizes won more than ``days`` before ``as_of``."""
    limit = ntz(as_of) - F.make_dt_interval(F.lit(days))
    return filtered.where(F.col("is_real_prize_pending") & (F.col("win_date") < limit))


def forgotten_prizes_count(filtered: DataFrame, as_of, days: int = FORGOTTEN_DAYS) -> DataFrame:
    return forgotten_prizes(filtered, as_of, days).agg(
        F.count(F.lit(1)).alias("forgotten_prizes")
    )
