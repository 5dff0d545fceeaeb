"""Exact quantiles (linear interpolation) that never hold all values in one task.

Spark's ``percentile`` keeps a map of every distinct value on one reducer. Here the values are
first collapsed to (value, count) and counted in buckets of about a thousandth of their size.
Running totals over the buckets show which ones hold a wanted rank. These few are cut into 2^20
parts of equal width, and only the values of the parts with a wanted rank are sorted: of doubles
over 1e-12 at most about eight million different ones, however narrow the distribution. Cutting is
monotone, so the answer is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A bucket spans a factor of exp(1/1024); below 1e-9 buckets have equal width. All doubles
# fall in fewer than 1.5 million buckets, which bounds the running totals.
BUCKETS_PER_E_FOLD = 1024
LINEAR_BELOW = 1e-9
PARTS = 1 << 20


def value_counts(df: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by..., v, n): how often each number occurs, combined before the shuffle."""
    return (
        df.select(*by, value.alias("v"))
        .where(F.col("v").isNotNull() & ~F.isnan("v"))
        .groupBy(*by, "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _bucket(v: Column) -> Column:
    v = v.cast("double")
    size = F.log1p(F.least(F.abs(v) / LINEAR_BELOW, F.lit(1e308)))
    # Never null, so that no null check is pushed below one of the two uses of the counts:
    # they stay the same plan, and the shuffle is done once.
    return F.coalesce(F.floor(F.signum(v) * size * BUCKETS_PER_E_FOLD), F.lit(0).cast("bigint"))


def _part(v: Column, low: Column, high: Column) -> Column:
    """The part of the cell from ``low`` to ``high`` that ``v`` is in; one part if that has no width."""
    width = (high - low).cast("double")
    share = F.when((width > 0) & (width < 1e308), (v - low).cast("double") / width)
    return F.coalesce(F.floor(share * (PARTS - 1)), F.lit(0).cast("bigint"))


def _position(prob: float) -> str:
    return f"((total - 1) * {float(prob)!r}D)"


def _rank_pair(prob: float) -> tuple[str, str]:
    """The two zero-based ranks to interpolate between."""
    low = f"floor({_position(prob)})"
    return low, f"least({low} + 1, total - 1)"


def _interpolated(probs: Sequence[float]) -> str:
    """An array with one value per probability, from the columns ``low0``, ``high0``, ..."""
    terms = [
        f"low{i} + ({_position(p)} - floor({_position(p)})) * (high{i} - low{i})"
        for i, p in enumerate(probs)
    ]
    return f"array({', '.join(terms)})"


def exact_quantiles(values: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., total, mean, q): ``q`` is an array with one double per probability.

    ``values`` comes from :func:`value_counts`. Without ``by`` there is always one row, of
    nulls when there are no values. With ``by`` the groups must be few, as each broadcasts two
    rows per probability.
    """
    by = list(by)
    running = Window.unboundedPreceding, Window.currentRow
    # A cell (or value) takes the ranks from `begin` to before `begin + n`.
    ranks = ", ".join(rank for p in probs for rank in _rank_pair(p))
    wanted = F.expr(f"exists(array({ranks}), r -> r >= begin AND r < begin + n)")
    before = F.sum("n").over(Window.partitionBy(*by, "base").orderBy("part").rowsBetween(*running)) - F.col("n")
    bounds = [F.min("v").alias("low"), F.max("v").alias("high")]

    bucketed = values.withColumn("b", _bucket(F.col("v")))
    whole = Window.partitionBy(*by)
    total = F.sum("n").over(whole)
    cells = (
        bucketed.groupBy(*by, "b")
        .agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("double") * F.col("n")).alias("s"), *bounds)
        .select(
            *by,
            "b",
            "n",
            (F.sum("n").over(whole.orderBy("b").rowsBetween(*running)) - F.col("n")).alias("begin"),
            total.alias("total"),
            (F.sum("s").over(whole) / total).alias("mean"),
            "low",
            "high",
        )
        .where(wanted)
    )

    def inside() -> DataFrame:
        """The values in ``cells``; ``base``, the first rank of a cell, names it within its group."""
        chosen = cells.select(*[F.col(c).alias(f"_{c}") for c in (*by, "b")], F.col("begin").alias("base"), "total", "mean", "low", "high")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col("b") == F.col("_b"), F.col("v").between(F.col("low"), F.col("high"))]
        return bucketed.join(F.broadcast(chosen), same, "inner")

    parts = inside().groupBy(*by, "b", "base", _part(F.col("v"), F.col("low"), F.col("high")).alias("part"))
    parts = parts.agg(F.sum("n").alias("n"), F.max("total").alias("total"), F.max("mean").alias("mean"), *bounds)
    cells = parts.withColumn("begin", F.col("base") + before).where(wanted)
    ranked = inside().withColumn("part", F.col("v")).select(
        *by, F.col("v").cast("double").alias("v"), "n", (F.col("base") + before).alias("begin"), "total", "mean"
    )
    ends = []
    for i, p in enumerate(probs):
        for name, rank in zip(("low", "high"), _rank_pair(p)):
            at = f"max(CASE WHEN {rank} >= begin AND {rank} < begin + n THEN v END)"
            ends.append(F.expr(at).alias(f"{name}{i}"))
    picked = ranked.groupBy(*by).agg(
        F.max("total").alias("total"), F.max("mean").alias("mean"), *ends
    )
    return picked.select(*by, "total", "mean", F.expr(_interpolated(probs)).alias("q"))
