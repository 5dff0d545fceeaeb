"""Odds and efficiency per prize."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import round_even
from ..sources.readers import optional_columns

RATES = ("p_per_scan", "share_among_real", "received_share_in_prize")


def prize_probabilities(metrics: DataFrame) -> DataFrame:
    """Per prize: won, received, and both as shares.

    One aggregate gives the prize rows and, from its points row, the two denominators.
    """
    real, won, got = F.col("is_real_prize"), F.col("real_prize_count"), F.col("received_count")
    # The filter and the totals use results of the aggregate, all of them, so that the two
    # uses are the same plan and the table is read once.
    scans = optional_columns(metrics, ["prize_id"])
    per_prize = scans.groupBy(F.when(real, F.col("prize_id")).alias("prize_id")).agg(
        F.count(F.lit(1)).alias("real_prize_count"),
        F.count_if(F.col("is_real_prize_received")).alias("received_count"),
        F.max(real).alias("real"),
    )
    totals = per_prize.agg(
        F.struct(
            F.greatest(F.sum(won), F.lit(1)).alias("scans"),
            F.greatest(F.sum(F.when(F.col("real"), won)), F.lit(1)).alias("real"),
            F.sum(got).alias("received"),
        ).alias("t")
    )
    rows = per_prize.where("real").withColumn("t", totals.scalar())
    return rows.select(
        "prize_id",
        "real_prize_count",
        "received_count",
        (won / F.col("t.scans")).alias("p_per_scan"),
        (won / F.col("t.real")).alias("share_among_real"),
        (got / won).alias("received_share_in_prize"),
    ).orderBy(F.desc("real_prize_count"), "prize_id")


def prize_probabilities_pct(probabilities: DataFrame) -> DataFrame:
    """The shares as percentages with three decimals."""
    return probabilities.withColumns({c: round_even(F.col(c) * 100, 3) for c in RATES})


def prize_efficiency(filtered: DataFrame) -> DataFrame:
    won, got = F.col("total_won"), F.col("total_received")
    return (
        optional_columns(filtered, ["prize_id"])
        .where(F.col("is_real_prize"))
        .groupBy("prize_id")
        .agg(
            F.count(F.lit(1)).alias("total_won"),
            F.count_if(F.col("is_win_received")).alias("total_received"),
        )
        .withColumn("unclaimed_rate", 1 - got / won)
        .orderBy(F.desc("total_won"), "prize_id")
    )
