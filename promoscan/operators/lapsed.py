"""Customers who won real prizes in one region and never collected any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LAPSED_DAYS, LAPSED_REGION
from ..functions.columns import ntz
from ..sources.profile import typed_ids
from .normalize import raw_typed


def lapsed_prize_customers(
    scans: DataFrame, customers: DataFrame, as_of, region: int = LAPSED_REGION, days: int = LAPSED_DAYS
) -> DataFrame:
    """One row per customer and phone number, most pending prizes first.

    Takes raw columns, typed or as the text of a CSV file (see ``raw_typed``): an unknown ``is_win_received``
    is neither pending nor received, and scans without a customer form one group.

    Scans are grouped and the conditions applied before the customers are joined. A customer
    table with repeated ids multiplies the counts, as the join of single scans would.
    """
    scans, customers = raw_typed(scans), typed_ids(customers, ["id"])
    prize = F.col("prize_id").isNotNull()
    per_customer = (
        scans.where(F.col("win_date").isNotNull() & (F.col("region_id") == region))
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("scans"),
            F.count_if(prize & ~F.col("is_win_received")).alias("pending_cnt"),
            F.count_if(prize & F.col("is_win_received")).alias("received_cnt"),
            F.max(F.when(prize, F.col("win_date"))).alias("last_prize_at"),
        )
    )
    limit = F.to_date(ntz(as_of)).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    # A last prize is set only if there is one, so this also asks for at least one prize.
    lapsed = per_customer.where((F.col("received_cnt") == 0) & (F.col("last_prize_at") < limit))
    # Equal customer rows collapse before the shuffle; names are chosen after the join, when
    # only the contacts of lapsed customers are left.
    contacts = customers.groupBy("id", F.col("phone_number").alias("phone"), "first_name").agg(
        F.count(F.lit(1)).alias("_copies")
    )
    copies = F.coalesce(F.col("_copies"), F.lit(1))
    return (
        lapsed.join(contacts, _same_id(scans, customers), "left")
        .groupBy("customer_id", "phone")
        .agg(
            F.max("first_name").alias("first_name"),
            F.sum(F.col("scans") * copies).alias("scans"),
            F.sum(F.col("pending_cnt") * copies).alias("pending_cnt"),
            F.max("last_prize_at").alias("last_prize_at"),
        )
        .orderBy(F.desc("pending_cnt"), F.asc_nulls_last("customer_id"), "phone")
    )


def _same_id(scans: DataFrame, customers: DataFrame) -> Column:
    """Equality of both ids, as text if only one of them is text."""
    ours, theirs = F.col("customer_id"), F.col("id")
    kinds = {scans.schema["customer_id"].dataType.typeName(), customers.schema["id"].dataType.typeName()}
    return ours.cast("string") == theirs.cast("string") if len(kinds) == 2 and "string" in kinds else ours == theirs
