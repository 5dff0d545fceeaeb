"""User segment, filters and date slices."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import (
    ACTIVE_MAX_SCANS,
    DAY_COL,
    RECEIVED_MODES,
    SCOPES,
    UNKNOWN,
    ScanParams,
    check_choice,
)
from ..functions.columns import ntz, segment_label
from ..functions.skew import attach_by_key, hot_keys, hot_null
from ..sources.readers import optional_columns
from .normalize import to_local


def with_user_segment(df: DataFrame, u: str | None, hot_rows: int | None = None) -> DataFrame:
    """Label every row by how many rows its user has in ``df``, scanned or not.

    Apply before any filter. Rows without a user count as zero, which falls in the middle
    segment. Only users with few rows are joined; whoever is missing from them has many.
    """
    if u is None:
        return df.withColumn("user_segment", F.lit(UNKNOWN))
    known = df.where(F.col(u).isNotNull())
    counts = known.groupBy(u).agg(F.count(F.lit(1)).alias("_n"))
    hot = hot_keys(counts, u, "_n", hot_rows).unionByName(hot_null(df, u, "_n", hot_rows))
    small = counts.where(F.col("_n") <= ACTIVE_MAX_SCANS)
    labelled = attach_by_key(df, small, hot, u, "left")
    scans = F.when(F.col(u).isNull(), F.lit(0)).otherwise(
        F.coalesce(F.col("_n"), F.lit(ACTIVE_MAX_SCANS + 1))
    )
    return labelled.select(*df.columns, segment_label(scans).alias("user_segment"))


def _in_list(df: DataFrame, col: Column, values: Sequence[str]) -> DataFrame:
    return df.where(col.isin(*values)) if values else df


def filter_region(df: DataFrame, regions: Sequence[str]) -> DataFrame:
    """Empty list: no filter."""
    return _in_list(df, F.col("region_name"), regions) if "region_name" in df.columns else df


def filter_prize(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Prize ids compared as text. Empty list: no filter."""
    if not ids or "prize_id" not in df.columns:
        return df
    kind = df.schema["prize_id"].dataType
    if isinstance(kind, T.IntegralType):
        # Compared as numbers, so that the filter reaches the scan.
        numbers = [int(i) for i in ids if re.fullmatch(r"0|-?[1-9][0-9]{0,17}", str(i))]
        return df.where(F.col("prize_id").isin(*numbers))
    return df.where(_prize_text(kind).isin(*[str(i) for i in ids]))


def _prize_text(kind: T.DataType) -> Column:
    """Prize id as text, whole numbers without ``.0``."""
    col = F.col("prize_id")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = F.when(col == F.floor(col), col.try_cast("bigint"))
        return F.coalesce(whole.cast("string"), col.cast("string"))
    return col.cast("string")


def filter_segment(df: DataFrame, segments: Sequence[str]) -> DataFrame:
    """Empty list: no filter."""
    return _in_list(df, F.col("user_segment"), segments)


def filter_win_type(df: DataFrame, types: Sequence[str]) -> DataFrame:
    """Empty list: no rows."""
    return df.where(F.col("win_type").isin(*types)) if types else df.where(F.lit(False))


def filter_received(df: DataFrame, mode: str = "all") -> DataFrame:
    check_choice("received", mode, RECEIVED_MODES)
    if mode == "all":
        return df
    flag = F.col("is_win_received")
    return df.where(flag if mode == "received" else ~flag)


def drop_unscanned(df: DataFrame) -> DataFrame:
    return df.where(F.col("win_date").isNotNull())


def _has_day(df: DataFrame) -> bool:
    return DAY_COL in df.columns and isinstance(df.schema[DAY_COL].dataType, T.DateType)


def filter_start(df: DataFrame, start) -> DataFrame:
    """From ``start`` (UTC) on; None does not limit.

    Scans that are laid out by day (``read_scans_by_day``) are also filtered by their day, so that
    only folders of the range are read.
    """
    return filter_range(df, start)


def filter_range(df: DataFrame, lo=None, hi=None) -> DataFrame:
    """Both ends included; an end left out does not limit. Days as in :func:`filter_start`."""
    if lo is not None:
        df = df.where(F.col("win_date") >= ntz(lo))
        df = df.where(F.col(DAY_COL) >= F.to_date(ntz(lo))) if _has_day(df) else df
    if hi is not None:
        df = df.where(F.col("win_date") <= ntz(hi))
        df = df.where(F.col(DAY_COL) <= F.to_date(ntz(hi))) if _has_day(df) else df
    return df


def date_extent(df: DataFrame, start) -> DataFrame:
    """One row: the range that ``filter_range`` can choose from; nulls when there is none."""
    ends = filter_start(df, start).agg(F.min("win_date").alias("lo"), F.max("win_date").alias("hi"))
    if start is None:
        return ends
    known = F.col("lo").isNotNull()
    lo = F.when(known, F.least(F.greatest(ntz(start), F.col("lo")), F.col("hi")))
    return ends.select(lo.alias("lo"), "hi")


def apply_filters(df: DataFrame, params: ScanParams) -> DataFrame:
    df = filter_prize(filter_region(df, params.regions), params.prizes)
    df = filter_segment(df, params.segments)
    return filter_received(filter_win_type(df, params.win_types), params.received)


def work_slice(df: DataFrame, params: ScanParams) -> DataFrame:
    """Scanned rows from the start date on, in the chosen range, with ``win_local``."""
    scanned = filter_start(drop_unscanned(df), params.start)
    return to_local(filter_range(scanned, params.lo, params.hi), tz=params.tz)


def metrics_scope(filtered: DataFrame, params: ScanParams, scope: str | None = None) -> DataFrame:
    """The current slice, or the same without the date range."""
    scope = params.scope if scope is None else scope
    check_choice("scope", scope, SCOPES)
    if scope == "slice":
        return work_slice(filtered, params)
    return to_local(filter_start(drop_unscanned(filtered), params.start), tz=params.tz)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-null values; prize ids as text. Of an absent optional column, none."""
    df = optional_columns(df, [col])
    value = _prize_text(df.schema[col].dataType) if col == "prize_id" else F.col(col)
    return (
        df.select(value.alias(col)).where(F.col(col).isNotNull()).distinct().orderBy(col)
    )


def user_picklist(df: DataFrame, u: str) -> DataFrame:
    """Sorted distinct users, all of them; what shows them may take fewer."""
    return df.select(u).where(F.col(u).isNotNull()).distinct().orderBy(u)
