"""Keeping heavy keys out of shuffles that would put each key in one task.

One user, or the rows without a user, can hold a large part of the table. A per-key
aggregate is safe (it combines before the shuffle), but a join or a window on that key
is not. So rows are split by a small list of heavy keys taken from the per-key counts:

* the list has at most ``HOT_KEYS`` rows by construction, so broadcasting it is safe;
* heavy rows never shuffle on the key;
* all other rows take the ordinary path, so the result is whole whatever the list holds.

When no key is heavy the broadcast list is empty and adaptive execution drops the heavy
branch before it scans anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
HOT_KEYS = 16_384


def hot_keys(
    per_key: DataFrame, key: str, count: str, hot_rows: int | None = None, limit: int | None = None
) -> DataFrame:
    """Rows of ``per_key`` whose count is over ``hot_rows``, heaviest first."""
    bound = HOT_ROWS if hot_rows is None else hot_rows
    return (
        per_key.where(F.col(count) > bound)
        .orderBy(F.desc(count), F.col(key))
        .limit(HOT_KEYS if limit is None else limit)
    )


def hot_null(df: DataFrame, key: str, count: str, hot_rows: int | None = None) -> DataFrame:
    """One row for the null key if it is heavy, else none. Only blocks of files with nulls are read."""
    bound = HOT_ROWS if hot_rows is None else hot_rows
    null = F.lit(None).cast(df.schema[key].dataType)
    rows = df.where(F.col(key).isNull()).agg(F.count(F.lit(1)).alias(count))
    return rows.where(F.col(count) > bound).select(null.alias(key), count)


def split_by_key(df: DataFrame, key: str, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heavy rows, other rows). Null counts as a key of its own."""
    keys = F.broadcast(hot.select(F.col(key).alias("_hot")))
    same = F.col(key).eqNullSafe(F.col("_hot"))
    return df.join(keys, same, "left_semi"), df.join(keys, same, "left_anti")


def attach_by_key(
    df: DataFrame, per_key: DataFrame, hot: DataFrame, key: str, how: str
) -> DataFrame:
    """Join per-key values on to rows; heavy keys go by broadcast, the rest by an ordinary join.

    ``hot`` has the columns of ``per_key``, which holds each non-null key once. Leave null out of
    ``per_key`` before it is aggregated: the join would otherwise push that filter into one of
    its two uses, and Spark would run the aggregate twice instead of sharing it.
    """
    values = F.broadcast(hot.withColumnRenamed(key, "_hot"))
    heavy = df.join(values, F.col(key).eqNullSafe(F.col("_hot")), "inner").drop("_hot")
    _, rest = split_by_key(df, key, hot)
    return heavy.unionByName(rest.join(per_key, key, how))
