"""Scans on disk: by day of winning, so that a date range reads its days alone; by user, so that
per-user operators don't shuffle and one user's rows are found in one file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DAY_COL
from ..functions.skew import hot_keys, split_by_key


def with_day(df: DataFrame) -> DataFrame:
    """Add the UTC day of ``win_date``, a wall clock; null for codes that weren't scanned."""
    return df.withColumn(DAY_COL, F.to_date("win_date"))


def write_scans_by_day(df: DataFrame, path: str) -> None:
    """Parquet with a folder per day; days that ``df`` has replace those at ``path``, others stay.

    ``win_date`` has to be typed (``parse_dates``). Rows are dealt out by day before they are written, to have few files;
    adaptive execution cuts a day that is too large for one task.
    """
    if not isinstance(df.schema["win_date"].dataType, T.TimestampNTZType):
        raise ValueError("win_date is no wall clock; use parse_dates first")
    days = with_day(df).hint("rebalance", DAY_COL)
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY_COL).parquet(path)


def read_scans_by_day(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """What :func:`write_scans_by_day` wrote, with the day as a column that date filters use.

    ``schema``, that of the scans, is needed only where no row may have been written yet.
    """
    reader = spark.read
    if schema is not None:
        fields = [f for f in schema.fields if f.name != DAY_COL]
        reader = reader.schema(T.StructType([*fields, T.StructField(DAY_COL, T.DateType())]))
    df = reader.parquet(path)
    return df if df.schema[DAY_COL].dataType == T.DateType() else df.withColumn(DAY_COL, F.col(DAY_COL).cast("date"))


@dataclass(frozen=True)
class UserScans:
    """Scans by user: ``ordinary`` users in buckets, ``heavy`` users and rows without a user in a plain table.

    No user is in both, so that whatever is worked out for each user apart can be worked out for both parts.
    """

    ordinary: DataFrame
    heavy: DataFrame

    def each(self, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows of ``operator`` over both parts; it may only put rows of one user together."""
        return operator(self.ordinary).unionByName(operator(self.heavy))

    def last_scan(self) -> Column:
        """The time of anyone's last scan, to give to operators that need it of all scans."""
        ends = self.each(lambda part: part.agg(F.max("win_date").alias("end")))
        return ends.agg(F.max("end").alias("end")).scalar()

    def of_user(self, u: str, user_id) -> DataFrame:
        """The rows of one user. One bucket is read, and of it the row groups that may hold the user."""
        return self.each(lambda part: part.where(F.col(u) == F.lit(user_id)))


def write_scans_by_user(df: DataFrame, name: str, u: str, buckets: int, path: str | None = None, hot_rows: int | None = None) -> UserScans:
    """Tables ``name`` and ``name_heavy``; ``name`` is bucketed and sorted by ``u``.

    A bucket is one file and one task, so users with over ``hot_rows`` rows (at most 16,384 of them, heaviest
    first) and rows without a user go to the plain table. Bloom filters and sorting let a reader skip row groups
    without a user. ``path`` is a folder for both tables, else the warehouse is used. Choose ``buckets`` so that one
    fits a task, such as the size of the scans in units of 128 MB.
    """
    counts = df.where(F.col(u).isNotNull()).groupBy(u).agg(F.count(F.lit(1)).alias("_n"))
    nobody = df.sparkSession.range(1).select(F.lit(None).cast(df.schema[u].dataType).alias(u))
    heavy, ordinary = split_by_key(df, u, hot_keys(counts, u, "_n", hot_rows).select(u).unionByName(nobody))
    sorted_files = ordinary.repartition(buckets, u).write.bucketBy(buckets, u).sortBy(u).option(f"parquet.bloom.filter.enabled#{u}", "true")
    for writer, table in ((sorted_files, name), (heavy.write, f"{name}_heavy")):
        writer = writer if path is None else writer.option("path", f"{path.rstrip('/')}/{table}")
        writer.mode("overwrite").saveAsTable(table)
    return read_scans_by_user(df.sparkSession, name)


def read_scans_by_user(spark: SparkSession, name: str) -> UserScans:
    return UserScans(spark.table(name), spark.table(f"{name}_heavy"))
