"""Counts of a growing folder of scans, kept up to date by reading new files only.

Mergeable counts are stored per file, local day and prize. The files that the store names are those
already counted, so that one write adds the counts and marks the files as done: a load that fails
half-way leaves no trace, and repeating one adds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_TZ
from ..functions.columns import local_time, time_bucket
from ..operators.normalize import normalize

_LOCAL = re.compile("^file:/+")
_KINDS = {
    "file": T.StringType(),
    "date": T.DateType(),
    "prize_id": T.StringType(),
    "is_real_prize": T.BooleanType(),
    "events": T.LongType(),
    "real_received": T.LongType(),
    "real_pending": T.LongType(),
}
COUNTS = T.StructType([T.StructField(name, kind) for name, kind in _KINDS.items()])


def file_counts(scans: DataFrame, file_col: str, tz: str = DEFAULT_TZ) -> DataFrame:
    """``COUNTS`` of normalised scans that carry their file's name."""
    real = F.col("is_real_prize")
    date = time_bucket(local_time(F.col("win_date"), tz), "Day")
    prize = F.col("prize_id").cast("string") if "prize_id" in scans.columns else F.lit(None).cast("string")
    counts = scans.groupBy(F.col(file_col).alias("file"), date.alias("date"), F.when(real, prize).alias("prize_id"), "is_real_prize").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("is_real_prize_received")).alias("real_received"),
        F.count_if(F.col("is_real_prize_pending")).alias("real_pending"),
    )
    return counts.select(*COUNTS.names)


def stored_counts(spark: SparkSession, store: str) -> DataFrame:
    """All counts at ``store``; none if nothing was loaded yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], COUNTS)
    return spark.read.schema(COUNTS).parquet(store)


def load_new_files(spark: SparkSession, paths: Iterable[str], store: str, read: Callable[..., DataFrame] | None = None, tz: str = DEFAULT_TZ) -> list[str]:
    """Count those of the files at ``paths`` (files or folders) that ``store`` doesn't name yet, and return them.

    ``read`` takes the list of files and returns raw scans, Parquet by default. A file without a row is
    looked at again each time. Files are known by their full name: one that changes has to get a new one.
    """
    listed = list(paths)
    files = [_LOCAL.sub("file:/", f) for f in spark.read.text(listed).inputFiles()] if listed else []
    known = {r["file"] for r in stored_counts(spark, store).select("file").distinct().collect()}
    new = sorted(set(files) - known)
    if new:
        raw = spark.read.parquet(*new) if read is None else read(new)
        named = raw.withColumn("_file", F.regexp_replace("_metadata.file_path", _LOCAL.pattern, "file:/"))
        file_counts(normalize(named), "_file", tz).write.mode("append").parquet(store)
    return new


def counts_by_day(counts: DataFrame) -> DataFrame:
    """(date, count) as ``count_by_time`` by day of all files counted."""
    days = counts.where(F.col("date").isNotNull()).groupBy("date")
    return days.agg(F.sum("events").alias("count"))


def kpi_counts(counts: DataFrame) -> DataFrame:
    """The counts of ``kpi_summary`` over all scanned codes, but for distinct users, which don't add up."""
    scanned = counts.where(F.col("date").isNotNull())

    def total(value) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    return scanned.agg(
        total("events").alias("total_events"),
        total(F.when(F.col("is_real_prize"), F.col("events"))).alias("real_prizes_total"),
        total("real_received").alias("real_prizes_received"),
        total("real_pending").alias("real_prizes_pending"),
    )


def prize_counts(counts: DataFrame) -> DataFrame:
    """(prize_id, real_prize_count, received_count) of real prizes, ids as text."""
    real = counts.where("is_real_prize").groupBy("prize_id")
    return real.agg(F.sum("events").alias("real_prize_count"), F.sum("real_received").alias("received_count"))
