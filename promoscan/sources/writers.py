"""Exports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .readers import CSV_OPTIONS


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header, one file per task; times keep their microseconds."""
    df.write.mode(mode).option("header", True).options(**CSV_OPTIONS).csv(path)
