"""Reading the scan table, caching it, and checking its columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DATE_COLS, UNKNOWN
from ..functions.columns import null_if_token
from .profile import typed_ids


#: What reader and writer agree on, in files as in text columns.
CSV_OPTIONS = {
    "quote": '"',
    "escape": '"',
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    # the writer would strip text otherwise
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


class MissingColumnError(ValueError):
    """The scan table lacks a column that no operator can do without."""


def null_tokens(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Read the usual missing-value words as null in text columns (not stripped first)."""
    chosen = set(df.columns if cols is None else cols)
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)} & chosen
    return df.select(
        *[null_if_token(F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns]
    )


def read_scans_csv(
    spark: SparkSession, path, cols: Iterable[str] | None = None, multiline: bool = False, typed: bool = False
) -> DataFrame:
    """CSV with a header; every column is text, missing-value words are null.

    Columns are named by the header, so they may come in any order and any optional one may
    be absent. Nothing is inferred from the data, so it is read once. ``multiline`` allows
    line breaks inside quotes, at the price of one task per file. ``typed`` reads it once more, to make
    columns named ``_id`` bigint where they hold whole numbers only (see ``typed_ids``).
    """
    df = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .options(**CSV_OPTIONS)
        .option("multiLine", multiline)
        .csv(path)
    )
    df = null_tokens(df if cols is None else df.select(*cols))
    return typed_ids(df) if typed else df


class CheckedRows(NamedTuple):
    """``rows`` that were read, and the ``broken`` lines (line, reason); together all lines that aren't blank."""

    rows: DataFrame
    broken: DataFrame


def read_scans_csv_checked(spark: SparkSession, path) -> CheckedRows:
    """As :func:`read_scans_csv`, with broken lines put aside, see :func:`checked_csv_lines`.

    All files must begin with the same header; lines equal to it are no data. There are no line breaks inside quotes.
    """
    lines = spark.read.text(path)
    header = lines.first()
    if header is None:
        raise MissingColumnError(f"no header in {path}")
    named = lines.sparkSession.createDataFrame([header], "value string").select(F.col("value").alias("line"))
    count = named.select(F.size(F.split(_bare(F.col("line")), ",")).alias("n")).first()["n"]
    fields = scans_from_csv_lines(named, [f"c{i}" for i in range(count)]).first()
    return checked_csv_lines(lines.where(F.col("value") != header[0]), list(fields), "value")


def _bare(line: Column) -> Column:
    """A line of CSV text without its quoted fields."""
    return F.regexp_replace(line, r'(^|,)"(?:[^"]|"")*"(?=,|$)', "$1")


def _free_name(cols: Iterable[str]) -> str:
    taken, name = set(cols), "_line"
    while name in taken:
        name += "_"
    return name


def csv_lines(df: DataFrame, name: str = "line") -> DataFrame:
    """Each row as one line of CSV text, in the form of ``write_csv``."""
    return df.select(F.to_csv(F.struct(*df.columns), CSV_OPTIONS).alias(name))


def scans_from_csv_lines(lines: DataFrame, cols: Iterable[str], name: str = "line") -> DataFrame:
    """Lines of CSV text as :func:`read_scans_csv` reads a file with these columns."""
    schema = ", ".join(f"`{c}` string" for c in cols)
    return null_tokens(lines.select(F.from_csv(name, schema, CSV_OPTIONS).alias("_r")).select("_r.*"))


def checked_csv_lines(lines: DataFrame, cols: Iterable[str], name: str = "line") -> CheckedRows:
    """Lines of CSV text as :func:`read_scans_csv` reads a file with these columns; broken ones are put aside.

    Broken are lines in which a quoted field isn't closed (the parser would take it as it is), that have
    more or fewer fields than ``cols``, or that the parser itself rejects. Blank lines are skipped.
    """
    cols = list(cols)
    text, bare, raw = F.col(name), _bare(F.col(name)), _free_name(cols)
    fields = F.regexp_count(bare, F.lit(",")) + 1
    seen = (
        F.when(bare.rlike('(^|,)"'), "open quote")
        .when(fields < len(cols), "too few fields")
        .when(fields > len(cols), "too many fields")
    )
    schema = ", ".join(f"`{c}` string" for c in [*cols, raw])
    parsed = F.from_csv(name, schema, {**CSV_OPTIONS, "columnNameOfCorruptRecord": raw})
    read = lines.where(F.trim(text) != "").select(text.alias("line"), seen.alias("seen"), parsed.alias("r"))
    reason = F.coalesce("seen", F.when(F.col(f"r.`{raw}`").isNotNull(), "unreadable"))
    rows = read.where(reason.isNull()).select(*[F.col(f"r.`{c}`") for c in cols])
    return CheckedRows(null_tokens(rows), read.where(reason.isNotNull()).select("line", reason.alias("reason")))


def read_scans_parquet(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def jdbc_options(
    url: str,
    sql: str,
    props: Mapping[str, str] | None = None,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int | None = None,
    one_task: bool = False,
) -> dict[str, str]:
    """Options of the JDBC read: parallel range queries over the partition column.

    A read without one goes through a single connection, so it has to be asked for by ``one_task``.
    """
    options = {"url": url, "driver": "org.postgresql.Driver", "fetchsize": "10000"}
    options.update(props or {})
    if partition_column is None:
        if not one_task:
            raise ValueError("give a partition column with bounds and partitions, or one_task=True")
        options["query"] = sql
        return options
    if bounds is None or partitions is None:
        raise ValueError("a partitioned read needs bounds and partitions")
    # `query` cannot be combined with a partition column; a derived table can.
    options.update(
        dbtable=f"({sql.rstrip().rstrip(';')}) AS scans",
        partitionColumn=partition_column,
        lowerBound=str(bounds[0]),
        upperBound=str(bounds[1]),
        numPartitions=str(partitions),
    )
    return options


def read_scans_jdbc(
    spark: SparkSession, url: str, sql: str, props: Mapping[str, str] | None = None, **partitioning
) -> DataFrame:
    """Result of a SQL text run by PostgreSQL (its JDBC driver must be on the class path)."""
    options = jdbc_options(url, sql, props, **partitioning)
    return spark.read.format("jdbc").options(**options).load()


def cache_scans(df: DataFrame) -> DataFrame:
    """Keep the loaded table for reuse by several operators; spills to disk when large."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def refresh(df: DataFrame, path: str | None = None) -> None:
    """Forget a cached table and, given its path, the file listing behind it."""
    df.unpersist()
    if path is not None:
        df.sparkSession.catalog.refreshByPath(path)


def require_columns(df: DataFrame, cols: Iterable[str] = ("win_date",)) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumnError(f"missing column(s): {', '.join(missing)}")
    return df


def optional_columns(df: DataFrame, needed: Iterable[str] | None = None) -> DataFrame:
    """Add those of the ``needed`` optional columns (all by default) that are absent, each with its constant."""
    constants = {
        "is_win_received": F.lit(False),
        "region_name": F.lit(UNKNOWN),
        "prize_id": F.lit(None).cast("string"),
        **{c: F.lit(None).cast("timestamp_ntz") for c in DATE_COLS if c != "win_date"},
    }
    absent = [c for c in (constants if needed is None else needed) if c in constants and c not in df.columns]
    return df.select("*", *[constants[c].alias(c) for c in absent]) if absent else df
