"""The test tables in the shape of scans, as DataFrames and as the same SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promoscan import Frames, ScanParams, dashboard_frames, read_scans_parquet, use_utc

TZ = "Asia/Yerevan"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_scans_parquet(use_utc(spark), f"{sf_dir.rstrip('/')}/{name}.parquet")


_SCANS_FROM_ORDERS = """
SELECT o_orderkey AS scan_id,
       CASE WHEN o_orderkey % 211 = 0 THEN NULL ELSE o_custkey END AS customer_id,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS win_date,
       CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderkey % 7 END AS prize_id,
       o_orderkey % 3 = 0 AS is_win_received,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL
            ELSE {later} END AS prize_receive_date,
       CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE o_custkey % 3 + 1 END AS region_id
FROM {source}"""

_SCANS_FROM_EVENTS = """
SELECT event_id AS scan_id,
       CASE WHEN event_id % 211 = 0 THEN NULL ELSE user_id END AS customer_id,
       CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS win_date,
       CASE WHEN event_type IN ('purchase', 'signup') THEN event_id % 7 END AS prize_id,
       event_id % 3 = 0 AS is_win_received,
       CASE WHEN event_id % 5 = 0 THEN NULL
            ELSE {later} END AS prize_receive_date,
       CASE WHEN user_id % 50 = 0 THEN NULL ELSE user_id % 3 + 1 END AS region_id
FROM {source}"""

# Raw text in the forms a CSV file may hold.
_RAW_FROM_EVENTS = """
SELECT event_id AS scan_id,
       CASE WHEN event_id % 211 = 0 THEN NULL ELSE user_id END AS customer_id,
       CASE event_id % 9
            WHEN 0 THEN '2025-09-15 10:00:00'
            WHEN 1 THEN '2025-09-16'
            WHEN 2 THEN '2025-09-16T01:02:03Z'
            WHEN 3 THEN '2025-09-16 01:02:03.123+04:00'
            WHEN 4 THEN '16.09.2025'
            WHEN 5 THEN 'bad'
            WHEN 6 THEN {iso_z}
            WHEN 7 THEN {iso_offset} END AS win_date,
       CASE event_id % 10
            WHEN 0 THEN '7' WHEN 1 THEN ' 7 ' WHEN 2 THEN 'GIFT ' WHEN 3 THEN ''
            WHEN 4 THEN ' null ' WHEN 5 THEN 'None' WHEN 6 THEN 'NaN' WHEN 7 THEN 'N/A'
            WHEN 8 THEN event_type END AS prize_id,
       CASE event_id % 11
            WHEN 0 THEN '1' WHEN 1 THEN 'true' WHEN 2 THEN 'YES' WHEN 3 THEN 'y'
            WHEN 4 THEN 'T' WHEN 5 THEN '0' WHEN 6 THEN 'false' WHEN 7 THEN ' true'
            WHEN 8 THEN '1.0' WHEN 9 THEN 'NA' END AS is_win_received,
       CASE user_id % 5
            WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 3 THEN 'abroad' END AS region_id
FROM {source}"""

CUSTOMERS_SQL = "SELECT c_custkey AS id, c_name AS phone_number, c_mktsegment AS first_name FROM customer"


@dataclass(frozen=True)
class Adapter:
    source: str
    template: str
    spark_parts: dict[str, str]
    duckdb_parts: dict[str, str]
    start: str
    as_of: str

    def scans(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = self.template.format(source="{rows}", **self.spark_parts)
        return use_utc(spark).sql(sql, rows=table(spark, sf_dir, self.source))

    def params(self, **changes) -> ScanParams:
        return ScanParams(**{"start": self.start, "as_of": self.as_of, "tz": TZ, **changes})

    def frames(self, spark: SparkSession, sf_dir: str, with_segments: bool = False, **changes) -> Frames:
        return dashboard_frames(self.scans(spark, sf_dir), self.params(**changes), with_segments)

    @property
    def sql(self) -> str:
        return self.template.format(source=self.source, **self.duckdb_parts)


ORDERS = Adapter(
    "orders",
    _SCANS_FROM_ORDERS,
    {"later": "timestampadd(HOUR, (o_orderkey * 37) % 1500 - 60, o_orderdate)"},
    {"later": "o_orderdate + to_hours((o_orderkey * 37) % 1500 - 60)"},
    start="1970-01-01 00:00:00",
    as_of="2001-08-01 00:00:00",
)
# The same with a start date that leaves rows out, for the operators of which that is the point.
ORDERS_LATE = replace(ORDERS, start="1996-01-01 00:00:00")
EVENTS = Adapter(
    "events",
    _SCANS_FROM_EVENTS,
    {"later": "timestampadd(HOUR, (event_id * 37) % 1500 - 60, ts)"},
    {"later": "ts + to_hours((event_id * 37) % 1500 - 60)"},
    start="1970-01-01 00:00:00",
    as_of="2024-01-31 00:00:00",
)
RAW = Adapter(
    "events",
    _RAW_FROM_EVENTS,
    {
        "iso_z": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
        "iso_offset": "date_format(ts, \"yyyy-MM-dd HH:mm:ss'-03:30'\")",
    },
    {
        "iso_z": "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')",
        "iso_offset": "strftime(ts, '%Y-%m-%d %H:%M:%S-03:30')",
    },
    start="1970-01-01 00:00:00",
    as_of="2025-10-01 00:00:00",
)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("phone_number"),
        F.col("c_mktsegment").alias("first_name"),
    )


QueryFn = Callable[[SparkSession, str], DataFrame]
