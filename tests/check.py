"""Run queries on Spark and DuckDB and compare whole results."""

from __future__ import annotations

import datetime as dt
import glob
import os

import duckdb

TYPES = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double",
         "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def _rows(rows, order):
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    relation = con.sql(sql)
    want_types = {c: TYPES.get(str(t), str(t)) for c, t in zip(relation.columns, relation.types)}
    got_types = dict(spark_df.dtypes)
    if want_types != got_types:
        odd = {c: (got_types.get(c), want_types.get(c)) for c in {*got_types, *want_types}
               if got_types.get(c) != want_types.get(c)}
        return f"types differ (spark, duckdb): {odd}"
    names = sorted(got_types)
    got = _rows(spark_df.collect(), [spark_df.columns.index(c) for c in names])
    want = _rows(relation.fetchall(), [relation.columns.index(c) for c in names])
    if got == want:
        return None
    extra = [r for r in got if r not in set(want)][:3]
    missing = [r for r in want if r not in set(got)][:3]
    return f"rows {len(got)} vs {len(want)}; only spark {extra}; only duckdb {missing}"
