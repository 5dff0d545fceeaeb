"""Every registered query: its plan, its result against DuckDB, and its result over empty tables."""

import importlib

import pytest

from registry.queries import ORACLE, QUERIES
from tests.check import connect, difference

entry = importlib.import_module("__spark_entry__")


ONE_ROW = {
    "date_extent", "kpi_summary", "kpi_rates", "user_kpis", "pending_events_count", "consistency_check",
    "claim_stats", "claim_stats_events", "forgotten_prizes_count", "span_stats", "span_stats_price",
    "describe_scans", "loaded_kpi_counts",
}
TWO_ROWS = {"rate_stats_global", "rate_stats_own", "date_parse_report", "id_profile"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    for name in ("orders", "events", "customer"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{out}/{name}.parquet")
    return str(out)


def test_every_query_has_check_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


SLOW_NODES = ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, empty_dir, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in SLOW_NODES if node in plan]
    assert difference(df, con, ORACLE[name]) is None

    none = QUERIES[name](spark, empty_dir)
    assert none.dtypes == df.dtypes
    assert len(none.collect()) == (1 if name in ONE_ROW else 2 if name in TWO_ROWS else 0)


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
