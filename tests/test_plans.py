"""What the plans must and must not contain."""

import re

import promoscan as ps
from promoscan.functions.skew import hot_keys
from registry.adapters import ORDERS, table
from registry.queries import QUERIES

U = "customer_id"


def initial_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return initial_plan(df).split("== Initial Plan ==")[0]


def test_single_task_windows_only_over_bounded_buckets(spark, sf_dir):
    alone = set()
    for name, query in QUERIES.items():
        for window in re.findall(r"Window \[.*", initial_plan(query(spark, sf_dir))):
            lists = re.findall(r", \[([^\]]*)\]", window[window.rindex(" AS ") :])
            if not any("ASC" not in columns and "DESC" not in columns for columns in lists):
                alone.add(name)
    # These run over the buckets of the exact quantiles.
    assert alone == {"claim_stats", "claim_stats_events", "span_stats", "span_stats_price"}


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnsRenamed({"ts": "win_date", "user_id": U})
    frames = ps.dashboard_frames(events, ps.ScanParams(start="2024-01-05 00:00:00", hi="2024-01-20 00:00:00"))
    plan = initial_plan(ps.kpi_summary(frames.metrics, U))
    assert "GreaterThanOrEqual(win_date" in plan.replace("ts,", "win_date,") and "LessThanOrEqual(" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan
    assert "props" not in plan


def test_user_id_filter_reaches_the_scan(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("ts", "win_date")
    plan = initial_plan(ps.user_history(ps.normalize(events), "user_id", 7))
    assert "EqualTo(user_id,7)" in plan


def test_unused_segment_costs_nothing(spark, sf_dir):
    frames = ORDERS.frames(spark, sf_dir, with_segments=True)
    plan = final_plan(frames.scans.select("scan_id", "win_date"))
    assert "Exchange" not in plan.replace("BroadcastExchange", "")


def test_users_of_any_size_take_one_path(spark, sf_dir):
    scans = ps.to_local(ps.normalize(ORDERS.scans(spark, sf_dir)))
    for df in (ps.user_activity(scans, U), ps.scan_gaps(scans, U)):
        plan = final_plan(df)
        assert plan.count("FileScan") == 1
        assert not any(x in plan for x in ("Union", "Join", "percentile(", "median("))


def test_hot_key_list_is_limited(spark):
    counts = spark.range(100).selectExpr("id AS k", "id AS n")
    assert [r.k for r in hot_keys(counts, "k", "n", hot_rows=90, limit=3).collect()] == [99, 98, 97]


def test_cohorts_shuffle_distinct_user_weeks(spark, sf_dir):
    scans = ps.normalize(ORDERS.scans(spark, sf_dir))
    plan = initial_plan(ps.cohort_counts(scans, U))
    assert "Join" not in plan
    first_exchange = plan.rindex("Exchange hashpartitioning")
    assert "HashAggregate" in plan[first_exchange:]


def test_lapsed_filters_customers_before_the_join(spark, sf_dir):
    plan = initial_plan(QUERIES["lapsed_prize_customers"](spark, sf_dir))
    join = plan.index("HashJoin") if "HashJoin" in plan else plan.index("MergeJoin")
    scans_side = plan[join : plan.index("o_orderkey", join)]
    assert "HashAggregate(keys=[customer_id" in scans_side and "Filter (isnotnull(" in scans_side
