"""Scans by day on disk, sketches of users, and loads of new files."""

import re

import pytest
from pyspark.sql import functions as F

import promoscan as ps
from tests.helpers import tuples

U = "customer_id"


def days(spark, n=40, per_day=3):
    df = spark.range(n * per_day).selectExpr(
        "id AS scan_id", f"id % 7 AS {U}", f"CASE WHEN id % 11 <> 0 THEN timestampadd(DAY, id % {n}, TIMESTAMP_NTZ'2025-09-01 22:30:00') END AS win_date",
        "CASE WHEN id % 2 = 0 THEN id % 3 END AS prize_id", "id % 4 = 0 AS is_win_received",
    )
    return df


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_read(df):
    """Rows that the file scans of a query gave out."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_date_filters_prune_days(spark, tmp_path):
    path = str(tmp_path / "scans")
    scans = days(spark)
    ps.write_scans_by_day(scans, path)
    params = ps.ScanParams(start="2025-09-10 00:00:00", hi="2025-09-12 12:00:00")
    frames = ps.dashboard_frames(ps.read_scans_by_day(spark, path), params)
    plain = ps.dashboard_frames(scans, params)
    work = frames.work.drop("win_day")
    filters = re.search(r"PartitionFilters: \[(.*?)\]", plan_of(work)).group(1)
    assert "win_day" in filters and "2025-09-10" in filters and "2025-09-12" in filters
    assert sorted(tuples(work)) == sorted(tuples(plain.work)) != []
    # the rows of three days of forty
    assert rows_read(work) <= 9


def test_days_are_replaced_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "scans")
    ps.write_scans_by_day(days(spark, 5), path)
    again = days(spark, 5).where("day(win_date) = 2").withColumn(U, F.lit(99).cast("long"))
    ps.write_scans_by_day(again, path)
    back = ps.read_scans_by_day(spark, path)
    assert back.count() == 15 and back.where("win_date is null").count() == days(spark, 5).where("win_date is null").count()
    assert {r[0] for r in back.where("day(win_date) = 2").select(U).collect()} == {99}
    assert 99 not in {r[0] for r in back.where("day(win_date) <> 2").select(U).collect()}
    with pytest.raises(ValueError, match="parse_dates"):
        ps.write_scans_by_day(back.withColumn("win_date", F.lit("2025-01-01")), path)


def test_a_column_of_that_name_that_is_no_day_is_left_alone(spark):
    df = days(spark, 3).withColumn("win_day", F.lit("x"))
    assert ps.filter_range(df, "2025-09-02 00:00:00", "2025-09-02 23:59:59").count() == ps.filter_range(days(spark, 3), "2025-09-02 00:00:00", "2025-09-02 23:59:59").count() > 0


def test_sketches_stay_within_their_error(spark):
    df = spark.range(60_000).selectExpr(f"hash(id) AS {U}", "timestampadd(HOUR, id % 1000, TIMESTAMP_NTZ'2025-09-01 00:00:00') AS win_date")
    sketches = ps.user_sketches(df, "UTC", U)
    got = {(r.granularity, r.date): r["count"] for r in ps.users_from_sketches(sketches).collect()}
    for granularity in ("Day", "Week", "Month"):
        exact = {(granularity, r.date): r["count"] for r in ps.users_by_time(df, granularity, "UTC", U).collect()}
        assert exact.keys() == {k for k in got if k[0] == granularity}
        assert all(abs(got[k] - n) <= 4 * 1.04 / 64 * n for k, n in exact.items())
    plan = ps.users_from_sketches(sketches)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1


def test_loads_add_up_to_a_full_run(spark, tmp_path):
    store, files = str(tmp_path / "counts"), []
    scans = days(spark)
    assert ps.counts_by_day(ps.stored_counts(spark, store)).count() == 0
    for i in range(3):
        part = scans.where(F.col("scan_id") % 3 == i)
        path = tmp_path / f"part{i}"
        part.coalesce(1).write.parquet(str(path))
        files += [str(f) for f in path.glob("*.parquet")]
        assert len(ps.load_new_files(spark, files, store)) == 1 and ps.load_new_files(spark, files, store) == []
        counts = ps.stored_counts(spark, store)
        whole = ps.dashboard_frames(spark.read.parquet(*files), ps.ScanParams()).metrics
        assert sorted(tuples(ps.counts_by_day(counts))) == sorted(tuples(ps.count_by_time(whole, "Day")))
        names = ["total_events", "real_prizes_total", "real_prizes_received", "real_prizes_pending"]
        assert tuples(ps.kpi_counts(counts)) == tuples(ps.kpi_summary(whole, U), *names)
        want = ps.prize_probabilities(whole).select(F.col("prize_id").cast("string"), "real_prize_count", "received_count")
        assert sorted(tuples(ps.prize_counts(counts))) == sorted(tuples(want))


@pytest.fixture(scope="module")
def by_user(spark, tmp_path_factory):
    scans = days(spark, 40, 60).withColumn(U, F.expr("CASE WHEN scan_id % 3 = 0 THEN 5 WHEN scan_id % 50 = 1 THEN NULL ELSE scan_id % 400 END"))
    scans = ps.normalize(scans)
    return scans, ps.write_scans_by_user(scans, "layout_scans", U, 8, str(tmp_path_factory.mktemp("by-user")), hot_rows=100)


def test_heavy_users_and_rows_without_one_lie_apart(by_user):
    scans, parts = by_user
    assert parts.ordinary.count() + parts.heavy.count() == scans.count()
    assert {r[0] for r in parts.heavy.select(U).distinct().collect()} == {5, None}
    assert parts.ordinary.where(f"{U} = 5 OR {U} IS NULL").count() == 0


def test_buckets_spare_the_shuffle_by_user(by_user):
    scans, parts = by_user
    for operator in (
        lambda d: ps.scans_per_user(d, U),
        lambda d: ps.with_user_segment(d, U, hot_rows=100),
        lambda d: ps.cohort_counts(d, U),
        lambda d: ps.rfm(d, U, "2025-12-01 00:00:00"),
        lambda d: ps.user_activity(d, U),
    ):
        by_key = [[line for line in plan_of(operator(d)).split("\n") if f"hashpartitioning({U}" in line] for d in (scans, parts.ordinary)]
        # what is left deals out the result, a row per user, before it is sorted
        assert any("ENSURE_REQUIREMENTS" in line for line in by_key[0])
        assert all("REBALANCE" in line for line in by_key[1])


def test_results_of_both_parts_are_those_of_all_scans(by_user):
    scans, parts = by_user
    for operator in (lambda d: ps.scans_per_user(d, U), lambda d: ps.with_user_segment(d, U), lambda d: ps.user_activity(d, U)):
        assert sorted(map(repr, tuples(parts.each(operator)))) == sorted(map(repr, tuples(operator(scans))))
    assert sorted(tuples(parts.each(lambda d: ps.rfm(d, U, parts.last_scan())))) == sorted(tuples(ps.rfm(scans, U)))


def test_one_user_is_read_from_one_bucket(by_user):
    scans, parts = by_user
    found = parts.of_user(U, 7)
    assert sorted(tuples(found, "scan_id")) == sorted(tuples(scans.where(f"{U} = 7"), "scan_id")) != []
    one = parts.ordinary.where(f"{U} = 7")
    assert rows_read(one) <= parts.ordinary.count() / 4
