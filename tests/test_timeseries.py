import datetime as dt

import promoscan as ps
from tests.helpers import scans, series, tuples

D = dt.date


def test_buckets_are_local(spark):
    df = scans(spark, [(1, "2025-08-31 21:00:00", None, "0")], "Asia/Yerevan")
    for granularity, want in (("Day", D(2025, 9, 1)), ("Week", D(2025, 9, 1)), ("Month", D(2025, 9, 1))):
        assert ps.time_bucket(df, "win_local", granularity).first()["date"] == want
    assert ps.count_by_time(df, "Day", "UTC").first()["date"] == D(2025, 8, 31)


def test_weeks_start_on_monday(spark):
    days = ["2025-09-14", "2025-09-15", "2025-09-21"]
    df = scans(spark, [(1, d, None, "0") for d in days])
    assert sorted(tuples(ps.count_by_time(df, "Week", "UTC"))) == [(D(2025, 9, 8), 1), (D(2025, 9, 15), 2)]


def test_gaps_are_zero(spark):
    df = scans(spark, [(1, "2025-09-15", None, "0"), (2, "2025-09-18", None, "0")])
    got = tuples(ps.aggregate_time(df, "Day", False, "UTC"))
    assert got == [(D(2025, 9, 15), 1), (D(2025, 9, 16), 0), (D(2025, 9, 17), 0), (D(2025, 9, 18), 1)]
    months = scans(spark, [(1, "2024-11-30", None, "0"), (2, "2025-02-01", None, "0")])
    assert [r[1] for r in tuples(ps.aggregate_time(months, "Month", False, "UTC"))] == [1, 0, 0, 1]


def test_unique_mode_trims(spark):
    rows = [(None, "2025-09-14"), (None, "2025-09-15"), (1, "2025-09-16"), (1, "2025-09-16"), (None, "2025-09-17"), (None, "2025-09-18")]
    df = scans(spark, [(u, d, None, "0") for u, d in rows])
    # Both leading zeros go, but only one trailing zero.
    got = tuples(ps.aggregate_time(df, "Day", True, "UTC", "customer_id"))
    assert got == [(D(2025, 9, 16), 1), (D(2025, 9, 17), 0)]
    nobody = scans(spark, [(None, "2025-09-14", None, "0"), (None, "2025-09-15", None, "0")])
    assert tuples(ps.aggregate_time(nobody, "Day", True, "UTC", "customer_id")) == [(D(2025, 9, 14), 0)]
    one = scans(spark, [(None, "2025-09-14", None, "0")])
    assert tuples(ps.aggregate_time(one, "Day", True, "UTC", "customer_id")) == []


def test_unique_mode_without_user_column_counts_events(spark):
    df = scans(spark, [(None, "2025-09-14", None, "0")] * 2)
    assert tuples(ps.aggregate_time(df, "Day", True, "UTC", None)) == [(D(2025, 9, 14), 2)]


def test_single_steps(spark):
    s = series(spark, [("2025-09-01", 0), ("2025-09-02", 0), ("2025-09-04", 3), ("2025-09-05", 0), ("2025-09-06", 0)])
    counts = lambda df: [r[1] for r in tuples(df)]
    assert counts(ps.fill_time_gaps(s, "Day")) == [0, 0, 0, 3, 0, 0]
    assert counts(ps.trim_leading_zeros(s)) == [3, 0, 0]
    assert counts(ps.trim_trailing_zero(s)) == [0, 0, 3, 0]
    zeros = series(spark, [("2025-09-01", 0), ("2025-09-02", 0)])
    assert counts(ps.trim_leading_zeros(zeros)) == [0, 0]


def test_series_total_is_row_total(spark):
    rows = [(i % 5, f"2025-09-{1 + i * 7 % 28:02d} {i % 24:02d}:00:00", "7" if i % 3 else None, "0") for i in range(200)]
    df = scans(spark, rows)
    for granularity in ("Day", "Week", "Month"):
        total = sum(r[1] for r in tuples(ps.aggregate_time(df, granularity)))
        assert total == 200
        real = sum(r[1] for r in tuples(ps.real_prize_series(df, granularity)))
        assert real == sum(1 for r in rows if r[2])


def test_export_and_preview(spark):
    s = series(spark, [(f"2025-09-{d:02d}", d) for d in range(1, 21)])
    assert ps.series_export(s).first()["date"] == "2025-09-01 00:00:00"
    got = tuples(ps.series_preview(s, 2, 1))
    assert got == [("head", D(2025, 9, 1), 1), ("head", D(2025, 9, 2), 2), ("tail", D(2025, 9, 20), 20)]


def test_approximate_users(spark):
    df = scans(spark, [(u, "2025-09-15", None, "0") for u in range(50)])
    n = ps.users_by_time(df, "Day", "UTC", "customer_id", approximate=True).first()["count"]
    assert 45 <= n <= 55
