import promoscan as ps
from tests.helpers import scans, tuples

DAY = "2025-09-20 10:00:00"
ROWS = [
    (1, DAY, "7", "0"),
    (1, DAY, "7", "1"),
    (2, DAY, "8", "1"),
    (3, DAY, None, "0"),
    (4, DAY, "7", "0"),
    (None, DAY, "9", "0"),
]


def test_totals(spark):
    df = scans(spark, ROWS)
    assert tuples(ps.kpi_summary(df, "customer_id")) == [(6, 4, 6, 5, 2, 3)]
    row = ps.kpi_summary(df, None).first()
    assert "unique_users" not in row and row.total_events == 6
    rates = ps.kpi_rates(df).first()
    assert (rates.win_rate, rates.real_share, rates.received_rate, rates.pending_rate) == (1, 5 / 6, 0.4, 0.6)


def test_rates_without_rows(spark):
    assert tuples(ps.kpi_rates(scans(spark, ROWS).limit(0))) == [(0.0, 0.0, 0.0, 0.0)]


def test_user_counts_keep_users_with_nothing_pending(spark):
    row = ps.user_kpis(scans(spark, ROWS), "customer_id").first()
    assert row.users_won_any == 4
    assert row.users_received_any == 3  # 1, 2 and the points of 3
    assert row.users_pending_real == 2  # 1 and 4
    assert row.users_pending_but_ever_received_real == 2  # 1 and 2, although 2 waits for nothing
    assert row.users_pending_and_received_real == 1


def test_pending_users(spark):
    users = ps.pending_users(scans(spark, ROWS), "customer_id")
    assert sorted(tuples(users)) == [(1, 1, 1, True), (2, 0, 1, True), (4, 1, 0, False)]
    assert tuples(ps.top_pending_users(users, "customer_id", 2), "customer_id") == [(1,), (4,)]


def test_pending_events(spark):
    df = scans(spark, ROWS)
    assert ps.pending_events(df).count() == ps.pending_events_count(df).first()[0] == 3
    assert tuples(ps.consistency_check(df, "customer_id", "all")) == [(3, 2, "customer_id", "all", False)]


def test_every_scanned_row_is_a_win(spark):
    row = ps.kpi_summary(ps.drop_unscanned(scans(spark, ROWS + [(9, None, None, "0")])), "customer_id").first()
    assert row.wins_total == row.total_events == 6


def test_hours_and_weekdays(spark):
    # 20:30 UTC on a Sunday is half past midnight on Monday in Yerevan.
    df = scans(spark, [(1, "2025-09-14 20:30:00", None, "0"), (1, "2025-09-15 12:00:00", None, "0")])
    assert tuples(ps.hourly_counts(df, "Asia/Yerevan")) == [(0, 1), (16, 1)]
    assert tuples(ps.dow_hour_counts(df, "Asia/Yerevan")) == [(0, 0, 1), (0, 16, 1)]
    assert tuples(ps.dow_hour_counts(df, "UTC")) == [(0, 12, 1), (6, 20, 1)]


def test_prize_odds(spark):
    df = scans(spark, ROWS)
    odds = ps.prize_probabilities(df)
    got = tuples(odds)
    assert [r[0] for r in got] == ["7", "8", "9"]  # most won first, then by id
    assert got[0] == ("7", 3, 1, 0.5, 0.6, 1 / 3)
    assert abs(sum(r[4] for r in got) - 1) < 1e-12
    assert ps.prize_probabilities_pct(odds).first()["received_share_in_prize"] == 33.333
    points = df.where("is_point_win")
    assert tuples(ps.prize_probabilities(points)) == []


def test_prize_efficiency(spark):
    got = tuples(ps.prize_efficiency(scans(spark, ROWS)))
    assert [(r[0], r[1], r[2], round(r[3], 6)) for r in got] == [
        ("7", 3, 1, 0.666667), ("8", 1, 1, 0.0), ("9", 1, 0, 1.0),
    ]
