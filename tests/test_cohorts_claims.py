import datetime as dt

import pytest
from pyspark.sql import functions as F

import promoscan as ps
from promoscan.config import ACTIVE, NOVICE, POWER
from promoscan.operators.claims import nice_step
from tests.helpers import scans, tuples

U = "customer_id"
D = dt.date
ROWS = [
    (1, "2025-09-15", "7", "0"), (1, "2025-09-16", None, "0"), (1, "2025-09-30", None, "0"),
    (2, "2025-09-18", None, "0"), (2, "2025-09-25", None, "0"),
    (3, "2025-09-21 21:00:00", None, "0"),  # already Monday in Yerevan
    (None, "2025-09-01", None, "0"), (4, None, None, "0"),
]


def test_cohorts(spark):
    df = scans(spark, ROWS)
    counts = ps.cohort_counts(df, U, "Asia/Yerevan")
    want = [(D(2025, 9, 15), 0, 2), (D(2025, 9, 15), 1, 1), (D(2025, 9, 15), 2, 1), (D(2025, 9, 22), 0, 1)]
    assert sorted(tuples(counts)) == want
    utc = sorted(tuples(ps.cohort_counts(df, U, "UTC")))
    assert utc[0] == (D(2025, 9, 15), 0, 3)


def test_retention(spark):
    counts = ps.cohort_counts(scans(spark, ROWS), U)
    long = ps.cohort_retention(counts)
    assert long.where("weeks_since_first = 0 AND retention <> 1").count() == 0
    wide = ps.cohort_retention_matrix(counts)
    assert wide.columns == ["cohort_week", "w0", "w1", "w2"]
    assert tuples(wide) == [("2025-09-15", 1.0, 0.5, 0.5), ("2025-09-22", 1.0, None, None)]
    assert ps.cohort_matrix(counts, 3).columns == ["cohort_week", "w0", "w1", "w2", "w3"]
    assert [r.w2 for r in ps.cohort_matrix(counts, 3).collect()] == [r.w2 for r in ps.cohort_matrix(counts).collect()]
    with pytest.raises(Exception, match="max_weeks"):
        ps.cohort_matrix(counts, 1).collect()
    assert ps.cohort_matrix(counts.limit(0)).count() == 0
    with pytest.raises(Exception, match="max_weeks"):
        ps.cohort_matrix(counts, 0).collect()


@pytest.mark.parametrize("hot_rows", [None, 0, 2])
def test_first_scan(spark, hot_rows):
    df = scans(spark, ROWS).drop("win_local")
    got = ps.first_scan(df, U, "UTC", hot_rows)
    assert got.count() == 6
    assert got.where(F.col("first_scan") > F.col("win_local")).count() == 0
    assert got.select(U, "first_scan").distinct().count() == 3


def claims(spark, hours):
    start = dt.datetime(2025, 9, 15)
    rows = [(str(start), "7", "1", None if h is None else str(start + dt.timedelta(hours=h))) for h in hours]
    df = spark.createDataFrame(rows, "win_date string, prize_id string, is_win_received string, prize_receive_date string")
    return ps.time_to_claim(ps.normalize(df))


def test_claims(spark):
    df = claims(spark, [0, 1.5, 10, -1, None])
    assert sorted(r[0] for r in tuples(df, "hours_to_claim")) == [0, 1.5, 10]
    assert tuples(ps.claim_stats(df)) == [(3, 11.5 / 3, 1.5)]
    assert tuples(ps.claim_stats(claims(spark, [None]))) == [(0, None, None)]


def test_histogram(spark):
    # Span 100: 100 / 5 = 20 bins fit, 100 / 2 = 50 do not.
    got = tuples(ps.claim_histogram(claims(spark, [0, 4.9, 5, 99, 100])))
    assert got == [(0.0, 5.0, 2), (5.0, 10.0, 1), (95.0, 100.0, 2)]
    got = tuples(ps.claim_histogram(claims(spark, [3, 8, 12]), step=10))
    assert got == [(0.0, 10.0, 2), (10.0, 20.0, 1)]
    assert sum(r[2] for r in tuples(ps.claim_histogram(claims(spark, [7, 7, 7])))) == 3


@pytest.mark.parametrize("max_bins", [5, 10, 30, 100])
def test_nice_step(spark, max_bins):
    spans = [0.00113 * 1.37**k for k in range(60)]
    df = spark.createDataFrame([(s,) for s in spans], "span double")
    for row in df.select("span", nice_step(F.col("span"), max_bins).alias("step")).collect():
        candidates = [m * 10.0**e for m in (1, 2, 5) for e in range(-9, 9)]
        best = min(c for c in candidates if row.span / c <= max_bins)
        assert row.step == pytest.approx(best)


def test_forgotten(spark):
    rows = [(1, "2025-09-01", "7", "0"), (1, "2025-09-01", "7", "1"), (1, "2025-09-01", None, "0"),
            (1, "2025-09-08", "7", "0"), (1, "2025-09-07 23:59:59", "7", "0")]
    df = scans(spark, rows)
    assert ps.forgotten_prizes(df, "2025-09-15 00:00:00").count() == 2
    assert ps.forgotten_prizes_count(df, dt.datetime(2025, 9, 15), days=30).first()[0] == 0


def test_rfm(spark):
    rows = [(1, "2025-09-01", "7", "0")] + [(2, "2025-09-10", None, "0")] * 5 + [(3, "2025-09-11", None, "0")] * 6
    rows += [(None, "2025-09-12 12:00:00", None, "0")]
    users = ps.rfm(scans(spark, rows), U)
    got = {r[U]: (r.frequency, r.real_prizes, r.recency_days, r.segment) for r in users.collect()}
    # The last scan of all has no user and still sets the end.
    assert got == {1: (1, 1, 11, NOVICE), 2: (5, 0, 2, ACTIVE), 3: (6, 0, 1, POWER)}
    assert tuples(ps.rfm_segment_counts(users)) == [(ACTIVE, 1), (NOVICE, 1), (POWER, 1)]


LAPSED = "customer_id bigint, region_id int, win_date timestamp_ntz, prize_id string, is_win_received boolean"


def lapsed(spark, rows, customers, as_of="2025-10-01 15:00:00"):
    frame = spark.createDataFrame(
        [(u, r, None if t is None else dt.datetime.fromisoformat(t), p, g) for u, r, t, p, g in rows], LAPSED
    )
    people = spark.createDataFrame(customers, "id bigint, phone_number string, first_name string")
    return tuples(ps.lapsed_prize_customers(frame, people, as_of))


def test_lapsed_customers(spark):
    old, new = "2025-09-10", "2025-09-16"
    rows = [
        (1, 2, old, "7", False), (1, 2, old, None, True), (1, 1, new, "7", True),
        (2, 2, old, "7", False), (2, 2, old, "7", True),
        (3, 2, new, "7", False),
        (4, 2, old, "7", None),
        (None, 2, old, "7", False), (None, 2, old, "8", False),
        (5, 2, None, "7", False), (6, 2, old, None, False),
    ]
    got = lapsed(spark, rows, [(1, "p1", "Ann"), (4, None, None)])
    when = dt.datetime(2025, 9, 10)
    assert got == [
        (None, None, None, 2, 2, when),
        (1, "p1", "Ann", 2, 1, when),
        (4, None, None, 1, 0, when),
    ]


def test_lapsed_with_repeated_customer_ids(spark):
    rows = [(1, 2, "2025-09-10", "7", False)] * 2
    got = lapsed(spark, rows, [(1, "a", "Ann"), (1, "a", "Bea"), (1, "b", None)])
    when = dt.datetime(2025, 9, 10)
    assert got == [(1, "a", "Bea", 4, 4, when), (1, "b", None, 2, 2, when)]


def test_lapsed_day_limit_is_exclusive(spark):
    assert lapsed(spark, [(1, 2, "2025-09-16", "7", False)], [(9, "x", "y")]) == []
    assert len(lapsed(spark, [(1, 2, "2025-09-15T23:59:59", "7", False)], [(9, "x", "y")])) == 1
