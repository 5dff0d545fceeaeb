import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import promoscan as ps
from promoscan.operators import users
from tests.helpers import scans, tuples

U = "customer_id"
START = dt.datetime(2025, 9, 15)


def random_rows(seed=1, n=600):
    """One user has over half of the rows, several at the same instant and many in a minute."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = rng.choice([1, 1, 1, 1, 1, 2, 3, 4, None])
        offset = dt.timedelta(
            days=rng.choice([0, 0, 1, 40]),
            minutes=rng.choice([0, 1, 59, 60]),
            microseconds=rng.randrange(20) * rng.choice([1, 250_000]),
        )
        rows.append((user, str(START + offset), rng.choice([None, "7"]), "0"))
    return rows + [(9, str(START), "7", "1"), (9, None, "7", "1")]


def brute_force(rows):
    df = pd.DataFrame(rows, columns=[U, "t", "prize", "got"])
    df = df[df.t.notna() & df[U].notna()].assign(t=lambda d: pd.to_datetime(d.t, format="ISO8601"))
    df = df.sort_values([U, "t"]).reset_index(drop=True)
    df["prev"] = df.groupby(U).t.shift(1)
    df["hours"] = (df.t - df.prev).dt.total_seconds() / 3600
    return df


def gaps(rows):
    return sorted((r[0], str(r[1]), str(r[2]), None if r[3] is None else round(r[3], 6)) for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_gaps_and_activity_against_brute_force(spark, seed):
    rows = random_rows(seed)
    df, want = scans(spark, rows), brute_force(rows)
    expected = gaps(
        (int(r[U]), r.t.to_pydatetime(), None if pd.isna(r.prev) else r.prev.to_pydatetime(),
         None if pd.isna(r.hours) else r.hours)
        for _, r in want.iterrows()
    )
    assert gaps(tuples(ps.scan_gaps(df, U))) == expected

    got = {r[U]: r for r in ps.user_activity(df, U).collect()}
    groups = dict(list(want.groupby(U)))
    assert set(got) == set(groups)
    for user, g in groups.items():
        row = got[user]
        assert (row.scans, row.wins_any, row.real_prizes) == (len(g), len(g), g.prize.notna().sum())
        mean, median = (g.hours.mean(), g.hours.median()) if len(g) > 1 else (0, 0)
        assert row.avg_hours_between_scans == pytest.approx(mean, abs=0.00500001)
        assert row.median_hours_between_scans == pytest.approx(median, abs=0.00500001)
        assert row.avg_days_between_scans == pytest.approx(mean / 24, abs=0.00500001)


def test_one_scan_gives_zeros(spark):
    df = scans(spark, [(1, "2025-09-15", None, "0")])
    assert tuples(ps.user_activity(df, U)) == [(1, 1, 1, 0, 0.0, 0.0, 0.0)]
    assert tuples(ps.scan_gaps(df, U)) == [(1, START, None, None)]


def test_activity_order(spark):
    rows = [(u, f"2025-09-{d}", p, "0") for u, d, p in
            [(1, 15, None), (2, 15, None), (2, 16, "7"), (3, 15, None), (3, 16, None), (4, 15, None)]]
    assert [r[0] for r in tuples(ps.user_activity(scans(spark, rows), U))] == [2, 3, 1, 4]


def test_rounding_is_half_even(spark):
    # Gaps of 0.125 and 0.375 hours.
    rows = [(1, "2025-09-15 00:00:00", None, "0"), (1, "2025-09-15 00:07:30", None, "0"),
            (2, "2025-09-15 00:00:00", None, "0"), (2, "2025-09-15 00:22:30", None, "0")]
    got = dict(tuples(ps.user_activity(scans(spark, rows), U), U, "avg_hours_between_scans"))
    assert got == {1: 0.12, 2: 0.38}


def test_long_runs_of_copies_are_spread(spark, monkeypatch):
    monkeypatch.setattr(users, "REPEAT_CHUNK", 7)
    df = scans(spark, [(1, "2025-09-15", None, "0"), (1, "2025-09-16", None, "0")])
    copies = df.withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("x")
    got = ps.scan_gaps(copies, U).groupBy("win_date", "delta_hours").count().collect()
    assert sorted((r.win_date.day, r.delta_hours or 0.0, r["count"]) for r in got if r.delta_hours != 24) == [
        (15, 0.0, 1), (15, 0.0, 49), (16, 0.0, 49),
    ]
    assert sum(r["count"] for r in got) == 100


def test_history(spark):
    rows = [(1, "2025-09-17", "7", "0"), (1, "2025-09-15", None, "0"), (2, "2025-09-16", "7", "1")]
    df = scans(spark, rows)
    history = ps.user_history(df, U, ps.cast_user_id(df, U, " 1 "))
    assert history.columns == [
        U, "region_name", "win_type", "is_win_received", "is_real_prize", "is_point_win", "win_date", "prize_id",
    ]
    assert [r.win_date.day for r in history.collect()] == [15, 17]
    assert ps.user_history(df, U, ps.cast_user_id(df, U, "abc")).count() == 0
    assert ps.user_history(df, U, 2**70).count() == 0
    # The user column may itself be one of the history columns.
    by_prize = ps.user_history(df, "prize_id", "7")
    assert by_prize.columns[0] == "prize_id" and by_prize.columns.count("prize_id") == 1
    assert by_prize.count() == 2


def test_cast_user_id(spark):
    df = spark.createDataFrame([(1, "a")], "n bigint, s string")
    assert ps.cast_user_id(df, "n", "42") == 42
    assert ps.cast_user_id(df, "n", "4x") == "4x"
    assert ps.cast_user_id(df, "s", "42") == "42"
