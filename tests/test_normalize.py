import datetime as dt

import pytest
from pyspark.sql import functions as F

import promoscan as ps
from tests.helpers import raw_scans, tuples

T = dt.datetime


def dates(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "win_date string")
    return [r[0] for r in ps.parse_dates(df).collect()]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dates_are_utc_in_any_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = dates(
            spark,
            [
                "2025-09-15 10:00:00",
                "2025-09-16",
                "2025-09-16T01:02:03Z",
                "2025-09-16 01:02:03.123+04:00",
                "2025-09-16 01:02:03 +0400",
                "2025-03-09 02:30:00",
                " 2025-09-16T01:02 ",
            ],
        )
    finally:
        ps.use_utc(spark)
    assert got == [
        T(2025, 9, 15, 10),
        T(2025, 9, 16),
        T(2025, 9, 16, 1, 2, 3),
        T(2025, 9, 15, 21, 2, 3, 123000),
        T(2025, 9, 15, 21, 2, 3),
        T(2025, 3, 9, 2, 30),
        T(2025, 9, 16, 1, 2),
    ]


def test_unreadable_dates_are_null(spark):
    bad = ["16.09.2025", "bad", "", "2025", "2025-13-01", "2025-02-30", "12:00:00", None]
    assert dates(spark, bad) == [None] * len(bad)


def test_dates_of_one_format_do_not_blank_the_others(spark):
    assert None not in dates(spark, ["2025-09-15 10:00:00", "2025-09-16T01:02:03Z", "2025-09-17"])


def test_typed_dates_are_kept(spark):
    df = spark.sql(
        "SELECT TIMESTAMP_NTZ'2025-01-01 10:00:00' win_date, DATE'2025-01-02' created_date,"
        " TIMESTAMP'2025-01-03 10:00:00+04:00' modify_date"
    )
    assert tuples(ps.parse_dates(df)) == [(T(2025, 1, 1, 10), T(2025, 1, 2), T(2025, 1, 3, 6))]


def test_prize_ids(spark):
    texts = ["7", " 7 ", "GIFT ", "", " null ", "None", "NaN", "\t8\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "prize_id string")
    got = [r[0] for r in ps.normalize_prize_id(df).collect()]
    assert got == ["7", "7", "GIFT", None, None, None, None, "8", None]
    numbers = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "prize_id double")
    assert [r[0] for r in ps.normalize_prize_id(numbers).collect()] == [1.0, None, None]


def test_received_words(spark):
    words = ["1", "true", "YES", "y", "T", "0", "false", " true", "1.0", None]
    df = spark.createDataFrame([(w,) for w in words], "is_win_received string")
    assert [r[0] for r in ps.received(df).collect()] == [True] * 5 + [False] * 5


def test_one_blank_flag_leaves_the_other_flags_alone(spark):
    df = spark.createDataFrame([("1",), (None,)], "is_win_received string")
    assert [r[0] for r in ps.received(df).collect()] == [True, False]


def test_regions(spark):
    texts = ["1", "2", "3", "1.0", "4.0", "abroad", "2.5", None]
    df = spark.createDataFrame([(t,) for t in texts], "region_id string")
    want = ["Georgia", "Armenia", "3", "Georgia", "4", "abroad", "2.5", "nan"]
    assert [r[1] for r in ps.region_name(df).collect()] == want
    df = spark.createDataFrame([(1,), (5,), (None,)], "region_id int")
    assert [r[1] for r in ps.region_name(df).collect()] == ["Georgia", "5", "nan"]
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "region_id double")
    assert [r[1] for r in ps.region_name(df).collect()] == ["Georgia", "3", "nan"]
    assert ps.region_name(df.drop("region_id").withColumn("a", F.lit(1))).first()["region_name"] == "Unknown"
    assert ps.region_name(df, {3: "Third"}).collect()[1]["region_name"] == "Third"


def test_flags_and_win_types(spark):
    df = raw_scans(
        spark,
        [
            (1, "2025-09-15", "7", "0", "1", None),
            (1, "2025-09-15", "7", "1", "1", None),
            (1, "2025-09-15", None, "0", "1", None),
            (1, None, "7", "1", "1", None),
            (1, None, None, None, None, None),
        ],
    )
    got = tuples(
        ps.normalize(df),
        "has_win", "is_real_prize", "is_point_win", "win_type", "is_win_received",
        "is_real_prize_received", "is_real_prize_pending",
    )
    assert got == [
        (True, True, False, "real_prize", False, False, True),
        (True, True, False, "real_prize", True, True, False),
        (True, False, True, "points", True, False, False),
        (False, False, False, "no_win", True, False, False),
        (False, False, False, "no_win", False, False, False),
    ]


def test_without_prize_column_nothing_is_a_prize_or_points(spark):
    df = spark.createDataFrame([(1, "2025-09-15")], "user_id bigint, win_date string")
    row = ps.normalize(df).first()
    assert (row.has_win, row.is_real_prize, row.is_point_win, row.win_type) == (True, False, False, "no_win")
    assert (row.is_win_received, row.region_name) == (False, "Unknown")


def test_user_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, "x")], "user_id int, customer_id int, Device_ID int, msisdn string")
    assert ps.user_column(df) == "customer_id"
    assert ps.candidate_user_columns(df) == ["user_id", "customer_id", "Device_ID", "msisdn"]
    assert ps.user_column(df.select("user_id")) == "user_id"
    assert ps.user_column(df.select("msisdn")) is None
    assert ps.candidate_user_columns(df.select(F.lit(1).alias("a"))) == []


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_local_time_and_durations_in_any_session_zone(spark, zone):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2025-09-15 21:30:00' win_date")
    # Summer time ended in this zone after 2011.
    old = spark.sql("SELECT TIMESTAMP_NTZ'2010-07-01 00:00:00' win_date")
    # The hour that Berlin skips does not show in the stored times.
    span = spark.sql(
        "SELECT 1 customer_id, explode(array(TIMESTAMP_NTZ'2025-03-30 00:30:00',"
        " TIMESTAMP_NTZ'2025-03-30 04:00:00.25')) win_date"
    )
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert ps.to_local(df, tz="Asia/Yerevan").first()["win_local"] == T(2025, 9, 16, 1, 30)
        assert ps.to_local(df, tz="UTC").first()["win_local"] == T(2025, 9, 15, 21, 30)
        assert ps.to_local(old, tz="Asia/Yerevan").first()["win_local"] == T(2010, 7, 1, 5)
        hours = ps.scan_gaps(span, "customer_id").agg({"delta_hours": "max"}).first()[0]
        assert hours == pytest.approx(3.5 + 0.25 / 3600)
    finally:
        ps.use_utc(spark)


def test_naive_utc(spark):
    df = spark.sql("SELECT TIMESTAMP'2025-01-01 10:00:00+04:00' a, TIMESTAMP_NTZ'2025-01-01 10:00:00' b")
    assert tuples(ps.to_naive_utc(ps.to_naive_utc(df, "a"), "b")) == [(T(2025, 1, 1, 6), T(2025, 1, 1, 10))]


def test_date_formats_and_epochs(spark):
    df = spark.createDataFrame([("16.09.2025 10:00", 2), (" 2025/09/16 ", -1), ("31.02.2025 10:00", None)], "win_date string, n bigint")
    got = ps.parse_dates(df, formats=("dd.MM.yyyy HH:mm", "yyyy/MM/dd")).collect()
    assert [str(r.win_date) for r in got] == ["2025-09-16 10:00:00", "2025-09-16 00:00:00", "None"]
    for unit, first in {"s": "1970-01-01 00:00:02", "ms": "1970-01-01 00:00:00.002000", "us": "1970-01-01 00:00:00.000002", "ns": "1970-01-01 00:00:00"}.items():
        assert str(ps.parse_dates(df, ["n"], epoch_unit=unit).first().n) == first
    big = spark.createDataFrame([(2**63 - 1,)], "n bigint")
    assert ps.parse_dates(big, ["n"], epoch_unit="s").first().n is None
    assert ps.date_parse_report(df, ["win_date"]).collect() == [("win_date", 3, 3)]
    assert ps.date_parse_report(df.select("n"), ["absent"]).collect() == []
