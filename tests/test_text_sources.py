"""Text as it comes: forms of dates, ids, broken lines, raw typing."""

import datetime as dt

import pytest

import promoscan as ps
from promoscan.functions.columns import format_shape
from tests.helpers import tuples


def one(spark, texts, name="win_date"):
    return spark.createDataFrame([(t,) for t in texts], f"{name} string")


def parsed(spark, texts, **how):
    return [None if r[0] is None else str(r[0]) for r in ps.parse_dates(one(spark, texts), **how).collect()]


def test_values_over_twelve_tell_day_and_month_apart(spark):
    assert parsed(spark, ["03.04.2025", "16.04.2025 10:30"], formats="vote") == ["2025-04-03 00:00:00", "2025-04-16 10:30:00"]
    assert parsed(spark, ["03/04/2025", "04/16/2025"], formats="vote") == ["2025-03-04 00:00:00", "2025-04-16 00:00:00"]
    # undecided: the month comes first unless asked otherwise
    assert parsed(spark, ["03.04.2025"], formats="vote") == ["2025-03-04 00:00:00"]
    day = ps.text_profile(one(spark, ["03.04.2025"]), formats=ps.day_first()).formats
    assert parsed(spark, ["03.04.2025"], formats=day) == ["2025-04-03 00:00:00"]


def test_most_values_win_and_the_rest_is_reported(spark):
    texts = ["16.04.2025", "17.04.2025", "04.18.2025", "2025-04-19", "never", None, " "]
    assert parsed(spark, texts, formats="vote") == ["2025-04-16 00:00:00", "2025-04-17 00:00:00", None, "2025-04-19 00:00:00", None, None, None]
    assert tuples(ps.date_parse_report(one(spark, texts), ["win_date"], "vote")) == [("win_date", 5, 2)]
    votes = {r.format: (r.readable, r.chosen) for r in ps.date_votes(one(spark, texts)).collect()}
    assert votes == {"ISO-8601": (1, True), "d.M.yyyy[ H:mm[:ss[.SSSSSS]]]": (2, True), "M.d.yyyy[ H:mm[:ss[.SSSSSS]]]": (1, False)}


def test_columns_vote_apart(spark):
    df = spark.createDataFrame([("16.04.2025", "04/16/2025", 5)], "win_date string, created_date string, modify_date long")
    row = ps.parse_dates(df, formats="vote").first()
    assert row.win_date == row.created_date == dt.datetime(2025, 4, 16) and row.modify_date.year == 1970
    given = ps.parse_dates(df, formats={"win_date": ["dd.MM.yyyy"]}).first()
    assert given.win_date == dt.datetime(2025, 4, 16) and given.created_date is None
    with pytest.raises(ValueError, match="vote"):
        ps.parse_dates(df, formats="dd.MM.yyyy")


def test_numbers_as_dates(spark):
    assert parsed(spark, ["1757930400", "1757930400123", "1757930400123456", "1757930400123456789", "17579"], formats="vote") == [
        "2025-09-15 10:00:00", "2025-09-15 10:00:00.123000", "2025-09-15 10:00:00.123456", "2025-09-15 10:00:00.123456", None,
    ]
    df = spark.createDataFrame([(1.7e18,), (float("nan"),), (float("-inf"),), (None,), (-1500.0,)], "win_date double")
    assert [str(r[0]) for r in ps.parse_dates(df).collect()] == ["2023-11-14 22:13:20", "None", "None", "None", "1969-12-31 23:59:59.999998"]
    exact = spark.sql("SELECT CAST(1757930400.9 AS decimal(20, 1)) AS win_date")
    assert str(ps.parse_dates(exact, epoch_unit="s").first()[0]) == "2025-09-15 10:00:00"


def test_shapes():
    assert format_shape("d.M.yyyy[ H:mm]") == format_shape("M.d.yyyy[ H:mm]") != format_shape("d/M/yyyy[ H:mm]")
    with pytest.raises(ValueError, match="QQ"):
        format_shape("yyyy-QQ")


def test_one_pass_for_ids_and_dates(spark):
    df = spark.createDataFrame([("2", "16.04.2025"), ("2.0", None)], "customer_id string, win_date string")
    profile = ps.text_profile(df)
    assert profile.ids == ("customer_id",) and profile.formats == {"win_date": ("d.M.yyyy[ H:mm[:ss[.SSSSSS]]]",)}
    plan = ps.date_votes(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "Window" not in plan


def test_ids(spark):
    df = spark.createDataFrame(
        [("10", "1", "9223372036854775807", "a"), ("2.0", "x", "9223372036854775808", None), (" 2 ", None, "1", ""), (None, "3", None, None)],
        "customer_id string, prize_id string, Device_ID string, note string",
    )
    typed = ps.typed_ids(df)
    assert dict(typed.dtypes) == {"customer_id": "bigint", "prize_id": "string", "Device_ID": "string", "note": "string"}
    assert tuples(ps.user_picklist(typed, "customer_id")) == [(2,), (10,)]
    assert ps.typed_ids(df.select("note")).columns == ["note"]
    assert ps.cast_user_id(typed, "customer_id", "2") == 2


def test_typed_csv_file(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("customer_id,win_date\n2,16.09.2025\n2.0,2025-09-17\n10,\n")
    scans = ps.read_scans_csv(spark, str(path), typed=True)
    frames = ps.dashboard_frames(scans, ps.ScanParams(date_formats="vote"))
    assert tuples(ps.scans_per_user(frames.metrics, "customer_id").orderBy("customer_id")) == [(2, 2)]


BROKEN = 'a,"b",c\n1,"x, y",z\n1,2\n1,2,3,4\n1,"x,3\n1,2,"open\n,,\nNA,,"q""r"\n\n'
OPEN = [('1,"x,3', "open quote"), ('1,2,"open', "open quote")]


def test_broken_lines_of_a_file(spark, tmp_path):
    for name in ("one.csv", "two.csv"):
        (tmp_path / name).write_text(BROKEN)
    rows, broken = ps.read_scans_csv_checked(spark, str(tmp_path))
    assert sorted(tuples(rows), key=repr) == sorted([("1", "x, y", "z"), (None, None, None), (None, None, 'q"r')] * 2, key=repr)
    assert sorted(tuples(broken)) == sorted([("1,2", "too few fields"), ("1,2,3,4", "too many fields"), *OPEN] * 2)
    assert rows.columns == ["a", "b", "c"]
    # also where few columns or none are asked for
    assert rows.count() == 6 and broken.count() == 8 and rows.select("b").count() == 6
    assert sorted(tuples(broken.groupBy("reason").count())) == [("open quote", 4), ("too few fields", 2), ("too many fields", 2)]


def test_broken_lines_of_a_text_column(spark):
    lines = spark.createDataFrame([(x,) for x in [*BROKEN.split("\n")[1:], None, "  "]], "line string")
    rows, broken = ps.checked_csv_lines(lines, ["a", "_line", "c"])
    assert rows.columns == ["a", "_line", "c"] and rows.count() == 3 and broken.count() == 4


def test_raw_typing_never_throws(spark):
    df = spark.createDataFrame(
        [("1", "2025-01-02", " 7 ", "TRUE", " 2 "), ("2.0", "02.01.2025", "null", "off", "abroad"), ("x", "31.12.2024", None, "1.0", "2.5")],
        "customer_id string, win_date string, prize_id string, is_win_received string, region_id string",
    )
    got = tuples(ps.raw_typed(df))
    assert [r[0] for r in got] == ["1", "2.0", "x"] and [r[1].year for r in got] == [2025, 2025, 2024]
    assert [r[2:] for r in got] == [("7", True, 2), (None, False, None), (None, None, None)]
    typed = spark.sql("SELECT 1 AS customer_id, 2 AS region_id, true AS is_win_received")
    assert ps.raw_typed(typed).dtypes == typed.dtypes


def test_lapsed_with_ids_of_two_kinds(spark):
    scans = spark.createDataFrame([("1", 2, "2025-01-01", "5", "no"), ("z", 2, "2025-01-01", "5", "?")], "customer_id string, region_id int, win_date string, prize_id string, is_win_received string")
    customers = spark.createDataFrame([(1, "p1", "n1")], "id bigint, phone_number string, first_name string")
    got = tuples(ps.lapsed_prize_customers(scans, customers, "2025-03-01"), "customer_id", "phone", "pending_cnt")
    assert got == [("1", "p1", 1), ("z", None, 0)]
    text = customers.withColumn("id", customers.id.cast("string"))
    numbers = scans.where("customer_id = '1'")
    assert tuples(ps.lapsed_prize_customers(numbers, text, "2025-03-01"), "customer_id", "phone") == [(1, "p1")]
