import datetime as dt

import pytest

import promoscan as ps
from tests.helpers import scans, tuples

CSV = """win_date,prize_id,customer_id,note,is_win_received
2025-09-15 10:00:00,7,1,"a ""quoted"", text",true
2025-09-16,NULL,2,n/a,
,"",3, NA ,1
"""


@pytest.fixture
def csv_path(tmp_path):
    path = tmp_path / "scans.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_columns_follow_the_header(spark, csv_path):
    df = ps.read_scans_csv(spark, csv_path)
    assert dict(df.dtypes) == dict.fromkeys(
        ["win_date", "prize_id", "customer_id", "note", "is_win_received"], "string"
    )
    assert tuples(df) == [
        ("2025-09-15 10:00:00", "7", "1", 'a "quoted", text', "true"),
        ("2025-09-16", None, "2", None, None),
        (None, None, "3", " NA ", "1"),
    ]


def test_csv_to_normalised(spark, csv_path):
    rows = tuples(ps.normalize(ps.read_scans_csv(spark, csv_path)), "win_date", "win_type", "is_win_received")
    assert rows == [
        (dt.datetime(2025, 9, 15, 10), "real_prize", True),
        (dt.datetime(2025, 9, 16), "points", True),
        (None, "no_win", True),
    ]


def test_csv_with_line_breaks(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('a,b\n"x\ny",1\n')
    assert tuples(ps.read_scans_csv(spark, str(path), multiline=True)) == [("x\ny", "1")]


def test_null_tokens_only_in_chosen_text_columns(spark):
    df = spark.createDataFrame([("NA", "NA", 1)], "a string, b string, c int")
    assert tuples(ps.null_tokens(df, ["a", "c"])) == [(None, "NA", 1)]


def test_csv_round_trip(spark, tmp_path):
    df = scans(spark, [(1, "2025-09-15 10:00:00.000001", 'a "b", c', "1"), (None, "2025-09-16", None, "0")])
    cols = ["customer_id", "win_date", "prize_id", "is_win_received"]
    out = str(tmp_path / "out")
    ps.write_csv(df.select(*cols), out)
    back = ps.normalize(ps.read_scans_csv(spark, out))
    want = [tuple(str(v) for v in r) for r in tuples(df, *cols)]
    assert sorted(tuple(str(v) for v in r) for r in tuples(back, *cols)) == sorted(want)


def test_jdbc_options():
    options = ps.jdbc_options("jdbc:postgresql://db/x", "SELECT 1;", {"user": "me"}, one_task=True)
    assert options["query"] == "SELECT 1;" and options["user"] == "me" and "dbtable" not in options
    split = ps.jdbc_options("jdbc:postgresql://db/x", "SELECT 1;", None, "id", (0, 100), 8)
    assert split["dbtable"] == "(SELECT 1) AS scans" and "query" not in split
    assert (split["partitionColumn"], split["numPartitions"]) == ("id", "8")
    with pytest.raises(ValueError):
        ps.jdbc_options("jdbc:postgresql://db/x", "SELECT 1", None, "id")
    with pytest.raises(ValueError, match="one_task"):
        ps.jdbc_options("jdbc:postgresql://db/x", "SELECT 1")


def test_csv_lines(spark):
    rows = [(1, 'a "b", c', None), (2, "", "NA"), (None, " x ", "\\"), (None, None, None)]
    df = spark.createDataFrame(rows, "a int, b string, c string")
    back = ps.scans_from_csv_lines(ps.csv_lines(df), df.columns)
    expected = [("1", 'a "b", c', None), ("2", None, None), (None, " x ", "\\"), (None, None, None)]
    assert [tuple(r) for r in back.collect()] == expected


def test_cache_and_refresh(spark, csv_path):
    df = ps.cache_scans(ps.read_scans_csv(spark, csv_path))
    assert df.count() == 3 and df.is_cached
    ps.refresh(df, csv_path)
    assert not df.is_cached


def test_required_and_optional_columns(spark):
    df = spark.createDataFrame([(1,)], "customer_id int")
    with pytest.raises(ps.MissingColumnError):
        ps.require_columns(df)
    with pytest.raises(ps.MissingColumnError):
        ps.dashboard_frames(df, ps.ScanParams())
    row = ps.optional_columns(df).first()
    assert (row.is_win_received, row.region_name, row.prize_id, row.prize_receive_date) == (
        False, "Unknown", None, None,
    )
