import datetime as dt

import pytest

import promoscan as ps
from promoscan.config import ACTIVE, NOVICE, POWER
from tests.helpers import scans, tuples

DAY = "2025-09-20"


def many(user, n, prize=None):
    return [(user, DAY, prize, "0")] * n


@pytest.mark.parametrize("hot_rows", [None, 0, 3, 5])
def test_segments_are_the_same_with_and_without_heavy_keys(spark, hot_rows):
    rows = many(1, 1) + many(2, 2) + many(3, 5) + many(4, 6) + many(5, 40) + many(None, 8)
    rows += [(2, None, None, "0")]  # an unscanned row counts too
    got = tuples(ps.with_user_segment(scans(spark, rows), "customer_id", hot_rows), "customer_id", "user_segment")
    assert len(got) == len(rows)
    assert set(got) == {(1, NOVICE), (2, ACTIVE), (3, ACTIVE), (4, POWER), (5, POWER), (None, ACTIVE)}


def test_no_user_column(spark):
    df = ps.with_user_segment(scans(spark, many(1, 1)), None)
    assert df.first()["user_segment"] == "Unknown"


def test_empty_lists(spark):
    df = ps.with_user_segment(scans(spark, many(1, 3, "7")), "customer_id")
    assert ps.filter_region(df, ()).count() == 3
    assert ps.filter_prize(df, ()).count() == 3
    assert ps.filter_segment(df, ()).count() == 3
    assert ps.filter_win_type(df, ()).count() == 0
    assert ps.apply_filters(df, ps.ScanParams(win_types=())).count() == 0


def test_prize_filter_compares_text(spark):
    whole = spark.createDataFrame([(3,), (30,), (None,)], "prize_id bigint")
    assert tuples(ps.filter_prize(whole, ("3", "03", "x", "9" * 30))) == [(3,)]
    floats = spark.createDataFrame([(3.0,), (3.5,)], "prize_id double")
    assert tuples(ps.filter_prize(floats, ("3", "3.5"))) == [(3.0,), (3.5,)]
    assert tuples(ps.distinct_values(floats, "prize_id")) == [("3",), ("3.5",)]
    text = spark.createDataFrame([("3",), ("GIFT",)], "prize_id string")
    assert tuples(ps.filter_prize(text, ("GIFT",))) == [("GIFT",)]


def test_received_modes(spark):
    df = scans(spark, [(1, DAY, "7", "1"), (1, DAY, "7", "0"), (1, None, None, None)])
    assert [ps.filter_received(df, m).count() for m in ("all", "received", "not_received")] == [3, 1, 2]
    with pytest.raises(ValueError):
        ps.filter_received(df, "maybe")


def test_range_includes_both_ends_and_start_is_utc(spark):
    days = ["2025-09-14 23:59:59", "2025-09-15", "2025-09-16", "2025-09-17", None]
    df = scans(spark, [(1, d, None, "0") for d in days], "Asia/Yerevan")
    assert ps.filter_start(df, "2025-09-15").count() == 3
    assert ps.filter_range(df, "2025-09-15 00:00:00", "2025-09-16 00:00:00").count() == 2
    assert ps.filter_range(df).count() == 5
    assert tuples(ps.date_extent(df, "2025-09-15 12:00:00")) == [(dt.datetime(2025, 9, 16), dt.datetime(2025, 9, 17))]
    assert tuples(ps.date_extent(df, "2030-01-01")) == [(None, None)]


def test_slice_is_part_of_all(spark):
    df = scans(spark, [(1, f"2025-09-{d}", None, "0") for d in range(10, 30)]).drop("win_local")
    params = ps.ScanParams(start=ps.config.DEFAULT_START, lo="2025-09-18 00:00:00", hi=dt.datetime(2025, 9, 20))
    part, whole = ps.metrics_scope(df, params), ps.metrics_scope(df, params, "all")
    assert (part.count(), whole.count()) == (3, 15)
    assert part.exceptAll(whole).count() == 0
    assert whole.first()["win_local"] - whole.first()["win_date"] == dt.timedelta(hours=4)


def test_null_region_is_a_choice(spark):
    df = spark.createDataFrame([(None, None), (1, None)], "region_id int, win_date string")
    assert tuples(ps.distinct_values(ps.normalize(df), "region_name")) == [("Georgia",), ("nan",)]


def test_picklist(spark):
    df = scans(spark, [(u, DAY, None, "0") for u in (3, 1, 2, 2, None)])
    assert tuples(ps.user_picklist(df, "customer_id")) == [(1,), (2,), (3,)]
    assert ps.user_picklist(spark.range(6000).withColumnRenamed("id", "customer_id"), "customer_id").count() == 6000


def test_start_is_open_by_default(spark):
    raw = spark.createDataFrame([(1, "2001-01-01")], "customer_id int, win_date string")
    assert ps.dashboard_frames(raw, ps.ScanParams()).metrics.count() == 1


def test_absent_columns_and_no_user(spark):
    raw = spark.createDataFrame([("2025-10-01",)], "win_date string")
    frames = ps.dashboard_frames(raw, ps.ScanParams(segments=(NOVICE,)))
    assert frames.user_col is None and frames.filtered.count() == 1
    assert not {"prize_id", "prize_receive_date", "prize_delivery_date"} & set(frames.filtered.columns)
    assert ps.time_to_claim(frames.filtered).count() == 0 and ps.prize_efficiency(frames.filtered).count() == 0
    assert ps.prize_probabilities(frames.metrics).count() == 0 and ps.distinct_values(frames.scans, "prize_id").count() == 0


def test_text_becomes_naive_utc(spark):
    raw = spark.createDataFrame([("2025-10-01T04:00:00+04:00",)], "t string")
    assert str(ps.to_naive_utc(raw, "t").first().t) == "2025-10-01 00:00:00"


def test_segments_are_only_added_on_demand(spark):
    raw = spark.createDataFrame([(1, DAY)], "customer_id int, win_date string")
    assert "user_segment" not in ps.dashboard_frames(raw, ps.ScanParams()).scans.columns
    assert "user_segment" in ps.dashboard_frames(raw, ps.ScanParams(), with_segments=True).scans.columns
    frames = ps.dashboard_frames(raw, ps.ScanParams(segments=(NOVICE,)))
    assert frames.filtered.count() == 1 and frames.user_col == "customer_id"


def test_params_are_checked():
    for bad in ({"received": "x"}, {"scope": "x"}, {"granularity": "Year"}):
        with pytest.raises(ValueError):
            ps.ScanParams(**bad)
