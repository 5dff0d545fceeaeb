import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import promoscan as ps
from promoscan.functions.quantiles import exact_quantiles, value_counts
from tests.helpers import scans, tuples

U = "customer_id"


def days(spark, pairs):
    return spark.createDataFrame(pairs, "first_day date, last_day date")


def test_full_weeks_against_counting_days(spark):
    rng = random.Random(3)
    pairs = [(f := dt.date(2025, 1, 1) + dt.timedelta(rng.randrange(30)), f + dt.timedelta(rng.randrange(60))) for _ in range(300)]
    pairs.append((dt.date(2025, 1, 10), dt.date(2025, 1, 1)))

    def count(first, last):
        all_days = {first + dt.timedelta(i) for i in range((last - first).days + 1)}
        return sum(all({d + dt.timedelta(i)} <= all_days for i in range(7)) for d in all_days if d.weekday() == 0)

    got = ps.full_weeks(days(spark, pairs)).collect()
    assert [r.full_weeks for r in got] == [count(*p) for p in pairs]


def test_short_spans(spark):
    pairs = [(dt.date(2025, 9, 15), dt.date(2025, 9, 20)), (dt.date(2025, 9, 15), dt.date(2025, 9, 21))]
    frame = ps.full_weeks(days(spark, pairs)).withColumn("total_scans", F.lit(4).cast("bigint"))
    assert tuples(ps.full_week_rate(frame), "full_weeks", "weekly_rate_full_weeks") == [(0, None), (1, 4.0)]


def test_spans(spark):
    rows = [(1, "2025-09-15 21:00:00", None, "0"), (1, "2025-09-17", None, "0"), (2, "2025-09-22", None, "0"),
            (None, "2025-09-30 22:00:00", None, "0")]
    df = scans(spark, rows, "Asia/Yerevan")
    own = {r[U]: r for r in ps.scan_rates(ps.user_spans(df, U, "own", "Asia/Yerevan")).collect()}
    assert (own[1].first_day, own[1].last_day) == (dt.date(2025, 9, 16), dt.date(2025, 9, 17))
    assert (own[1].span_days, own[1].span_weeks, own[1].daily_rate_span) == (2, 1, 1.0)
    assert (own[2].span_days, own[2].total_scans) == (1, 1)
    # Scans without a user set the end, in local time.
    end = {r[U]: r for r in ps.user_spans(df, U).collect()}
    assert end[1].last_win == dt.datetime(2025, 10, 1)
    assert (end[1].span_days, end[1].span_weeks) == (16, 3)
    assert (end[2].span_days, end[2].span_weeks) == (10, 2)
    with pytest.raises(ValueError):
        ps.user_spans(df, U, "other")


def test_describe(spark):
    counts = [1, 1, 2, 5, 9]
    df = spark.createDataFrame([(c,) for c in counts], "total_scans bigint")
    want = pd.Series(counts).describe()
    got = ps.describe_scans(df).first()
    assert [got["count"], got["min"], got["q25"], got["median"], got["q75"], got["max"]] == list(
        want[["count", "min", "25%", "50%", "75%", "max"]]
    )
    assert got["mean"] == pytest.approx(want["mean"]) and got["std"] == pytest.approx(want["std"])
    one = ps.describe_scans(df.limit(1)).first()
    assert (one["count"], one["std"]) == (1, None)


def test_span_stats(spark):
    df = spark.createDataFrame([("1",), ("2.5",), ("x",), (None,)], "v string")
    assert tuples(ps.span_stats(df, "v")) == [(1.75, 1.375, 1.75, 2.125, 2)]
    assert tuples(ps.span_stats(df.where("v = 'x'"), "v")) == [(0.0, 0.0, 0.0, 0.0, 0)]


def test_rate_stats_without_users(spark):
    df = ps.scan_rates(ps.user_spans(scans(spark, [(None, "2025-09-15", None, "0")]), U))
    assert sorted(tuples(ps.rate_stats(df))) == [("daily", 0.0, 0.0, 0.0, 0.0, 0), ("weekly", 0.0, 0.0, 0.0, 0.0, 0)]


PROBS = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
NUMBERS = st.one_of(
    st.floats(-1e12, 1e12), st.floats(-1e-6, 1e-6), st.sampled_from([0.0, -0.0, 1.0, 1.0 + 1e-12, 1e300, -1e300, 5e-324])
)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(NUMBERS, min_size=1, max_size=40))
def test_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = exact_quantiles(value_counts(df, F.col("x")), PROBS).first()
    assert row.total == len(values)
    want = np.quantile(values, PROBS)
    assert np.allclose(row.q, want, rtol=1e-9, atol=1e-300)


def test_quantiles_by_group(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([rng.lognormvariate(0, 3), -rng.random(), float(rng.randrange(4))])) for g in "abc" for _ in range(500)]
    rows += [("d", 1.0), (None, 2.0), (None, 4.0), ("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in exact_quantiles(value_counts(df, F.col("x"), ["g"]), PROBS, ["g"]).collect()}
    for g in ("a", "b", "c", "d", None):
        values = [x for k, x in rows if k == g and x is not None and x == x]
        assert got[g].total == len(values)
        assert got[g]["mean"] == pytest.approx(np.mean(values))
        assert np.allclose(got[g].q, np.quantile(values, PROBS), rtol=1e-12)


def test_quantiles_of_whole_numbers(spark):
    df = spark.range(1001).withColumn("v", F.col("id") * 3_600_000_123)
    assert exact_quantiles(value_counts(df, F.col("v")), [0.5]).first().q == [500 * 3_600_000_123.0]


def test_quantiles_of_a_narrow_distribution(spark):
    df = spark.range(1_000_000).withColumn("v", 1000 + F.col("id") / 1e7)
    values = value_counts(df, F.col("v"))
    got = exact_quantiles(values, PROBS).first()
    assert np.allclose(got.q, np.quantile(1000 + np.arange(1_000_000) / 1e7, PROBS), rtol=1e-13)
    df = spark.range(200_000).withColumn("v", F.lit(2**62) + F.col("id") * 3)
    got = exact_quantiles(value_counts(df, F.col("v")), [0.0, 0.5, 1.0]).first()
    assert got.q == [float(2**62), 2**62 + 299_998.5, float(2**62 + 599_997)]


def test_quantiles_near_the_ends_of_bigint(spark):
    df = spark.createDataFrame([(9 * 10**18,), (9 * 10**18,), (-(2**63),), (2**63 - 1,)], "v bigint")
    got = exact_quantiles(value_counts(df, F.col("v")), [0.0, 0.5, 1.0]).first()
    assert got.q == [-(2.0**63), 9e18, 2.0**63] and got["mean"] == pytest.approx(18e18 / 4)


def test_quantiles_with_infinite_values(spark):
    df = spark.createDataFrame([(float("inf"),), (1e308,), (1.7e308,), (-1.7e308,), (0.0,)], "v double")
    assert exact_quantiles(value_counts(df, F.col("v")), [0.0, 0.25, 0.5, 0.75]).first().q[:3] == [-1.7e308, 0.0, 1e308]
