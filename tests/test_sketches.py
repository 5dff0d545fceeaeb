"""Mergeable quantiles: rank error, merging, and slices without numbers."""

import pytest
from pyspark.sql import functions as F

import promoscan as ps
from promoscan.functions.sketches import RANK_ERROR
from tests.helpers import tuples

PROBS = (0.01, 0.25, 0.5, 0.75, 0.99)


@pytest.mark.parametrize("power", [1, 5])
def test_ranks_are_close_after_merging(spark, power):
    n = 200_000
    df = spark.range(n).select((F.col("id") % 37).alias("day"), F.pow(F.col("id").cast("double"), F.lit(power)).alias("x"))
    merged = ps.merged_sketches(ps.quantile_sketches(df, F.col("x"), ["day"]))
    row = ps.sketch_quantiles(merged, PROBS).first()
    assert row.n == n and row.mean == pytest.approx(df.agg(F.avg("x")).first()[0])
    ranks = [q ** (1 / power) / n for q in row.q]
    assert all(abs(rank - p) <= 2 * RANK_ERROR for rank, p in zip(ranks, PROBS, strict=True))


def test_slices(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", float("nan")), ("b", None), ("c", 7.0)]
    df = spark.createDataFrame(rows, "day string, x double")
    sketches = ps.quantile_sketches(df, F.col("x"), ["day"])
    assert sorted(tuples(ps.sketch_quantiles(sketches, (0.0, 1.0)))) == [("a", 2, 2.0, [1.0, 3.0]), ("c", 1, 7.0, [7.0, 7.0])]
    assert tuples(ps.sketch_quantiles(ps.merged_sketches(sketches), (0.0, 1.0)), "n", "q") == [(3, [1.0, 7.0])]
    assert ps.merged_sketches(sketches.limit(0), ["day"]).count() == 0
    none = ps.sketch_quantiles(ps.quantile_sketches(df.limit(0), F.col("x")))
    assert tuples(none, "n", "mean", "q") == [(0, None, None)]
