"""Small literal frames."""

from pyspark.sql import functions as F

RAW = "customer_id bigint, win_date string, prize_id string, is_win_received string, region_id string, prize_receive_date string"
NTZ = "timestamp_ntz"


def raw_scans(spark, rows, schema=RAW):
    return spark.createDataFrame(rows, schema)


def scans(spark, rows, zone="UTC"):
    """(user, time text, prize, received) rows, normalised, with ``win_local``."""
    import promoscan as ps

    df = spark.createDataFrame(
        rows, "customer_id bigint, win_date string, prize_id string, is_win_received string"
    )
    return ps.to_local(ps.normalize(df), tz=zone)


def tuples(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def series(spark, rows):
    df = spark.createDataFrame(rows, "date string, count bigint")
    return df.withColumn("date", F.to_date("date"))
