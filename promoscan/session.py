"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder that ``spark.checkpoint.dir`` names, which all executors share.

    Where that is unset, a temporary folder serves as long as driver and executors are on one machine;
    on a cluster this raises ValueError.
    """
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_dir = _own_dir or tempfile.mkdtemp(prefix="promoscan-")
    return f"{base.rstrip('/')}/promoscan-{name}-{uuid.uuid4().hex}"


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone to UTC, in which stored times are wall clocks."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def build_session(app_name: str = "promoscan", master: str | None = None, **conf) -> SparkSession:
    """Start (or get) a session; cluster settings given outside are left alone."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return use_utc(builder.getOrCreate())
