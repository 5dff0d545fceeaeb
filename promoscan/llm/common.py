"""What the operators share: intermediate tables, row keys, word splitting, batch slicing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_GAP = "[\\x20\\x09-\\x0D]+"
SLICE_BYTES = 1 << 21
_own_dir: str | None = None


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset, a temporary one.

    A temporary folder is only right while driver and executors share one machine, as in tests;
    on a cluster without the setting this raises ValueError.
    """
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dir = base = _own_dir or tempfile.mkdtemp(prefix="promoscan-")
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/promoscan-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stored`, once nothing that is still to be computed reads them."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(table.stored_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Let go of the shuffle files that only ended jobs have read; Spark deletes them once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def packed(df: DataFrame) -> DataFrame:
    """All columns of ``df`` in one struct ``row``, so that no name of theirs can clash with another."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def field(name: str) -> str:
    """The name of a column that :func:`packed` put away."""
    return f"row.`{name}`"


def row_keys(df: DataFrame, id_col: str, tie_col: str, key: str = "_row_key") -> DataFrame:
    """Add a unique, never null long ``key`` that orders rows by ``id_col``.

    Ids that are unique and not null are the key themselves. Otherwise rows are numbered by
    (id, nulls last; ``tie_col``), equal rows in any order, and the numbered table is stored so
    that a recomputation can't renumber them.
    """
    ids = df.groupBy(F.col(id_col).cast("long").alias("_id")).count()
    if ids.filter("count > 1 or _id is null").limit(1).count() == 0:
        # a key that can't be null by its type: joins then add no filter that would change a shared plan
        return df.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")))
    order = [F.col(id_col).asc_nulls_last(), F.col(tie_col).asc_nulls_last()]
    numbered = df.orderBy(*order).withColumn(key, F.monotonically_increasing_id())
    return stored(numbered, "keys")


def words_of(text):
    """Column: words of ``text`` (maximal runs of anything but space and \\t \\n \\v \\f \\r)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def split_words(text: str | None) -> list[bytes]:
    """The same words in Python, in UTF-8; bytes are split at just these characters."""
    return text.encode().split() if text else []


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut ``batch`` so that ``column`` has about ``limit`` bytes in each part, one row at least."""
    if not batch.num_rows:
        return
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a partition; then the freed memory that malloc holds goes back to the system.

    Workers live on after a partition, and what they hold counts beside the executor's JVM and the
    workers of other stages.
    """

    def whole(batches):
        import ctypes

        yield from run(batches)
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
        if trim:
            trim(0)

    return whole


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once per application."""
    import shutil
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="promoscan-code-")  # the driver's own; Spark serves it
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
        _shipped.add(app)
