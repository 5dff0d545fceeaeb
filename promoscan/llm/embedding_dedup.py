"""Near-duplicate vectors through spherical-cap filters with a structured random product code.

Unit vectors are rotated at random and cut into two halves, each with its own Gaussian codebook. A
filter is a pair of code words; a vector passes it if the sum of both inner products exceeds a
threshold, a cap of the sphere. List decoding finds all filters a vector passes without trying
each: only code words that can still reach the threshold are paired. Vectors that pass a common
filter and have equal labels are compared in double precision.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promoscan.llm.common import row_keys, stored
from promoscan.llm.components import components
from promoscan.llm.repeats import whole_groups

THRESHOLD = 0.98
#: Filters that a vector passes on average; vectors of a filter on average; vectors compared at once.
PASSED, BUCKET, TILE = 8, 64, 1024
#: Filters that a vector passes at least; its own threshold falls until it does.
LEAST = 12
SEED = 20


def codebooks(dim: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The two codebooks over all ``dim`` coordinates, rotation included: (words, dim) each."""
    rng = np.random.default_rng([SEED, dim, words])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    half = dim // 2
    first = rng.standard_normal((words, half)) @ rotation[:half]
    second = rng.standard_normal((words, dim - half)) @ rotation[half:]
    return first, second


def passed_filters(unit: np.ndarray, words: int, passed: float = PASSED) -> list[np.ndarray]:
    """For each row of ``unit`` the numbers of the filters it passes, its ``LEAST`` best ones at least."""
    first, second = codebooks(unit.shape[1], words)
    level = NormalDist().inv_cdf(1 - min(passed / words**2, 0.5))
    out, top = [], min(LEAST, words)
    for low in range(0, len(unit), 512):
        ones, twos = unit[low : low + 512] @ first.T, unit[low : low + 512] @ second.T
        for a, b in zip(ones, twos, strict=True):
            sums = np.add.outer(np.partition(a, -top)[-top:], np.partition(b, -top)[-top:])
            t = min(level, np.partition(sums, -top, axis=None)[-top] - 1e-9)
            i, j = np.flatnonzero(a >= t - b.max()), np.flatnonzero(b >= t - a.max())
            x, y = np.nonzero(a[i, None] + b[None, j] >= t)
            out.append(i[x] * words + j[y])
    return out


def code_words(n: int) -> int:
    """Words of each codebook, so that filters keep ``BUCKET`` of n vectors on average."""
    return max(4, math.ceil(math.sqrt(n * PASSED / BUCKET)))


def _vectors(batch, name="vec") -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: row numbers and unit vectors in double precision."""
    vec = batch.column(name)
    vec = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
    size = np.diff(vec.offsets.to_numpy())
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(size) - size
    out = {}
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        x = flat[start[at][:, None] + np.arange(dim)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out[int(dim)] = at, x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def _decode(words: int):
    def run(batches):
        for batch in batches:
            lists: list = [None] * batch.num_rows
            for dim, (at, unit) in _vectors(batch).items():
                for row, filters in zip(at, passed_filters(unit, words) if dim > 1 else [np.zeros(1, np.int64)] * len(at), strict=True):
                    lists[row] = filters
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lists, pa.list_(pa.int64()))], names=[*batch.schema.names, "filters"]
            )

    return run


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index that each row reaches in a symmetric boolean matrix with a true diagonal."""
    label = np.arange(len(linked))
    while True:
        lower = np.where(linked, label[None, :], len(label)).min(axis=1)
        if (lower == label).all():
            return label
        label = lower


def _compare(threshold: float):
    schema = pa.schema([("k", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches):
        for table, _ in whole_groups(batches, 1 << 13):
            route = table.column("route").to_numpy()
            bounds = [0, *(np.flatnonzero(route[1:] != route[:-1]) + 1).tolist(), len(route)]
            for low, high in zip(bounds, bounds[1:], strict=False):
                if high - low > 1:
                    found = _tile(table.slice(low, high - low), threshold)
                    if found is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], schema=schema)

    return run


def _tile(tile: pa.Table, threshold: float):
    """Links within a tile, each counted in the smallest filter that both vectors pass."""
    ((_, unit),) = _vectors(tile).values()
    k, copies, side = (tile.column(n).to_numpy() for n in ("k", "copies", "side"))
    this = tile.column("filter")[0].as_py()
    close = unit @ unit.T >= threshold
    np.fill_diagonal(close, False)
    if side.any():
        # two chunks of one filter meet here; pairs inside a chunk are counted where it meets itself
        close &= side[:, None] != side[None, :]
    if not close.any():
        return None
    busy = np.flatnonzero(close.any(axis=1))
    close, k, copies = close[np.ix_(busy, busy)], k[busy], copies[busy]
    lists = [np.asarray(x) for x in tile.column("filters").take(pa.array(busy)).to_pylist()]
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    values = np.concatenate(lists)
    rows, values = rows[values < this], values[values < this]
    counted = close.copy()
    if len(values):
        names, column = np.unique(values, return_inverse=True)
        member = np.zeros((len(busy), len(names)), np.float32)
        member[rows, column] = 1
        counted = close & (member @ member.T == 0)
    np.fill_diagonal(close, True)
    root = _roots(close)
    return k, counted @ copies, k[root]


def embedding_dedup(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """(id, ``n_links``, ``component_id``, ``kept``) of every row of ``vectors``.

    Two vectors are linked if their labels are equal and not null, their lengths are equal and
    their cosine is at least ``threshold``; the filters find such pairs with a probability that the
    tests and the README measure, and never link others. Vectors that are null, empty or zero, or
    hold nulls or non-finite numbers, are linked with nothing. ``n_links`` counts linked vectors;
    equal vectors are compared once and counted as often as they occur. ``component_id`` is the
    smallest id reachable and ``kept`` tells whether it is the row's own. Rows of equal or null id
    are numbered by :func:`common.row_keys`, and results carry that number as id. An empty table
    gives an empty one; other columns are ignored. Filters with over ``TILE`` vectors are compared
    chunk by chunk in many tasks.
    """
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    keyed = row_keys(vectors.withColumn("_tie", F.hash(vector_col)), id_col, "_tie")
    vec = F.col(vector_col)
    kind = vectors.schema[vector_col].dataType.simpleString()
    usable = F.coalesce(
        label.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists(vec, lambda x: x != 0),
        F.lit(False),
    )
    rows = keyed.select(F.col("_row_key").alias("k"), label.alias("label"), vec.alias("vec"), usable.alias("usable"))
    rows = stored(rows.withColumn("h", F.xxhash64("label", "vec")), "vectors")
    usable = rows.filter("usable")
    classes = stored(usable.groupBy("h", "label", "vec").agg(F.min("k").alias("class"), F.count("*").alias("copies")), "classes")
    words = code_words(classes.count())

    decoded = classes.select(F.col("class").alias("k"), "label", "vec", "copies").mapInArrow(
        _decode(words), f"k long, label string, vec {kind}, copies long, filters array<long>"
    )
    decoded = stored(decoded, "filters")
    passed = decoded.select("*", F.explode("filters").alias("filter"), F.size("vec").alias("dim"))
    by = ["label", "dim", "filter"]
    sizes = stored(passed.groupBy(*by).count().filter("count > 1"), "filter-sizes")
    n_chunks = F.ceil(F.col("count") / TILE)
    dealt = passed.join(sizes, by).withColumn("chunks", n_chunks).withColumn("chunk", F.pmod(F.xxhash64("k"), "chunks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    tiles = dealt.select(
        F.xxhash64(*by, low, high).alias("route"), F.lit(0).alias("g"), "k", "copies", "vec", "filters", "filter",
        F.when(low == high, 0).when(F.col("chunk") == low, 1).otherwise(2).alias("side"),
    )
    found = tiles.repartition("route").sortWithinPartitions("route").mapInArrow(_compare(threshold), "k long, links long, root long")
    found = stored(found, "found")
    groups = components(found.select(F.col("k").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    of_class = (
        classes.join(links.withColumnRenamed("k", "class"), "class", "left")
        .join(groups.withColumnRenamed("node", "class"), "class", "left")
        .select("h", "label", "vec", "class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    )
    of_class = stored(of_class, "class-results")
    linked = usable.join(of_class, ["h", "label", "vec"]).select("k", "n_links", "component_id")
    alone = rows.filter(~F.col("usable")).select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("k").alias(id_col), "n_links", "component_id", (F.col("k") == F.col("component_id")).alias("kept"))
