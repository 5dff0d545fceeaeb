"""Which of many hashed keys several sets hold, at a few bytes of shuffle a key.

Most keys belong to one set alone. Grouping rows by key would still send each of them, once to be counted and
once to be joined with the counts. Here a task sorts its keys and packs them by their first bits: differences of
sorted keys, then byte by byte what belongs to each, compressed. One exchange brings the packs of a part of the
keys together, and only rows of keys that sets of different components hold come out as rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promoscan.llm.anchors import mix
from promoscan.llm.common import lean

#: Bits of a key that are compared; keys that agree in these by chance share a bucket, which is no claim that the sets are alike.
KEY_BITS = 40
#: Keys that a task packs at once, and rows of a batch that comes out.
PACKED, BATCH = 1 << 20, 1 << 16
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
COLUMNS = ["k", "component", "n", "x"]
MEETING = "key long, k long, component long, n long, x long, size long, m0 long, m1 long, m2 long"

#: From a batch: the row that each key is of, the keys, and a number ``x`` that goes with each.
Keys = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]


def list_keys(name: str) -> Keys:
    """The members of a column of lists; ``x`` is their place in the list."""

    def keys(batch):
        column = batch.column(name)
        ends = column.offsets.to_numpy().astype(np.int64)
        size = np.diff(ends)
        row = np.repeat(np.arange(len(size)), size)
        found = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].view(np.uint64)
        return row, found, np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], size)

    return keys


def mask_keys(name: str, masks: list[int]) -> Keys:
    """What each mask leaves of a column of longs, apart for each mask; ``x`` is the long itself."""

    def keys(batch):
        value = batch.column(name).to_numpy(zero_copy_only=False).view(np.uint64)
        shown = value[:, None] & np.array(masks, np.uint64)
        salt = mix(np.arange(1, len(masks) + 1, dtype=np.uint64) * _GOLDEN)
        return np.repeat(np.arange(len(value)), len(masks)), (mix(shown + salt) ^ salt).ravel(), np.repeat(value.view(np.int64), len(masks))

    return keys


def _pack(keys: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """Sorted ``keys`` as differences, and whole numbers; of each the first bytes, then the second ones, ..."""
    k, component, *others = columns
    numbers = [np.diff(keys, prepend=np.uint64(0)), k, component - k, *others]
    return b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes() for x in numbers)


def _unpack(raw: bytes) -> list[np.ndarray]:
    table = np.frombuffer(raw, np.uint8).reshape(1 + len(COLUMNS), 8, -1)
    keys, k, component, *others = (np.ascontiguousarray(x.T).view(np.int64).ravel() for x in table)
    return [np.cumsum(keys.view(np.uint64), dtype=np.uint64), k, component + k, *others]


def _dealt(keys_of: Keys, bits: int):
    """Rows (part, pack) of a task: its keys by their first ``bits`` bits."""

    def packs(held):
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        keys, *columns = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(keys)
        keys, columns = keys[order], [x[order] for x in columns]
        at = np.searchsorted(keys >> np.uint64(KEY_BITS - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(at))
        data = [press(_pack(keys[at[i] : at[i + 1]], [x[at[i] : at[i + 1]] for x in columns])) for i in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(data, pa.binary())], names=["part", "data"])

    def run(batches):
        held, count = [], 0
        for batch in batches:
            row, keys, x = keys_of(batch)
            k, component, n = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in COLUMNS[:3])
            held.append((mix(keys * _GOLDEN) >> np.uint64(64 - KEY_BITS), k, component, n, x))
            count += len(row)
            if count >= PACKED:
                yield packs(held)
                count = 0
        if count:
            yield packs(held)

    return run


def _shared(keys: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Of sorted keys the places of those that sets of different components hold."""
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    mixed = np.minimum.reduceat(component, start) < np.maximum.reduceat(component, start)
    return np.flatnonzero(np.repeat(mixed, np.diff(np.r_[start, len(keys)])))


def has_partner(keys: np.ndarray, n: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the sets of sorted ``keys`` have another one in the bucket of a size that leaves room for the similarity.

    ``place`` members of a set of ``n`` come before the key. If no earlier one is shared, two sets share at most
    what is not before it, and have to share t / (1 + t) of their sizes together.
    """
    share = similarity / (1 + similarity)
    bucket = np.cumsum(np.r_[False, keys[1:] != keys[:-1]]) << 32
    sizes = np.sort(bucket + n)
    least, most = np.ceil(similarity * n - 1e-6).astype(np.int64), np.floor((n - place) / share - n + 1e-6).astype(np.int64)
    found = np.searchsorted(sizes, bucket + np.maximum(most, -1), "right") - np.searchsorted(sizes, bucket + least)
    return found > (most >= n)  # least <= n: the set itself is among those found if most allows it


def _met(paired: int, similarity: float, placed: bool):
    """Rows of ``MEETING`` of the keys that sets of different components hold; a task has one part at a time in memory."""

    def members(held):
        columns = [np.concatenate(c) for c in zip(*map(_unpack, held), strict=True)]
        order = np.argsort(columns[0], kind="stable")  # packs are sorted
        columns = [c[order] for c in columns]
        for which in (_shared, lambda keys, _: has_partner(keys, columns[3], columns[4] if placed else 0, similarity), _shared):
            if len(columns[0]):
                at = which(columns[0], columns[2])
                columns = [c[at] for c in columns]
        keys, k = columns[:2]
        if not len(keys):
            return
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[start, len(keys)])
        hubs = [k[start]] * 3
        if size.max() > paired:
            # the smallest, and those of the smallest hash, of each key
            hashes = [k, *(mix(k.view(np.uint64) + np.uint64(i)) for i in (1, 2))]
            hubs = [k[np.lexsort((h, keys))[start]] for h in hashes]
        found = [keys.view(np.int64), *columns[1:], *(np.repeat(c, size) for c in (size, *hubs))]
        for low in range(0, len(keys), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(c[low : low + BATCH], pa.int64()) for c in found], names=[c.split()[0] for c in MEETING.split(", ")])

    def run(batches):
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        part, held = None, []
        for batch in batches:
            for own, data in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                if own != part and held:
                    yield from members(held)
                    held = []
                part = own
                held.append(expand(data.as_buffer()))
        if held:
            yield from members(held)

    return run


def meeting(rows: DataFrame, keys_of: Keys, paired: int, similarity: float, placed: bool) -> DataFrame:
    """Rows (key, k, component, n, x, size, m0, m1, m2) of keys that sets of different components hold.

    ``rows`` has k, component and n, never null, and the column that ``keys_of`` reads; with ``placed`` its ``x`` is
    how many members of the set come before the key. Sets that :func:`has_partner` leaves without one are left out. ``size`` is the number of
    rows of the key; m0 to m2 are three of its k, where that number is above ``paired``.
    """
    bits = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")).bit_length()
    packs = rows.mapInArrow(lean(_dealt(keys_of, bits)), "part long, data binary")
    return packs.repartition("part").sortWithinPartitions("part").mapInArrow(lean(_met(paired, similarity, placed)), MEETING)


def marked(ids: DataFrame, bits: int) -> bytes:
    """A bit for each place of :func:`place_of` that an id of ``ids`` (k) has; ``2**bits`` places whatever the data."""
    at = place_of("k", bits)
    parts = ids.select((at / 32768).cast("long").alias("part"), F.pmod(at, F.lit(32768)).alias("at"))
    table = np.zeros((1 << bits - 15, 4096), np.uint8)
    for part, found in parts.groupBy("part").agg(F.bitmap_construct_agg("at")).collect():
        table[part] = np.frombuffer(found, np.uint8)
    return table.tobytes()


def place_of(name: str, bits: int):
    return F.pmod(F.xxhash64(name), F.lit(1 << bits))


def is_marked(table: bytes, places: np.ndarray) -> np.ndarray:
    """Which of ``places`` have a bit in a table of :func:`marked`; other ids may share a place, so that more than those in it pass."""
    return np.frombuffer(table, np.uint8)[places >> 3] >> (places & 7).astype(np.uint8) & 1 == 1
