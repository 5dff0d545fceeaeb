"""SimHash near-duplicates through covering locality-sensitive hashing.

Bits are numbered 1 .. 2^(r+1) - 1 in turn; table t keeps the bits whose number has an odd overlap
with t. Any r bits leave some t that has even overlap with all of their numbers, so a pair that
differs in r bits or fewer agrees in at least one of the 2^(r+1) - 1 tables: no pair is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoscan.llm.common import row_keys, slices, stored
from promoscan.llm.components import components

RADIUS, SHINGLE, SEED, BITS = 2, 3, 42, 64
#: Larger buckets are linked through shared neighbours instead of by pairs.
PAIRED = 64


def covering_masks(radius: int = RADIUS) -> list[int]:
    """Masks of the tables, as unsigned 64-bit integers."""
    numbers = (1 << (radius + 1)) - 1
    return [
        sum(1 << bit for bit in range(BITS) if ((bit % numbers + 1) & t).bit_count() % 2)
        for t in range(1, numbers + 1)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of ``text``; 0 if it has no word."""
    import xxhash

    words = text.encode().lower().split() if text else []  # of bytes, lower() changes A-Z alone
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    digest = xxhash.xxh64_digest
    joined = map(b" ".join, zip(*(words[i : n + i] for i in range(shingle)), strict=True)) if len(words) >= shingle else [b" ".join(words)]
    return majority(b"".join([digest(s, SEED) for s in joined]))


def majority(raw: bytes) -> int:
    """The bits that are set in over half of the 64-bit hashes in ``raw``; 0 if there are none."""
    counts = np.zeros(BITS, np.int64)
    hashes = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    for low in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[low : low + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def table_keys(radius: int) -> list[Column]:
    """What column ``print`` shows in each table: two prints that differ in ``radius`` bits or fewer agree in one."""
    return [F.xxhash64(F.lit(t), F.col("print").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(covering_masks(radius))]


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                prints = [fingerprint(t, shingle) for t in part.column("text").to_pylist()]
                column = pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("k"), column], names=["k", "print"])

    return run


def near_prints(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join every two distinct ``print`` within ``RADIUS`` (2) bits, maybe via others.

    Links never join prints that no chain of close prints joins. In a bucket of up to ``PAIRED``
    prints pairs are compared. Larger buckets emit no pairs: each print is linked
    with its variants of at most one other bit among those that the table ignores. Two prints
    within two bits share a variant, and all prints with a common variant are linked to the
    smallest of them.
    """
    masks = [_signed(m) for m in covering_masks()]
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("print").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    rows = prints.select("print", tables.alias("x")).select("print", "x.t", "x.key")
    sizes = rows.groupBy("t", "key").count().filter("count > 1")
    small = rows.join(sizes.filter(F.col("count") <= PAIRED), ["t", "key"])
    pairs = (
        small.alias("l")
        .join(small.alias("r"), ["t", "key"])
        .filter("l.print < r.print")
        .filter(F.bit_count(F.expr("l.print ^ r.print")) <= RADIUS)
        .select(F.col("l.print").alias("a"), F.col("r.print").alias("b"))
    )
    free = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(BITS) if not m >> b & 1]) for m in covering_masks()])
    large = rows.join(sizes.filter(F.col("count") > PAIRED), ["t", "key"])
    variants = large.select("print", F.explode(F.get(free, F.col("t"))).alias("flip")).select("print", F.expr("print ^ flip").alias("variant")).distinct()
    least = variants.groupBy("variant").agg(F.min("print").alias("a"), F.count("*").alias("n")).filter("n > 1")
    hubs = variants.join(least, "variant").filter("a <> print").select("a", F.col("print").alias("b"))
    return pairs.unionByName(hubs)


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, ``fingerprint`` long, ``component_id``) of every row of ``docs``.

    Text is lower-cased in A-Z and cut into words at ASCII white space; a bit of the fingerprint is
    1 if it is set in over half of the XXH64 hashes (seed 42) of the word shingles, repeats included.
    Fewer words than a shingle count as one shingle; a null text or one without a word gets 0, which
    is linked like any other. Rows whose fingerprints differ in two bits or fewer are linked;
    ``component_id`` is the smallest id reachable (null if the group has only null ids). Repeated rows
    appear as often as they come in. An empty table gives an empty one. Other columns are ignored.
    """
    prints = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("text")).mapInArrow(_fingerprints(shingle), "k long, print long")
    prints = stored(prints, "prints")
    distinct = stored(prints.groupBy("print").agg(F.min("k").alias("least")), "distinct-prints")
    groups = components(near_prints(distinct.select("print")))
    ranked = distinct.join(groups, distinct["print"] == groups["node"], "left").select("print", "least", F.coalesce("component", "print").alias("component"))
    least = ranked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(ranked.join(least, "component").select("print", "component_id"), "named-prints")
    return prints.join(named, "print").select(F.col("k").alias(id_col), F.col("print").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that come first in their group, in the order of :func:`common.row_keys`."""
    keyed = row_keys(docs, id_col, text_col)
    groups = simhash_dedup(keyed, "_row_key", text_col)
    keep = groups.filter(F.col("_row_key") == F.col("component_id")).select("_row_key")
    return keyed.join(keep, "_row_key", "left_semi").drop("_row_key")
