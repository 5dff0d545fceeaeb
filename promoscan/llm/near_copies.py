"""Near copies by exact Jaccard similarity of word shingles: SimHash by covering LSH, and prefixes for the rest.

The fingerprint of a set of shingles has the bits that over half of the hashes have. The covering masks of
:mod:`promoscan.llm.simhash_dedup` bring all fingerprints together that differ in ``RADIUS`` bits or
fewer; such pairs are linked if their sets are similar enough. Similar sets may differ in more bits than
any affordable radius, so what these links leave apart is joined through prefixes.

Sets of ``n`` shingles that share ``t`` of their union share at least ``t * n`` of either, so that in
any common order the first ``n - ceil(t * n) + 1`` shingles of both have one in common: no pair is
missed. The order puts shingles that are frequent, by a bounded table of hashed counts, last; the
table decides how many candidates there are, never which pairs are found. Every candidate is verified.

Texts and whole rows of keys never go through a shuffle: keys travel packed (:mod:`promoscan.llm.shared_keys`),
and sets are made where the texts are read, for the rows that a bounded table of ids lets pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoscan.llm.common import discard, field, forget, lean, packed, row_keys, slices, stored
from promoscan.llm.components import components
from promoscan.llm.shared_keys import Keys, is_marked, list_keys, marked, mask_keys, meeting, place_of
from promoscan.llm.simhash_dedup import covering_masks, majority

SHINGLE, SIMILARITY = 5, 0.8
#: Bits by which fingerprints of a candidate pair differ at most (63 tables), and buckets of tables that are compared in pairs.
RADIUS, PRINTS_PAIRED = 5, 8
#: Buckets of more sets are linked through a few of them first; what is left is compared in tiles of so many.
PAIRED, TILE = 16, 512
#: Fewest places of the parities of a set.
LEAST_BITS = 512
#: Bits of the hashed counts, most counts that a task reports, and most that the order uses.
COUNT_BITS, REPORTED, RANKED = 22, 1 << 14, 1 << 16
#: Bits of the table of ids whose sets are made (4 MB); with many more ids than places, more sets are made than needed.
ID_BITS = 25


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words are one shingle, none is empty."""
    import xxhash

    words = text.encode().lower().split() if text else []  # of bytes, lower() changes A-Z alone
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_digest
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.frombuffer(b"".join([digest(s) for s in joined]), np.uint64))


def least_shared(n: int, similarity: float) -> int:
    """How many shingles a set of ``n`` shares at least with a set that is similar enough."""
    return math.ceil(similarity * n - 1e-9)


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _frequent(shingle: int):
    """Per task the places that are counted far more often than the average place."""

    def run(batches):
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(t, shingle) for t in part.column("text").to_pylist()]
                place, n = np.unique(_places(np.concatenate(sets)), return_counts=True)
                counts[place] += n
        mean = counts.mean()
        found = np.flatnonzero(counts > mean + 4 * math.sqrt(mean) + 3)
        found = found[np.argsort(-counts[found], kind="stable")[:REPORTED]]
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["place", "n"])

    return run


def _prefixes(shingle: int, similarity: float, places: np.ndarray, weights: np.ndarray):
    """(k, two hashes of the set, its size, its fingerprint, its prefix in the common order, its sign and parities) per row."""

    def run(batches):
        import xxhash

        for batch in batches:
            for part in slices(batch, "text"):
                first, second, sizes, prints, prefixes, signs, forms = [], [], [], [], [], [], []
                for text in part.column("text").to_pylist():
                    found = shingle_set(text, shingle)
                    both = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
                    first.append(both[0])
                    second.append(both[1])
                    n = len(found)
                    sizes.append(n)
                    prints.append(majority(found.tobytes()))
                    weight = np.zeros(n, np.int64)
                    if len(places):
                        place = _places(found)
                        at = np.minimum(np.searchsorted(places, place), len(places) - 1)
                        weight = np.where(places[at] == place, weights[at], 0)
                    order = np.argsort(weight, kind="stable")
                    prefixes.append(found[order[: n - least_shared(n, similarity) + 1 if n else 0]].view(np.int64))
                    signs.append(sign(found))
                    forms.append(parities(found))
                columns = [part.column("k"), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(sizes, pa.int64())]
                columns += [pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(prefixes, pa.list_(pa.int64())), pa.array(signs, pa.list_(pa.int64())), pa.array(forms, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "h1", "h2", "n", "print", "prefix", "sign", "form"])

    return run


def sign(found: np.ndarray) -> np.ndarray:
    """The parities of a set in ``LEAST_BITS`` places whatever its size, as longs: few enough to travel with rows."""
    return np.frombuffer(parities(found, LEAST_BITS), np.int64)


def parities(found: np.ndarray, bits: int | None = None) -> bytes:
    """Which of a power of two of places, one per shingle at least, hold an odd number of shingles of the set."""
    bits = bits or max(LEAST_BITS, 1 << max(len(found) - 1, 0).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def odd_places(x: bytes, y: bytes) -> int:
    """In how many places two of :func:`parities` differ; sets differ in that many shingles at least.

    The longer is folded to the size of the shorter, as the place is the hash modulo the size.
    """
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    folded = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(folded ^ y).sum())


def _sets(shingle: int, ids: bytes, form: Callable[[np.ndarray], bytes]):
    """(k, size of the set, the set in some ``form``) of the rows whose ids are marked, and maybe of some others."""

    def run(batches):
        for batch in batches:
            wanted = is_marked(ids, batch.column("place").to_numpy(zero_copy_only=False))
            for part in slices(batch.filter(pa.array(wanted)), "text"):
                found = [shingle_set(t, shingle) for t in part.column("text").to_pylist()]
                sizes, forms = pa.array(map(len, found), pa.int64()), pa.array(map(form, found), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("k"), sizes, forms], names=["k", "n", "form"])

    return run


def fine_parities(found: np.ndarray) -> bytes:
    """Parities of eight places a shingle at least: nearly as many of them differ as shingles do, at an eighth to a quarter of the bytes."""
    return parities(found, max(LEAST_BITS, 8 << max(len(found) - 1, 0).bit_length()))


def _kept(keep: Callable[[bytes, bytes, int], bool]):
    """The pairs whose forms x and y, of n shingles together, pass ``keep``; read from the Arrow buffers."""

    def run(batches):
        for batch in batches:
            rows = zip(batch.column("x"), batch.column("y"), batch.column("n").to_pylist(), strict=True)
            good = [keep(x.as_buffer(), y.as_buffer(), n) for x, y, n in rows]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _maybe(similarity: float):
    """False only if the parities prove a pair less similar: it may differ in (1 - t) / (1 + t) of both sizes."""
    share = (1 - similarity) / (1 + similarity)
    return lambda x, y, n: odd_places(x, y) <= share * n + 1e-6


def _similar(similarity: float):
    def keep(x, y, n):
        shared = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
        return shared / (n - shared) >= similarity

    return keep


def _passing(pairs: DataFrame, forms: DataFrame, keep, name: str) -> DataFrame:
    left = forms.select(F.col("k").alias("a"), F.col("form").alias("x"), F.col("n").alias("na"))
    right = forms.select(F.col("k").alias("b"), F.col("form").alias("y"), F.col("n").alias("nb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", (F.col("na") + F.col("nb")).alias("n"))
    return stored(both.mapInArrow(lean(_kept(keep)), "a long, b long"), name)


def _verified(texts: DataFrame, pairs: DataFrame, sets: DataFrame, shingle: int, similarity: float, sift: bool) -> DataFrame:
    """The ``pairs`` (a, b) whose sets are similar enough, by the sets themselves.

    With ``sift``, parities, first a bit or two a shingle and then eight or more, rule out nearly all others before whole sets are moved.
    """
    left = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    if sift:
        pairs, left = left, _passing(left, sets, _maybe(similarity), "near-candidates")
        discard(pairs)

    def forms(form, name: str) -> DataFrame:
        ids = marked(left.select(F.col("a").alias("k")).unionByName(left.select(F.col("b").alias("k"))), ID_BITS)
        placed = texts.select("k", "text", place_of("k", ID_BITS).alias("place"))
        return stored(placed.mapInArrow(lean(_sets(shingle, ids, form)), "k long, n long, form binary"), name)

    if sift and not left.isEmpty():
        fine, pairs = forms(fine_parities, "near-parities"), left
        left = _passing(pairs, fine, _maybe(similarity), "near-closer")
        discard(pairs, fine)
    whole = forms(np.ndarray.tobytes, "near-sets")
    forget(texts.sparkSession)
    links = _spanning(left, whole, similarity)
    discard(left, whole)
    forget(texts.sparkSession)
    return links


def _spanning(pairs: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """Links among ``pairs`` (a, b) that join what all similar ones of them join.

    Pairs that are left here are nearly all similar, and many copies of one text are many more pairs than sets. So each
    set is compared with the smallest of its partners first, and other pairs only if that leaves them apart.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.min("b").alias("b")), "near-least")
    if pairs.count() < least.count():
        discard(least)
        return _passing(pairs, whole, _similar(similarity), "near-links")
    first = least.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = _passing(first, whole, _similar(similarity), "near-links")
    discard(least)
    forget(pairs.sparkSession)
    groups = components(links)
    left, right = (groups.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
    apart = pairs.join(left, "a", "left").join(right, "b", "left").filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    apart = stored(apart.select("a", "b"), "near-apart")
    more = _passing(apart, whole, _similar(similarity), "near-links")
    discard(apart)
    return links.unionByName(more)


def _possible(similarity: float) -> Column:
    """Whether what follows the common shingle in l and r, itself included, is enough to be shared.

    The first shingle in the common order that two sets share has all others behind it, so that similar sets
    pass in the bucket of that one.
    """
    rest = F.least(F.expr("l.n - l.place"), F.expr("r.n - r.place"))
    return rest >= F.expr("l.n + r.n") * F.lit(similarity / (1 + similarity)) - 1e-6


def _close(similarity: float) -> Column:
    """Whether fingerprints are within the radius and sizes leave room for enough shared shingles."""
    sizes = F.least("l.n", "r.n") >= F.greatest("l.n", "r.n") * F.lit(similarity) - 1e-6
    return (F.bit_count(F.expr("l.print ^ r.print")) <= RADIUS) & sizes


def _signs_allow(similarity: float) -> Column:
    """Whether the signs of l and r differ in no more places than similar sets of their sizes do."""
    places = " + ".join(f"bit_count(l.sign[{i}] ^ r.sign[{i}])" for i in range(LEAST_BITS // 64))
    return F.expr(places) <= F.expr("l.n + r.n") * F.lit((1 - similarity) / (1 + similarity)) + 1e-6


def near_links(rows: DataFrame, keys_of: Keys, name: str, texts: DataFrame, sets: DataFrame, possible: Column, paired: int, earlier: DataFrame | None = None, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) that, with ``earlier`` ones, join all similar sets that share a key, maybe via others.

    ``rows`` (k, component, n, and what ``keys_of`` reads) are sets; the number that comes with each key is column ``name`` of rows l and r, which
    ``possible`` reads. ``sets`` (k, n, sign, form) has each set once; links join similar sets alone. In a bucket, sets of different components that ``earlier`` links made are
    compared in pairs. Buckets of over ``paired`` sets are compared with three of theirs first, and then
    only between sets that links leave apart: many copies of one document take no pairs among each other,
    and different documents with a common shingle none that their signs rule out.
    """
    spark = rows.sparkSession
    members = stored(meeting(rows, keys_of, paired, similarity, name == "place").withColumnRenamed("x", name), "near-buckets")
    forget(spark)
    small, large = members.filter(F.col("size") <= paired).select("key", "k", "component", "n", name), members.filter(F.col("size") > paired)

    pairs = small.alias("l").join(small.alias("r"), (F.col("l.key") == F.col("r.key")) & F.expr("l.k < r.k and l.component <> r.component") & possible)
    pairs = pairs.select(F.col("l.k").alias("a"), F.col("r.k").alias("b"))
    stars = large.select("k", F.explode(F.array("m0", "m1", "m2")).alias("m")).filter("k <> m").select(F.col("k").alias("a"), F.col("m").alias("b"))
    links = _verified(texts, pairs.unionByName(stars), sets, shingle, similarity, sift=earlier is not None)
    if large.isEmpty():
        discard(members)
        return links
    groups = components(links if earlier is None else earlier.unionByName(links))
    named = large.select("key", "k", "n", name).join(groups, large["k"] == groups["node"], "left")
    named = stored(named.select("key", "k", "n", name, F.coalesce("component", "k").alias("component")), "near-named")
    ends = [F.min("component").alias("x"), F.max("component").alias("y")]
    mixed = named.groupBy("key").agg(F.count("*").alias("size"), *ends).filter("x < y").select("key", "size")
    open_rows = stored(named.join(mixed, "key").join(sets.select("k", "sign"), "k"), "near-open")
    discard(members, named)
    forget(spark)
    if open_rows.isEmpty():
        return links
    more = _verified(texts, _tiled(open_rows, possible & _signs_allow(similarity)), sets, shingle, similarity, sift=True)
    discard(open_rows)
    return links.unionByName(more)


def _tiled(rows: DataFrame, possible: Column) -> DataFrame:
    """Pairs (a, b) of a bucket in different components; a large bucket is many tiles, each a key of its own."""
    last = F.floor((F.col("size") - 1) / TILE).cast("long")
    part = F.pmod(F.xxhash64("k"), last + 1)
    rows = rows.withColumn("last", last).withColumn("part", part)
    left = rows.withColumn("other", F.explode(F.sequence("part", "last")))
    right = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "part")))
    tile = F.expr("l.key = r.key and l.part = r.other and l.other = r.part")
    met = left.alias("l").join(right.alias("r"), tile & F.expr("(l.part < r.part or l.k < r.k) and l.component <> r.component") & possible)
    return met.select(F.col("l.k").alias("a"), F.col("r.k").alias("b"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that come first in their group, in the order of :func:`common.row_keys`.

    Rows whose sets of word shingles have a Jaccard similarity of ``similarity`` or more are linked, by the
    tables of their fingerprints or else by prefixes; groups are what links join. Text is lower-cased in A-Z and cut into words at ASCII white space.
    Rows without a word form one group. Null and repeated ids are kept apart; an empty table gives
    an empty one.
    """
    keyed = row_keys(packed(docs), field(id_col), field(text_col))
    texts = keyed.select(F.col("_row_key").alias("k"), F.col(field(text_col)).alias("text"))
    counts = texts.mapInArrow(lean(_frequent(shingle)), "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    ranked = sorted((r.place, r.n) for r in counts.orderBy(F.desc("n"), "place").limit(RANKED).collect())
    places, weights = np.array([p for p, _ in ranked], np.int64), np.array([n for _, n in ranked], np.int64)
    kind = "k long, h1 long, h2 long, n long, print long, prefix array<long>, sign array<long>, form binary"
    found = texts.mapInArrow(lean(_prefixes(shingle, similarity, places, weights)), kind)
    # equal sets have equal prefixes: the first row of each stands for them all
    once = [F.any_value(c).alias(c) for c in ("n", "print", "prefix", "sign", "form")]
    sets = stored(found.groupBy("h1", "h2").agg(F.min("k").alias("k"), *once).drop("h1", "h2"), "near-prefixes")
    forget(docs.sparkSession)
    prints = sets.select("k", F.col("k").alias("component"), "n", "print")
    close = near_links(prints, mask_keys("print", covering_masks(RADIUS)), "print", texts, sets, _close(similarity), PRINTS_PAIRED, None, shingle, similarity)
    groups = components(close)
    rest = sets.drop("print").join(groups, sets["k"] == groups["node"], "left").withColumn("component", F.coalesce("component", "k")).drop("node")
    rest = stored(rest, "near-rest")
    discard(sets)
    forget(docs.sparkSession)
    rows = rest.select("k", "component", "n", "prefix")
    links = close.unionByName(near_links(rows, list_keys("prefix"), "place", texts, rest, _possible(similarity), PAIRED, close, shingle, similarity))
    groups = components(links)
    later = groups.filter("node <> component").select(F.col("node").alias("_row_key"))
    firsts = stored(rest.select(F.col("k").alias("_row_key")).join(later, "_row_key", "left_anti"), "near-firsts")
    discard(rest)
    forget(docs.sparkSession)
    return keyed.join(firsts, "_row_key", "left_semi").select("row.*")
