"""Phrases whose words go together more often than their parts would by chance.

Every word starts one window: the word and the four that follow it in its piece, padded at the end.
Only these longest windows are counted. ROLLUP over their columns then sums the windows of each
shorter prefix, which gives the occurrences of all phrases of one to five words at once.

A phrase counts only from ``least`` occurrences on, and so does each of its parts. Hashed counts, in a
table that grows with the texts up to a fixed size, bound the occurrences of a phrase from above; windows are padded where the
bound is too low, and equal short windows combine. That saves rows and never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promoscan.llm.anchors import mix
from promoscan.llm.common import forget, lean, slices, stored

LONGEST, LEAST, TOP = 5, 100, 2000
UNKNOWN = "und"
#: Hashed counters of the sieve, fewest and most; those that travel in one row, and how many counters a word takes for each of ``least`` occurrences.
SIEVE_BITS, MOST_BITS, ROW_BITS, SPACE = 24, 28, 16, 4
#: Places that a task counts at once.
COUNTED = 1 << 22
#: Parts of a language that are ranked apart first.
PARTS = 256
CHUNK = 1 << 21
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
# Characters that end a piece; each becomes a full stop, which no word can hold.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + _ENDS, bytes(range(97, 123)) + b"." * len(_ENDS))


def tokens_of(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text, lower-cased in A-Z, with a full stop between pieces; long texts in chunks of whole pieces."""
    raw = text.encode().translate(_PLAIN) if text else b""
    start = 0
    while start < len(raw):
        cut = raw.find(b".", start + CHUNK)
        stop = len(raw) if cut < 0 else cut + 1
        yield raw[start:stop].replace(b".", b" . ").split()
        start = stop


def _chunks(batches) -> Iterator[tuple[list[bytes], list[str], np.ndarray]]:
    """(tokens, languages, which language each token is of): a chunk of texts at a time; texts end in a full stop."""
    for batch in batches:
        for part in slices(batch, "text", CHUNK):
            tokens: list[bytes] = []
            langs: dict[str, int] = {}
            owner, sizes = [], []
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                for some in tokens_of(text):
                    tokens += some
                    tokens.append(b".")
                    owner.append(langs.setdefault(lang, len(langs)))
                    sizes.append(len(some) + 1)
                    if len(tokens) > CHUNK:
                        yield tokens, list(langs), np.repeat(owner, sizes)
                        tokens, owner, sizes = [], [], []
            if tokens:
                yield tokens, list(langs), np.repeat(owner, sizes)


def _places(tokens: list[bytes], langs: list[str], owner: np.ndarray, longest: int, bits: int, pairs: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For phrases of 2, 3, ... words: where one starts, and its place in the sieve; with ``pairs``, a sieve, those alone whose pairs of words pass."""
    import xxhash

    from promoscan.llm.repeats import word_hashes

    words = word_hashes(tokens)
    seeds = np.array([xxhash.xxh64_intdigest(lang) for lang in langs], np.uint64)
    stop = np.fromiter(map(b".".__eq__, tokens), bool, len(tokens))
    at = np.flatnonzero(~stop)
    chain = words[at] + seeds[owner[at]]
    for k in range(1, longest):
        # the last token is a full stop, so that at + k stays inside
        go = ~stop[at + k]
        if pairs is not None and k > 1:
            go &= paired[at + k - 1]
        at, chain = at[go], mix(chain[go] * _MULTIPLIER + words[at[go] + k])
        place = (chain >> np.uint64(64 - bits)).astype(np.int64)
        if pairs is not None and k == 1:
            good = _passes(pairs, place)
            at, chain, place = at[good], chain[good], place[good]
            paired = np.zeros(len(tokens), bool)
            paired[at] = True
        yield at, place


def _passes(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (table[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


def _summed(place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place once, in order, with the sum of its counts."""
    order = np.argsort(place, kind="stable")
    place, n = place[order], n[order]
    start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.empty(0, np.int64)
    return place[start], np.add.reduceat(n, start) if len(place) else n


def _rows_of(place: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows (part of the table, the distances of its places and their counts; low bytes first, then high ones)."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    ends = np.flatnonzero(np.diff(place >> ROW_BITS)) + 1
    both = np.stack([place & 65535, np.minimum(n, 65535)]).astype("<u2")
    data = []
    for some in np.split(both, ends, axis=1):
        some = np.stack([np.diff(some[0], prepend=np.uint16(0)), some[1]])
        data.append(press(some.view(np.uint8).reshape(2, -1, 2).transpose(0, 2, 1).tobytes()))
    parts = (place >> ROW_BITS)[np.r_[0, ends]]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(data, pa.binary())], names=["part", "data"])


def _counted(longest: int, bits: int, pairs: bytes | None = None):
    """Rows (part of the table, its places and counts) of one task: of pairs, or with the sieve of ``pairs`` of longer phrases."""

    def run(batches):
        passing = None if pairs is None else np.frombuffer(pairs, np.uint8)
        place, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for chunk in _chunks(batches):
            for k, (_, found) in enumerate(_places(*chunk, longest, bits, passing), 2):
                if (k > 2) == (pairs is not None):
                    found, times = np.unique(found, return_counts=True)
                    place, n = _summed(np.concatenate([place, found]), np.concatenate([n, times]))
            if len(place) > COUNTED:
                yield _rows_of(place, n)
                place, n = place[:0], n[:0]
        if len(place):
            yield _rows_of(place, n)

    return run


def _frequent(least: int):
    """Rows (part of the table, bits of its counters that reach ``least``); a task holds one part at a time."""

    def run(batches):
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress

        def passing(part, sums):
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], names=["part", "bits"])

        last, sums = None, None
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if part != last:
                    if sums is not None:
                        yield passing(last, sums)
                    last, sums = part, np.zeros(1 << ROW_BITS, np.int64)
                steps, counts = np.ascontiguousarray(np.frombuffer(expand(data), np.uint8).reshape(2, 2, -1).transpose(0, 2, 1)).view("<u2")[..., 0]
                sums[np.cumsum(steps, dtype=np.int64)] += counts
        if sums is not None:
            yield passing(last, sums)

    return run


def sieve(texts: DataFrame, longest: int, least: int, bits: int = SIEVE_BITS) -> tuple[bytes, int]:
    """A bit per place of the hashed counts, whether a phrase there can have ``least`` occurrences; and the bits of a place.

    Places have ``bits`` bits, or as many more as the size of the texts asks for, so that rare phrases together
    don't reach ``least``: 28 at most, a table of 32 MB. Pairs of words are counted first, and longer phrases where all
    their pairs pass. Counts of a task stop at 65535; with a larger ``least`` everything passes.
    """
    words = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6
    bits = max(bits, min(MOST_BITS, int(SPACE * words / least).bit_length()))
    table = np.zeros((1 << (bits - ROW_BITS), (1 << ROW_BITS) // 8), np.uint8)
    if least > 65535:
        return np.invert(table).tobytes(), bits
    for pairs in [None, table.tobytes] if longest > 2 else [None]:
        rows = texts.mapInArrow(lean(_counted(2 if pairs is None else longest, bits, pairs and pairs())), "part long, data binary").repartition("part").sortWithinPartitions("part")
        for part, passing in rows.mapInArrow(lean(_frequent(least)), "part long, bits binary").collect():
            table[part] |= np.frombuffer(passing, np.uint8)
    forget(texts.sparkSession)
    return table.tobytes(), bits


def _windows(longest: int, passing: bytes, bits: int):
    """Rows (lang, w1, w2, ..., n): longest windows, padded with nulls; windows of one word are counted."""
    names = ["lang", *[f"w{k + 1}" for k in range(longest)], "n"]

    def run(batches):
        table = np.frombuffer(passing, np.uint8)
        for tokens, langs, owner in _chunks(batches):
            size = len(tokens)
            length = np.zeros(size + longest, np.int64)
            length[:size] = np.fromiter((t != b"." for t in tokens), bool, size)
            for k, (at, place) in enumerate(_places(tokens, langs, owner, longest, bits), 2):
                good = at[_passes(table, place)]
                good = good[length[good] == k - 1]
                length[good] = k
            # the phrase from the next word on has to be frequent, too
            for ahead in range(1, longest):
                length[:size] = np.minimum(length[:size], length[ahead : size + ahead] + ahead)
            length = length[:size]
            words, lang = pa.array(tokens, pa.binary()).cast(pa.string()), pa.array(langs, pa.string())
            at = np.flatnonzero(length > 1)
            if len(at):
                columns = [lang.take(pa.array(owner[at]))]
                for k in range(longest):
                    columns.append(words.take(pa.array(at + k, mask=length[at] <= k)))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.ones(len(at), np.int64))], names=names)
            alone = np.flatnonzero(length == 1)
            for which in np.unique(owner[alone]):
                found = pc.value_counts(words.take(pa.array(alone[owner[alone] == which])))
                count = len(found)
                pads = [pa.nulls(count, pa.string())] * (longest - 1)
                yield pa.RecordBatch.from_arrays([pa.array([langs[which]] * count), found.field(0), *pads, found.field(1).cast(pa.int64())], names=names)

    return run


def phrase_counts(texts: DataFrame, longest: int = LONGEST, least: int = LEAST, sieve_bits: int = SIEVE_BITS) -> DataFrame:
    """(lang, words, f) of every phrase of 1 to ``longest`` words with ``least`` occurrences in (lang, text).

    The row without words has the number of all words of the language.
    """
    columns = [f"w{k + 1}" for k in range(longest)]
    kind = ", ".join(["lang string", *[f"{c} string" for c in columns], "n long"])
    windows = texts.mapInArrow(lean(_windows(longest, *sieve(texts, longest, least, sieve_bits))), kind)
    counted = windows.groupBy("lang", *columns).agg(F.sum("n").alias("n"))
    sums = counted.rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("left_out"))
    words = F.filter(F.array(*columns), lambda w: w.isNotNull())
    # a row stands for a phrase if all columns that are not summed over hold words
    whole = F.lit(False)
    for k in range(1, longest + 1):
        whole = whole | ((F.col("left_out") == (1 << (longest - k)) - 1) & F.col(f"w{k}").isNotNull() & (F.col("f") >= least))
    total = F.col("left_out") == (1 << longest) - 1
    return sums.filter(whole | total).select("lang", words.alias("words"), "f")



def association() -> Column:
    """``floor(1000 * a * n / (l * r))`` of whole numbers, exactly; 38 digits hold the products up to 10**17 words."""
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "anlr"}
    over = (wide["a"] * wide["n"]).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", over, wide["l"] * wide["r"])


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP, sieve_bits: int = SIEVE_BITS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``longest`` words per language.

    Texts are lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line ends, pieces into words at
    spaces and tabs. ``a`` is the number of occurrences within pieces, ``least`` or more, ``n`` that of all
    words of the language. A phrase is cut in two after each word; ``l`` and ``r`` are the occurrences of the parts at the
    cut with the lowest ``floor(1000 * a * n / (l * r))``, the score (the first of equal ones). A phrase
    that is part of a longer one with as many occurrences is left out. Order: score and a descending, phrase in
    UTF-8 order. ``sieve_bits`` (17 or more), and more with large tables, decide how many windows are shuffled, never the result. A null text is empty, a null language ``und``; other columns are ignored. Repeated rows count each
    time. An empty table gives an empty one.
    """
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN))
    counts = stored(phrase_counts(docs.select(lang.alias("lang"), F.col(f"`{text_col}`").alias("text")), longest, least, sieve_bits), "phrases")
    forget(docs.sparkSession)
    totals = counts.filter(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    phrases = counts.filter(F.size("words") > 0)
    found = phrases.filter(F.size("words") > 1).withColumnRenamed("f", "a")

    cut = F.col("cut")
    cuts = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "words", "a", "cut", F.slice("words", F.lit(1), cut).alias("first"), F.slice("words", cut + 1, F.size("words") - cut).alias("rest"))
    cuts = cuts.join(phrases.select("lang", F.col("words").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(phrases.select("lang", F.col("words").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    cuts = cuts.withColumn("score", association())
    lowest = cuts.groupBy("lang", "words").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("m"))

    # a phrase in a longer one that is as frequent lies in such a one with just one word more
    longer = found.filter(F.size("words") > 2)
    inner = F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)")))
    inside = longer.select("lang", inner.alias("words"), "a").groupBy("lang", "words").agg(F.max("a").alias("longer"))
    kept = lowest.join(inside, ["lang", "words"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("m.a")))
    kept = kept.select("lang", F.array_join("words", " ").alias("phrase"), "m.*")

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may hold most phrases: the best of each part first, then of what is left
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*best)
    kept = kept.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
