"""Repeated strings and word windows against brute force."""

import random
import tracemalloc

import numpy as np
import pytest
import xxhash

from promoscan.llm import repeats
from promoscan.llm import substring_dedup as substring_module
from promoscan.llm.anchors import PIECE, RangeHash, anchor_runs, byte_grams, sliding_argmin, symbol_grams
from promoscan.llm.substring_dedup import deep_nodes, substring_dedup
from promoscan.llm.suffix_array_dedup import equal_windows, suffix_array_dedup
from tests.llm.helpers import cut_bytes, cut_words, documents, numbered, odd_documents


def by_bytes(df, **options):
    rows = suffix_array_dedup(df, **options).collect()
    return sorted((str(r.row.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows)


def by_words(df, **options):
    return sorted((str(r.row.doc_id), r.n_words, r.n_removed, r.kept) for r in substring_dedup(df, **options).collect())


def check_bytes(df):
    rows = numbered(df)
    ids, texts = [str(r[0]) for r in rows], [r[1] for r in rows]
    assert by_bytes(df) == sorted((i, *x) for i, x in zip(ids, cut_bytes(texts), strict=True))


def check_words(df):
    rows = numbered(df)
    ids, texts = [str(r[0]) for r in rows], [r[1] for r in rows]
    assert by_words(df) == sorted((i, *x) for i, x in zip(ids, cut_words(texts), strict=True))


def check(df):
    check_bytes(df)
    check_words(df)


def test_documents(spark, sf_dir):
    check(documents(spark, sf_dir).repartition(5))


def test_odd_documents(spark):
    check(odd_documents(spark).repartition(3))


def junk(spark):
    rng = random.Random(1)
    line = " ".join(rng.choice(["ab", "cde", "f", "ghij"]) for _ in range(60))
    rows = []
    for i in range(200):
        kind, at = rng.random(), rng.randint(0, 100)
        text = (
            "".join(rng.choice("ab") for _ in range(rng.randint(0, 400))) if kind < 0.3
            else "a" * rng.randint(0, 400) if kind < 0.5
            else " ".join(rng.choice("xy") for _ in range(rng.randint(0, 150))) if kind < 0.7
            else "é" * rng.randint(0, 30) + line[at : at + rng.randint(50, 200)] + str(i) * rng.randint(0, 80) + line
        )
        rows.append((i * 3 - 100, text))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_many_ties(spark):
    check(junk(spark))


@pytest.fixture
def hot(monkeypatch):
    """Every anchor is hot, also on the workers, as the step functions carry what they were given."""
    original = repeats.anchor_rows, repeats.meet

    def lowered(make):
        def outer(w):
            step = make(w)

            def run(batches):
                from promoscan.llm import repeats as there

                old = there.HOT_IN_TASK, there.HOT
                there.HOT_IN_TASK, there.HOT = 1, 2
                try:
                    yield from step(batches)
                finally:
                    there.HOT_IN_TASK, there.HOT = old

            return run

        return outer

    monkeypatch.setattr(repeats, "anchor_rows", lowered(original[0]))
    monkeypatch.setattr(repeats, "meet", lowered(original[1]))


def test_hot_anchors(spark, hot):
    check(junk(spark))


def test_empty_and_short(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert by_bytes(empty) == [] and by_words(empty) == []
    short = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert by_bytes(short) == [("1", 3, 0, 0, b"a b"), ("2", 0, 0, 0, b"")]


def test_as_text_drops_parts_of_characters(spark):
    text = "é" * 60
    df = spark.createDataFrame([(1, "x" + text), (2, text[:51])], "doc_id long, text string")
    rows = {r.row.doc_id: r.kept for r in suffix_array_dedup(df, as_text=True).collect()}
    assert rows[2] == "" and rows[1].startswith("x")


def test_anchor_windows_cover_everything():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 3, 500).astype(np.uint8)
    starts = np.array([0, 90, 200, 200, 500])
    at, first, last = anchor_runs(byte_grams(data, 24), 77, 100, starts)
    windows = [p for a, b in zip(first, last, strict=True) for p in range(a, b + 1)]
    assert windows == [p for p in range(401) if any(a <= p and p + 100 <= b for a, b in zip(starts, starts[1:], strict=False))]
    assert all(a <= x <= a + 76 and b <= x for x, a, b in zip(at, first, last, strict=True))
    assert PIECE < 1 << 24 and len(sliding_argmin(np.arange(5, dtype=np.uint64), 9)) == 0


def test_range_hash_is_position_free():
    data = np.array([5, 6, 7, 5, 6, 7, 8], np.uint8)
    h = RangeHash(data)(np.array([0, 3, 1]), np.array([3, 6, 4]))
    assert h[0] == h[1] != h[2]
    assert symbol_grams(data.astype(np.uint64), 3)[0] == symbol_grams(data.astype(np.uint64), 3)[3]


def test_structures_agree_with_strings():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    start = np.arange(2900)
    for find, width in ((equal_windows, 12), (lambda d, s, w, n: deep_nodes(d.astype(np.uint64), s, w, n), 12)):
        node = find(data, start, width, np.ones(len(start), np.int64))
        groups = {}
        for p in start:
            groups.setdefault(data[p : p + width].tobytes(), []).append(p)
        for at in groups.values():
            assert len(set(node[at])) == 1 and (len(at) == 1 or node[at[0]] >= 0)
        shared = [at[0] for at in groups.values() if len(at) > 1]
        assert len(set(node[shared])) == len(shared)


def test_merged_spans():
    k, a, b = repeats.merged(np.array([2, 1, 1, 1]), np.array([0, 5, 0, 2]), np.array([4, 9, 3, 5]))
    assert list(zip(k, a, b, strict=True)) == [(1, 0, 9), (2, 0, 4)]


def test_too_wide_raises():
    assert repeats.Windows(279, 24, False, True).count == 256
    with pytest.raises(ValueError, match="279 at most"):
        repeats.Windows(280, 24, False, True)


def test_counted_suffixes_are_nodes():
    data = np.arange(60, dtype=np.uint8)
    start, count = np.arange(40), np.where(np.arange(40) % 3 == 0, 2, 1)
    for find, words in ((equal_windows, data), (deep_nodes, data.astype(np.uint64))):
        node = find(words, start, 12, count)
        assert ((node >= 0) == (count > 1)).all() and len(set(node[count > 1])) == (count > 1).sum()


def test_equal_ranges(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(0, 2, 500).astype(np.uint8)
    a, b, size = (rng.integers(0, 480, 900), rng.integers(0, 480, 900), rng.integers(1, 9, 900))
    expected = [bytes(data[x : x + n]) == bytes(data[y : y + n]) for x, y, n in zip(a, b, size, strict=True)]
    for limit in (1, 7, 1 << 20):
        monkeypatch.setattr(repeats, "COMPARE", limit)
        assert repeats.equal_ranges(data, a, b, size).tolist() == expected
    assert len(repeats.equal_ranges(data, a[:0], b[:0], size[:0])) == 0


@pytest.fixture
def colliding(monkeypatch):
    """All contexts of an anchor have one hash, in the tasks as well, so that only comparing tells them apart."""
    original = repeats.anchor_rows

    def lowered(w):
        step = original(w)

        def run(batches):
            from promoscan.llm import repeats as there

            old = there.RangeHash
            there.RangeHash = lambda data: lambda start, stop, seed: np.zeros(len(start), np.uint64)
            try:
                yield from step(batches)
            finally:
                there.RangeHash = old

        return run

    monkeypatch.setattr(repeats, "anchor_rows", lowered)


def test_equal_hashes_of_different_contexts(spark, colliding):
    check_bytes(junk(spark))
    # words are compared within a task
    check_words(junk(spark).coalesce(1))


@pytest.fixture
def all_texts(monkeypatch):
    monkeypatch.setattr(substring_module, "Windows", lambda *a, whole_copies, **k: repeats.Windows(*a, **k))


def test_words_of_all_copies(spark, colliding, all_texts):
    check_words(junk(spark))


def test_anchors_over_several_tables(spark, monkeypatch):
    original = repeats.compare

    def small(w, refine):
        step = original(w, refine)

        def run(batches):
            from promoscan.llm import repeats as there

            old, there.COMPARE = there.COMPARE, 64
            try:
                yield from step(b.slice(i, 3) for b in batches for i in range(0, b.num_rows, 3))
            finally:
                there.COMPARE = old

        return run

    monkeypatch.setattr(repeats, "compare", small)
    check(junk(spark))


def test_word_hashes_hold_no_words():
    repeats.word_hashes([b"first"])
    words = [b"word%d" % i for i in range(100_000)]
    tracemalloc.start()
    try:
        got = repeats.word_hashes(words)
        held = tracemalloc.get_traced_memory()[0] - got.nbytes
    finally:
        tracemalloc.stop()
    assert got[:100].tolist() == [xxhash.xxh3_64_intdigest(w) for w in words[:100]]
    assert held < 1_000_000
    assert repeats.word_hashes([]).tolist() == []


def test_held_columns_are_let_go():
    held = [(np.arange(3), np.arange(3) + 5), (np.arange(2), np.arange(2))]
    a, b = repeats._columns_of(held)
    assert (a.tolist(), b.tolist(), held) == ([0, 1, 2, 0, 1], [5, 6, 7, 0, 1], [])
