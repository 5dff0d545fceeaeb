"""Near copies by exact similarity of five-word shingles, against brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from promoscan.llm import near_copies, shared_keys
from promoscan.llm.simhash_dedup import covering_masks
from tests.llm.helpers import components_of, documents, numbered, odd_documents, words


def shingles(text, n=5):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def firsts(rows):
    """Ids that come first in their group; ``rows`` of (unique id, text)."""
    sets = {k: shingles(t) for k, t in rows}
    keys = sorted(sets)
    links = []
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.7 * max(len(x), len(y)) and (x == y or len(x & y) / len(x | y) >= 0.8):
                links.append((b, a))
    return {k for k, c in components_of(keys, links).items() if k == c}


def firsts_within(rows, radius):
    """The same, if only fingerprints that differ in so many bits or fewer are linked."""
    sets = {k: shingles(t) for k, t in rows}
    prints = {k: near_copies.majority(near_copies.shingle_set(t).tobytes()) for k, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and (prints[a] ^ prints[b]).bit_count() <= radius]
    links = [(a, b) for a, b in near if sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    return {k for k, c in components_of(sorted(sets), links).items() if k == c}


def varied(seed, copies=160):
    """Near copies at similarities around 0.8, chains of them, and strangers with one common passage."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join(base)]
    for _ in range(copies):
        w = (base if rnd.random() < 0.7 else rnd.choice(texts).split())[:]
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(10**6)}"
        texts.append(" ".join(w).upper() if rnd.random() < 0.1 else " ".join(w))
    for _ in range(copies):
        w = [f"s{rnd.randrange(10**6)}" for _ in range(rnd.randrange(5, 60))]
        texts.append(" ".join(passage + w if rnd.random() < 0.5 else w + passage))
    texts += ["a b c d e f g h", "a b c d e f g h i", "A b c", "a B c", "", None, " \n"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_stage_finds_near_copies(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()}
    assert got == firsts([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize(("paired", "tile"), [(2, 5), (64, 512)])
def test_against_brute_force(spark, monkeypatch, paired, tile):
    monkeypatch.setattr(near_copies, "PAIRED", paired)
    monkeypatch.setattr(near_copies, "TILE", tile)
    rows = varied(paired)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in near_copies.drop_near_copies(docs).collect()} == firsts(rows)


def test_fingerprints_alone_link_what_is_in_their_radius(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "_possible", lambda _: F.lit(False))
    monkeypatch.setattr(near_copies, "PAIRED", 10**6)
    rows = varied(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = firsts_within(rows, near_copies.RADIUS)
    assert firsts(rows) < want < firsts_within(rows, 0)
    assert {r.doc_id for r in near_copies.drop_near_copies(docs).collect()} == want


def test_tables_cover_the_radius():
    masks = covering_masks(near_copies.RADIUS)
    rnd = random.Random(2)
    for _ in range(5000):
        bits = sum(1 << b for b in rnd.sample(range(64), near_copies.RADIUS))
        assert any(not m & bits for m in masks)


def test_odd(spark):
    odd = odd_documents(spark)
    out = near_copies.drop_near_copies(odd)
    assert out.columns == odd.columns
    assert out.count() == len(firsts(list(enumerate(t for _, t in numbered(odd)))))
    assert near_copies.drop_near_copies(odd.limit(0)).count() == 0


def test_parities_never_exceed_the_difference():
    rnd = np.random.default_rng(1)
    for n, other, shared in ((3, 5, 2), (0, 7, 0), (700, 500, 450), (5000, 300, 250), (4000, 4000, 3700)):
        pool = np.unique(rnd.integers(0, 2**63, n + other, dtype=np.uint64))
        x, y = pool[:n], pool[n - shared : n - shared + other]
        odd = near_copies.odd_places(near_copies.parities(x), near_copies.parities(y))
        assert odd <= len(np.setxor1d(x, y)) and (odd > 0 or n == shared == other)


def test_own_names_as_columns(spark):
    rows = [(i, t, i, i, "x") for i, t in varied(3, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row_key long, k long, row string")
    out = near_copies.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert {(r.doc_id, r._row_key) for r in out.collect()} == {(i, i) for i in firsts([r[:2] for r in rows])}


def test_signs_leave_no_pairs_of_a_common_passage(spark, monkeypatch):
    passage = [f"law{i}" for i in range(30)]
    rows = [(d, " ".join(passage + [f"own{d}x{i}" for i in range(70)])) for d in range(80)]
    seen, tiled = [], near_copies._tiled
    monkeypatch.setattr(near_copies, "RANKED", 0)  # so that the passage gets into prefixes
    monkeypatch.setattr(near_copies, "_tiled", lambda *a: seen.append(tiled(*a).count()) or tiled(*a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_copies.drop_near_copies(docs).count() == len(rows)
    assert seen and sum(seen) == 0


def test_forms_are_made_of_candidates_alone_and_keys_travel_packed(spark, monkeypatch):
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = [(d, " ".join(base if d < 4 else [f"o{d}x{i}" for i in range(200)])) for d in range(400)]
    rows[:4] = [(d, f"{' '.join(base)} tail{rnd.random()}") for d in range(4)]
    made, met, stored = [], [], near_copies.stored

    def watched(df, name):
        out = stored(df, name)
        if name in ("near-sets", "near-buckets"):
            (made if name == "near-sets" else met).append(out.count())
        return out

    monkeypatch.setattr(near_copies, "stored", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert near_copies.drop_near_copies(docs).count() == 397
    # whole texts went through a shuffle for each of these, and every key of a set was a row that was shuffled twice
    assert max(made) <= 4 and sum(met) <= 4 * 63


def test_sets_without_a_partner_of_their_size_leave_a_bucket():
    keys = np.array([5, 5, 5, 7, 7, 9, 9], np.uint64)
    n, place = np.array([100, 100, 50, 100, 81, 100, 100]), np.array([11, 0, 0, 0, 0, 12, 0])
    assert shared_keys.has_partner(keys, n, place, 0.8).tolist() == [True, True, False, True, True, False, True]


def test_packed_keys_come_back():
    rnd = np.random.default_rng(4)
    keys = np.sort(rnd.integers(0, 1 << 40, 1000, dtype=np.uint64))
    k = rnd.integers(-(2**63), 2**63 - 1, 1000)
    columns = [k, k[::-1].copy(), rnd.integers(0, 9, 1000), rnd.integers(-9, 9, 1000)]
    back = shared_keys._unpack(shared_keys._pack(keys, columns))
    assert all((x == y).all() for x, y in zip(back, [keys, *columns], strict=True))


def test_many_copies_move_few_sets(spark, monkeypatch):
    words_of = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words_of, f"t{d}"]) for d in range(20)]
    rows = [(d, np.sort(near_copies.shingle_set(t))) for d, t in enumerate(texts)]
    whole = spark.createDataFrame([(d, len(s), bytearray(s.tobytes())) for d, s in rows], "k long, n long, form binary")
    pairs = spark.createDataFrame([(a, b) for b in range(20) for a in range(b)], "a long, b long")
    compared, passing = [], near_copies._passing
    monkeypatch.setattr(near_copies, "_passing", lambda p, *x: compared.append(p.count()) or passing(p, *x))
    links = [tuple(r) for r in near_copies._spanning(pairs, whole, 0.8).collect()]
    assert set(components_of(range(20), links).values()) == {0}
    assert sum(compared) <= 20


def test_fine_parities_tell_what_coarse_ones_do_not():
    rnd = np.random.default_rng(6)
    pool = np.unique(rnd.integers(0, 2**63, 2300, dtype=np.uint64))
    x, y = pool[:2000], pool[260:2260]  # they differ in 520 of 4000, a similarity of 0.77
    maybe = near_copies._maybe(0.8)
    assert maybe(near_copies.parities(x), near_copies.parities(y), 4000)
    assert not maybe(near_copies.fine_parities(x), near_copies.fine_parities(y), 4000)
    assert maybe(near_copies.fine_parities(x), near_copies.fine_parities(pool[200:2200]), 4000)
