"""The other operators against brute force, round trips and held-out accuracy."""

import re
import zlib

import numpy as np
import pytest
import zstandard

from promoscan.llm import language_id, mixing, quality_cotrain, queries, sentencepiece_codec, token_frames
from promoscan.llm.components import components
from promoscan.llm.embedding_dedup import THRESHOLD, embedding_dedup, passed_filters
from promoscan.llm.language_id import identify_language
from promoscan.llm.mixing import flight, mix_sources, mixed, source_targets
from promoscan.llm.quality_cotrain import keep_good, score_quality
from promoscan.llm.quality_rules import quality_rules, text_statistics
from promoscan.llm.sentencepiece_codec import Codec, sentencepiece_round_trip
from promoscan.llm.simhash_dedup import covering_masks, drop_near_duplicates, near_prints, simhash_dedup
from promoscan.llm.token_frames import ShardReader, TokenCache, read_shards, write_shards
from tests.llm.helpers import (
    base_statistics, components_of, documents, numbered, odd_documents, pairs, sha, simhash, unit, words,
)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return documents(spark, sf_dir)


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def empty(df):
    return df.limit(0)


# quality rules


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_statistics(spark, docs):
    for df in (docs, odd_documents(spark)):
        got = sorted(pairs(text_statistics(df), "id", *STATISTICS), key=str)
        assert got == sorted(((i, *base_statistics(t)) for i, t in pairs(df, "doc_id", "text")), key=str)


def test_quality_rules(spark, sf_dir):
    rules = quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    marks = dict(pairs(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id", "quality"))
    good = [r.kept for r in rules.collect() if marks.get(r.doc_id) == 1]
    bad = [r.kept for r in rules.collect() if marks.get(r.doc_id) == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.5
    assert all(not r.kept for r in rules.filter("base_failed").collect())


def test_quality_rules_without_labels(spark, docs, labels):
    out = quality_rules(odd_documents(spark), empty(labels))
    assert all(r.kept != r.base_failed for r in out.collect()) and out.count() == 12
    assert quality_rules(empty(docs), labels).count() == 0


# token frames


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))


def test_token_frames(spark, docs, tokenizer):
    for df in (docs, odd_documents(spark)):
        manifest = write_shards(df, queries.vocabulary("word_bpe_49k.json"))
        got = sorted(pairs(read_shards(spark, manifest), "start", "doc_id", "n_tokens", "ids_crc32"))
        start, want = 0, []
        for doc_id, text in numbered(df):
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
            want.append((start, doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_pieces_of_odd_texts(tokenizer):
    texts = [
        "Don't <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|> Straße's \u00ad it's ''s 12a'llb 3rd x|y |||| c!?",
        "ÀÉ²½3ª µ™ \u212a K\x85b\xa0c ’s e\u0301 \u0301a İ ǅ", "日本 ok <|endoftext|>x", "\x1c a\x1fb\x00\x7f", " \t\n", "", None,
    ]
    cache = TokenCache(queries.vocabulary("word_bpe_49k.json"))
    assert cache.by_piece
    expected = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in cache.encode_all(texts)] == expected
    characters = [f"a{chr(c)}B {chr(c)}" for c in range(0x2100)]
    expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in characters]
    assert [np.frombuffer(x, "<u4").tolist() for x in cache.encode_all(characters)] == expected
    other = TokenCache(queries.vocabulary("byte_bpe_50k.json"))
    assert not other.by_piece
    expected = [x.ids for x in other.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in other.encode_all(texts)] == expected


def test_pieces_by_the_model_alone(tokenizer):
    cache = TokenCache(queries.vocabulary("word_bpe_49k.json"))
    rng = np.random.default_rng(6)
    signs = [chr(c) for c in range(256)]
    texts = ["".join(rng.choice(signs, rng.integers(1, 30))) for _ in range(2000)]
    pieces = sorted({p for t in texts for p in cache._pieces(t)} | set("'s 't 're 've 'm 'll 'd".split()))
    whole = cache.tokenizer.encode_batch([*pieces], add_special_tokens=False)
    asked = []
    ids, cache._ids = cache._ids, lambda text: asked.append(text) or ids(text)
    cache._learn(set(pieces))
    assert {p: np.frombuffer(x, "<u4").tolist() for p, x in cache.ids.items()} == {p: x.ids for p, x in zip(pieces, whole, strict=True)}
    assert all(len(text) <= 64 and " " not in text for text in asked) and len(asked) <= len(pieces) // 1000 + 1


def test_random_access_and_damage(spark, docs, tmp_path, tokenizer):
    texts = dict(pairs(docs, "doc_id", "text"))
    manifest = write_shards(docs.coalesce(1), queries.vocabulary("word_bpe_49k.json"), str(tmp_path / "shards"))
    path = manifest.first().path
    shard = ShardReader(path)
    some = shard.doc_ids[1]
    found = shard.find([some, -5])
    assert list(found) == [some]
    assert np.frombuffer(found[some], "<u4").tolist() == [*tokenizer.encode(texts[some], add_special_tokens=False).ids, 1]
    shard.close()
    raw = bytearray((tmp_path / "shards" / path.rpartition("/")[2]).read_bytes())
    raw[int(shard.offsets[1]) + int(shard.sizes[1]) // 2] ^= 255
    (tmp_path / "bad.zst").write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017  zstandard's error or the checksum's
        ShardReader(str(tmp_path / "bad.zst")).read(1)
    with pytest.raises(ValueError, match="seek table"):
        (tmp_path / "short.zst").write_bytes(bytes(100))
        ShardReader(str(tmp_path / "short.zst"))


def test_no_shard_for_no_documents(spark, docs):
    manifest = write_shards(empty(docs), queries.vocabulary("word_bpe_49k.json"))
    assert manifest.count() == 0 and read_shards(spark, manifest).count() == 0


# sentencepiece


@pytest.fixture(scope="module")
def model():
    return queries.vocabulary("piece_bpe_32k.model")


def test_sentencepiece(spark, docs, model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    for df in (docs, odd_documents(spark)):
        out = sentencepiece_round_trip(df, model, with_ids=True).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_corrected", "ids", "decoded")
        got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect())
        want = []
        for doc_id, text in pairs(df, "doc_id", "text"):
            ids = library.encode(text or "", add_bos=True, add_eos=True)
            want.append((str(doc_id), len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids))))
        assert got == sorted(want)
        assert all(r.n_corrected == 0 and len(r.ids) == r.n_tokens for r in out.collect())
    assert sentencepiece_round_trip(empty(docs), model).count() == 0


def test_agenda_alone(model):
    codec = Codec(model)
    for text in ("▁▁▁▁▁foo", "▁" * 40, "▁ññññ日本\U0001f600", "▁aaaaaaaaaaaaaaaaaaaaaaab", "▁x12345"):
        assert codec.encode_unit(text) == codec.library.encode(text[1:].replace("▁", " ")), text
    rng = np.random.default_rng(3)
    for _ in range(300):
        unit_text = "".join(rng.choice(list("etaoinshr .é1"), 30)).replace(" ", "")
        assert codec.encode_unit("▁" + unit_text) == codec.library.encode(unit_text)
        ids = rng.integers(0, 900, 12)
        assert codec.decode(ids) == codec.library.decode(ids.tolist())


def test_agendas_in_step(model):
    codec = Codec(model)
    rng = np.random.default_rng(4)
    signs = [list("etaoinshr"), list("aab"), list(" .,12;"), list("äöé日\U0001f600\x07"), list("the▁")]
    units = ["".join(rng.choice(signs[n % 5], rng.integers(1, 70))).replace(" ", "x") for n in range(1500)]
    got = codec.encode_units(["▁" + u for u in units])
    for unit, ids in zip(units, got, strict=True):
        right = codec.library.encode(unit.replace("▁", " "))
        assert np.frombuffer(ids, "<u4").tolist() == codec.encode_unit("▁" + unit) == right, unit


def test_texts_together(spark, docs, model):
    codec = Codec(model)
    texts = [t for _, t in numbered(docs)[:60]] + [None, "", " ", "  x", "a" * 900, "日本 ok", "▁"]
    got = codec.encode_all(texts)
    assert [x.tolist() for x in got] == [codec.library.encode(t or "", add_bos=True, add_eos=True) for t in texts]
    assert [codec.decode(x) for x in got] == [codec.library.decode(x.tolist()) for x in got]
    assert codec.corrected == 0
    assert "decoded" not in sentencepiece_round_trip(docs, model, with_ids=True, with_text=False).columns


def test_caches_of_unspaced_text_are_bounded(tokenizer, model, monkeypatch):
    rng = np.random.default_rng(5)
    signs = np.array([chr(c) for c in range(0x4E00, 0x5200)])
    long, short = ([" ".join("".join(rng.choice(signs, n)) for _ in range(6000 // n)) for _ in range(40)] for n in (3000, 40))
    for module in (sentencepiece_codec, token_frames):
        monkeypatch.setattr(module, "CACHE_BYTES", 400_000)
    cache, codec = TokenCache(queries.vocabulary("word_bpe_49k.json")), Codec(model)
    most = 0
    for text in long + short + long:
        (got,) = cache.encode_all([text])
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == codec.library.encode(text, add_bos=True, add_eos=True)
        for held in (cache.ids, codec.units):
            assert all(len(unit) <= 64 for unit in held)
            most = max(most, sum(200 + 4 * len(unit) + len(ids) for unit, ids in held.items()))
    # the bound, and what one text adds
    assert 200_000 < most < 400_000 + 150 * (200 + 160 + 40 * 12 + 12)


# language


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = queries.op7_language_id(spark, "/root/testdata/sf0.01")
    right = dict(pairs(docs, "doc_id", "lang"))
    held = [r for r in out.collect() if r.held_out]
    assert out.count() == docs.count() and all(0 <= r.score <= 1 for r in out.collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out.collect())
    assert np.mean([right[r.doc_id] == r.lang_pred for r in held]) > 0.95


def test_language_of_odd_documents(spark, docs):
    odd = odd_documents(spark)
    got = {(r.doc_id, r.lang_pred) for r in identify_language(odd, docs).collect()}
    assert {(2, "und"), (3, "und"), (4, "und")} <= got and (5, "und") not in got
    assert {r.lang_pred for r in identify_language(odd, empty(docs)).collect()} == {"und"}
    assert identify_language(empty(docs), docs).count() == 0


# simhash


def test_masks_cover_every_pair_of_bits():
    masks = covering_masks()
    assert all(any(not m >> a & 1 and not m >> b & 1 for m in masks) for a in range(64) for b in range(64))


def check_simhash(df):
    rows = [(r.doc_id, simhash(r.text)) for r in df.select("doc_id", "text").collect()]
    prints = sorted({p for _, p in rows})
    links = [(a, b) for i, a in enumerate(prints) for b in prints[i:] if (a ^ b).bit_count() <= 2]
    group = components_of(prints, links)
    least = {}
    for doc_id, p in rows:
        if doc_id is not None:
            least[group[p]] = min(least.get(group[p], doc_id), doc_id)
    got = sorted(((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in simhash_dedup(df).collect()), key=str)
    assert got == sorted(((d, p, least.get(group[p])) for d, p in rows), key=str)


def test_simhash(spark, docs):
    check_simhash(docs)
    check_simhash(odd_documents(spark))
    assert simhash_dedup(empty(docs)).count() == 0


def test_large_buckets_lose_no_link(spark):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 62))
    prints = {centre}
    for _ in range(400):
        near = centre
        for b in rng.integers(0, 64, rng.integers(1, 6)):
            near ^= 1 << int(b)
        prints.add(near - (1 << 64) if near >= 1 << 63 else near)
    nodes = sorted(prints)
    links = near_prints(spark.createDataFrame([(p,) for p in nodes], "print long"))
    got = components_of(nodes, pairs(links, "a", "b"))
    mask = (1 << 64) - 1
    want = components_of(nodes, [(a, b) for a in nodes for b in nodes if a < b and ((a ^ b) & mask).bit_count() <= 2])
    assert got == want


def test_drop_near_duplicates(spark, docs):
    firsts = {r.component_id for r in simhash_dedup(docs).collect()}
    out = drop_near_duplicates(docs)
    assert {r.doc_id for r in out.collect()} == firsts and out.columns == docs.columns
    odd = drop_near_duplicates(odd_documents(spark))
    assert odd.columns == odd_documents(spark).columns
    assert [r.doc_id for r in odd.collect()].count(1) == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(300)] + [(900, 900), (7, 3)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = dict(pairs(components(df), "node", "component"))
    want = components_of({x for e in chain for x in e} - {900}, chain[:-2])
    assert got == want
    assert components(df.limit(0)).count() == 0


# embeddings


def check_embeddings(df, recall=1.0):
    rows = sorted(df.collect(), key=lambda r: r.vec_id)
    ok = [r for r in rows if r.label is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
    links = []
    if ok:
        x, label = unit([r.embedding for r in ok]), np.array([r.label for r in ok])
        close = (x @ x.T >= THRESHOLD) & (label[:, None] == label)
        links = [(ok[a].vec_id, ok[b].vec_id) for a, b in zip(*np.nonzero(np.triu(close, 1)), strict=True)]
    want = components_of([r.vec_id for r in rows], links)
    n = {r.vec_id: 0 for r in rows}
    for pair in links:
        for v in pair:
            n[v] += 1
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(df).collect()}
    assert len(got) == len(rows)
    assert sum(g[0] for g in got.values()) >= recall * sum(n.values()) and all(got[v][0] <= n[v] for v in n)
    if recall == 1:
        assert got == {v: (n[v], want[v]) for v in n}


def test_embeddings(spark, sf_dir):
    check_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def test_embeddings_odd(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(16)
    rows = [(i, [float(x) for x in centre + 0.02 * rng.standard_normal(16)], i % 2) for i in range(300)]
    rows += [(1000 + i, [float(x) for x in centre], 1) for i in range(50)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [1.0, None], 1), (2003, [float("nan")] * 16, 1), (2004, [float(x) for x in centre], None), (2005, [], 1), (2006, [float("inf")] * 16, 0)]
    check_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.99)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup(none).count() == 0


def test_tiles_split_large_filters(spark, monkeypatch):
    monkeypatch.setattr("promoscan.llm.embedding_dedup.TILE", 16)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    rows = [(i, [float(x) for x in centre + 0.02 * rng.standard_normal(16)], 1) for i in range(200)]
    check_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))


def test_every_vector_passes_filters():
    x = unit(np.random.default_rng(0).standard_normal((200, 64)))
    assert min(map(len, passed_filters(x, 50))) >= 12


# mixing


def targets_of(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in held]
        heavy = sum(weight[s] for s in free)
        share = {s: (total - sum(held.values())) * weight[s] / heavy for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return held | share
        held |= {s: cap * sizes[s] for s in over}


def check_mix(df):
    out = mix_sources(df)
    rows = out.collect()
    sizes, largest = {}, {}
    for s, t in pairs(df, "source", "text"):
        sizes[s] = sizes.get(s, 0) + len(words(t))
        largest[s] = max(largest.get(s, 0), len(words(t)))
    want = targets_of(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1, s
    assert sorted(rows, key=str) == sorted(mix_sources(df.repartition(7)).collect(), key=str)


def test_mixing(spark, docs):
    check_mix(docs)
    assert mix_sources(empty(docs)).count() == 0


def test_mixing_odd(spark):
    check_mix(odd_documents(spark))
    odd = odd_documents(spark)
    assert mixed(odd).columns == odd.columns
    assert mixed(odd).count() == sum(r.copies for r in mix_sources(odd).collect())


def test_targets_with_caps(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 0, None: 300}
    df = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, n long, source_size long")
    got = dict(pairs(source_targets(df), "source", "target"))
    want = targets_of(sizes)
    assert all(abs(got[s] - want[s]) < 1e-9 for s in sizes)


def test_blocks_and_balance(spark, monkeypatch):
    monkeypatch.setattr("promoscan.llm.mixing.BLOCK", 50)
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(0, 60)), "x" if i % 10 else "y") for i in range(1500)]
    check_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    size = rng.integers(0, 1000, 400)
    p = np.full(400, 0.3)
    out = flight(p, size, 5)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - p.sum()) < 1e-6 and abs(out @ size - p @ size) < 1e-3


# co-training


def test_cotraining(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = score_quality(docs, labels).collect()
    marks = dict(pairs(labels, "doc_id", "quality"))
    good = [r.kept for r in out if marks.get(r.doc_id) == 1]
    bad = [r.kept for r in out if marks.get(r.doc_id) == 0]
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.3
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.kept}


def test_kept_rows_keep_columns_of_any_name(spark):
    good, bad = "plain words that follow one another here. ", "!!! $$$ ### 111 "
    rows = [(kind * 100 + i, (good if kind else bad) * (i + 2), i, i, "r", i, i) for kind in (0, 1) for i in range(12) for _ in range(2)] + [(None, good, 0, 0, None, 0, 0)]
    names = "doc_id long, text string, _row_key long, id long, row string, label int, kept int"
    docs = spark.createDataFrame(rows, names)
    labels = spark.createDataFrame([(kind * 100 + i, kind) for kind in (0, 1) for i in range(12)], "doc_id long, quality int")
    out = keep_good(docs, labels, meta_columns=["row", "label"])
    scored = score_quality(docs, labels, meta_columns=["row", "label"]).filter("kept")
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.filter("doc_id is not null").collect()) == sorted(r for r in rows if r[0] is not None and r[0] >= 100)
    assert sorted(map(str, pairs(out, "doc_id"))) == sorted(map(str, pairs(scored, "doc_id")))


def test_cotraining_odd(spark, docs, labels):
    odd = odd_documents(spark)
    assert score_quality(odd, labels).count() == 12
    assert all(r.kept and r.score == 1 for r in score_quality(odd, empty(labels)).collect())
    assert keep_good(odd, empty(labels)).columns == odd.columns
    assert score_quality(empty(docs), labels).count() == 0


def test_exchange_covers_all_unlabelled_rows(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")

    def scores():
        return {r.doc_id: r.score for r in score_quality(docs, labels).collect()}

    whole = scores()
    n = docs.join(labels, "doc_id", "left_semi").count()
    assert n < docs.count() - n
    monkeypatch.setattr(quality_cotrain, "FIT_ROWS", n)
    bounded = scores()
    assert max(abs(whole[k] - bounded[k]) for k in whole) < 1e-6


@pytest.mark.parametrize("ids", [1, 2, 10])
@pytest.mark.parametrize("copies", [1, 10])
def test_cotraining_with_few_and_repeated_ids(spark, ids, copies):
    good, bad = "plain words that follow one another here. ", "!!! $$$ ### 111 "
    docs = [(kind * 100 + i, (good if kind else bad) * (i + 2), "en", "a", 1) for kind in (0, 1) for i in range(ids) for _ in range(copies)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(kind * 100 + i, kind) for kind in (0, 1) for i in range(ids) for _ in range(copies)], "doc_id long, quality int")
    out = score_quality(docs, labels).collect()
    assert len(out) == 2 * ids * copies and all(0 <= r.score <= 1 for r in out)
    if ids < 10:
        assert all(r.kept and r.score == 1 for r in out)
    else:
        assert {r.doc_id for r in out if r.kept} == {100 + i for i in range(10)}
    assert all(r.kept for r in score_quality(docs, labels.filter("quality = 1")).collect())


def test_excerpts_are_few_whatever_the_keys(spark, monkeypatch):
    rows = [(None, f"word{i} and some more words", "en") for i in range(900)] + [(5, "the same text each time", "de")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.language_dictionaries(df, "text", "lang", "doc_id", sample=4)
    assert len(found["en"].split(b"\n")) == 8 and found["de"] == b"the same text each time"
    assert list(found) == ["en", "de"] and language_id.language_dictionaries(df.limit(0), "text", "lang", "doc_id") == {}


def test_language_sizes_by_hand(spark, docs):
    """The smallest sum of compressed parts wins, by the library's one-shot interface."""
    found = language_id.language_dictionaries(docs, "text", "lang", "doc_id", sample=20)
    sizes = {}
    for lang, raw in found.items():
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        sizes[lang] = (d, len(raw))
    recognize = language_id.Recognizer(found)
    for row in docs.limit(60).collect():
        raw = " ".join(re.findall(r"[^\W\d_]+", (row.text or "").lower())).encode()
        if not raw:
            continue
        sums = {}
        for lang, (d, size) in sizes.items():
            how = zstandard.ZstdCompressionParameters.from_level(5, source_size=1024, dict_size=size, min_match=3, write_content_size=False, write_dict_id=False)
            sums[lang] = sum(len(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024))
        assert sums[recognize(row.text)[0]] == min(sums.values())


def test_mixed_keeps_columns_of_any_name(spark):
    rows = [(i, f"w{i} " * (i % 7 + 1), "ab"[i % 2], i, i, i, "r") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies long, copies long, _row_key long, row string")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} <= set(rows)
