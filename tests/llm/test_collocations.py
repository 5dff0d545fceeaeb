"""Collocations against counts of every phrase; the whole table against SQL in test_pipeline."""

import random
import re
from collections import Counter

import pytest

from promoscan.llm import collocations as co
from tests.llm.helpers import odd_documents


def expected(rows, longest=5, least=100, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        totals[lang] += 0
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {p: n for p, n in counts.items() if n >= least and len(p[1]) > 1}
    out = []
    for (lang, p), a in found.items():
        if any(la == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (la, q), b in found.items()):
            continue
        n = totals[lang]
        cuts = [(1000 * a * n // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]], n))
    ranked, rank = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], phrase.decode(), -a, left, right, n, -score))
    return ranked


def texts(seed, docs=300):
    rnd = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(12)] + ["ä", "Ä", "\U0001f600", "x'y", "a\x1cb"]
    out = []
    for _ in range(docs):
        words = [w for _ in range(rnd.randrange(30)) for w in (rnd.choice([["new", "york", "city"], ["the"], [rnd.choice(vocabulary)]]))]
        out.append((rnd.choice(["en", "en", "de", None, "und"]), "".join(w + rnd.choice([" ", " ", " \t", ". ", "\n", ";"]) for w in words)))
    return [*out, ("en", "the " * 500), ("en", None), (None, ""), ("fr", ".,;")]


@pytest.mark.parametrize(("longest", "least", "top", "bits"), [(5, 3, 2000, 24), (5, 3, 5, 17), (2, 1, 2000, 17), (3, 10, 7, 20)])
def test_against_counts(spark, longest, least, top, bits):
    rows = texts(longest + least)
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "lang string, text string, n long, w1 long").repartition(5)
    got = co.collocations(df, longest=longest, least=least, top=top, sieve_bits=bits)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected(rows, longest, least, top))


def test_long_texts_are_cut_between_pieces(monkeypatch):
    text = "One two. Three " * 40 + "four" * 30
    whole = [w for x in co.tokens_of(text) for w in x]
    monkeypatch.setattr(co, "CHUNK", 50)
    chunks = list(co.tokens_of(text))
    assert len(chunks) > 5 and [w for x in chunks for w in x] == whole and all(x[-1] == b"." for x in chunks[:-1])
    assert list(co.tokens_of(None)) == []


def test_arithmetic_is_exact(spark):
    rows = [(10**15 + 7, 10**15 + 9, 10**15 + 11, 10**16 + 3), (3, 7, 11, 2**52), (10**16, 10**16, 10**16, 10**17)]
    got = spark.createDataFrame(rows, "a long, l long, r long, n long").select("a", "l", "r", "n", co.association().alias("score"))
    assert [r.score for r in got.collect()] == [1000 * a * n // (left * right) for a, left, right, n in rows]


def test_odd_documents(spark):
    odd = odd_documents(spark)
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert sorted(tuple(r) for r in co.collocations(odd, least=40).collect()) == sorted(expected(rows, least=40))
    assert co.collocations(odd.limit(0)).count() == 0


def test_the_sieve_grows_with_the_texts(spark):
    rnd = random.Random(3)
    rows = [("en", " ".join(["new york city", *(f"w{rnd.randrange(5000)}" for _ in range(800))])) for _ in range(400)]
    texts = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    table, bits = co.sieve(texts, 5, 50, 17)
    assert bits == 17
    table, bits = co.sieve(texts, 5, 3, 17)
    kind = "lang string, w1 string, w2 string, w3 string, w4 string, w5 string, n long"
    windows = texts.mapInArrow(co._windows(5, table, bits), kind).filter("w2 is not null")
    # with 17 bits, four phrases a word filled all counters up to 3, and nearly all 320,000 windows had five words
    assert bits > 17 and 800 <= windows.count() < 60_000
    assert windows.filter("w1 = 'new' and w2 = 'york' and w3 = 'city'").count() == 400
