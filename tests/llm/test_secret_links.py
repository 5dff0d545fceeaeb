"""Secrets: sure patterns by plain regular expressions, links by comparing all parts of a text."""

import hashlib
import random
import re

from promoscan.llm import queries
from promoscan.llm import secret_links as sl
from tests.llm.helpers import documents, odd_documents

KEY = "q7Rb2LxW9vTz4KmP8sYd1NcH"
RANK = {k: i for i, k in enumerate(("assign", "access", "hex", "identifier", "key"))}


def base(text):
    text = text or ""
    name = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    out = [("assign", *m.span()) for m in re.finditer(name + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) > 5]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[1], RANK[s[0]]))


def spans(text):
    """Sure spans and all weak ones with a counterpart, by comparing every part with every other."""
    text = text or ""
    sure = base(text)
    parts = [(k, a, b, len(re.findall(r"\n[\x20\t\r]*\n", text[: a]))) for k, a, b in sure + sl.weak_spans(text, sure)]
    secret = ("assign", "hex", "key")
    weak = [
        (k, a, b)
        for k, a, b, scope in parts
        if k in ("identifier", "key")
        and any((k in secret) != (j in secret) and scope == s and c - b <= sl.REACH and a - d <= sl.REACH for j, c, d, s in parts)
    ]
    return sorted(sure + weak, key=lambda s: (s[1], RANK[s[0]]))


def listed(found):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def check(rows, got):
    assert len(got) == len(rows)
    want = sorted((i is None, i or 0, listed(base(t)), listed(spans(t))) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.b, r.s) for r in got) == want


def found(df):
    return sl.secret_spans(df).select("doc_id", sl.listed("base").alias("b"), sl.listed("spans").alias("s")).collect()


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op13_secret_scan(spark, sf_dir).collect()}
    rows = documents(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in rows:
        want = base(r.text)
        g = got[r.doc_id]
        assert (g.n_assign, g.n_access, g.n_hex) == tuple([k for k, _, _ in want].count(x) for x in ("assign", "access", "hex"))
        assert g.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest() and g.spans == listed(spans(r.text))


def test_sure_patterns(spark):
    texts = [
        "Password = \"abc.def\" passwd:12345 passwd:123456", "toKen = abcdefg token='abcdefg=='", "\U0001f600 AKIA" + "A" * 16 + " AKIA" + "B" * 15,
        "f" * 23 + " " + "0a" * 12 + "F" + "a" * 30, "secret=token:abcdefgh api_key=api-key APIKEY  :x_y.z/", "ſecret=abcdefgh AKIAKIA" + "A" * 20, "secret token=" + "a1" * 5000,
    ]
    rows = list(enumerate(texts))
    check(rows, found(spark.createDataFrame(rows, "doc_id long, text string")))


def test_weak_parts_need_a_counterpart(spark):
    far = " filler" * 60
    texts = [
        f"user: bob key {KEY}", f"key {KEY}", "user: bob", f"user: bob{far} {KEY}", f"user: bob\n \n{KEY}", f"https://x.example/a {KEY}",
        f"https://x.example/{KEY}", "login=bob password=hunter22", "client_id=me AKIA" + "Z" * 16, f"10.0.0.1:5432 {KEY} {KEY[::-1]}", f"{KEY}{'A1b' * 400}{far[:150]} user=alice",
    ]
    rows = list(enumerate(texts))
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    check(rows, got)
    linked = {r.doc_id for r in got if r.s != r.b}
    assert linked == {0, 5, 7, 9, 10}


def test_many_parts_and_repeated_ids(spark):
    rnd = random.Random(5)
    parts = [KEY, "user = bob", "password: abcdef", "http://h.example", "\n\n", "0123456789abcdef01234567", "AKIA" + "Q" * 18, "some plain words " * 12]
    rows = [(rnd.choice([1, 2, None]), " ".join(rnd.choice(parts) for _ in range(rnd.randrange(60)))) for _ in range(60)]
    rows.append((3, " ".join(rnd.choice(parts) for _ in range(4000))))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, k long, base string")
    check(rows, found(df))


def test_odd(spark):
    odd = odd_documents(spark)
    check([(r.doc_id, r.text) for r in odd.collect()], found(odd))
    assert found(odd.limit(0)) == []
