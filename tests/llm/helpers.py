"""Brute-force versions and odd inputs."""

from __future__ import annotations

import glob
import hashlib
import os

import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `row` int, k int, spans string"
WORD_SPACE = " \t\n\x0b\x0c\r"


def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows and ids, clashing column names."""
    long_text = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
    base = " ".join(f"alpha{i} beta" for i in range(60))
    rows = [
        (1, base, "en", "a", 5, 1, 2, "s"),
        (1, base, "en", "a", 5, 1, 2, "s"),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "b", 0, 1, 1, ""),
        (4, " \t\n\x0b ", "en", "b", 0, 1, 1, ""),
        (5, long_text, "en", None, len(long_text), 1, 1, ""),
        (None, base + " tail", "de", "a", 1, 1, 1, ""),
        (None, base, "de", "c", 1, 1, 1, ""),
        (6, "äöü \U0001f600 ▁x  y 12 \x00 <s>", "fr", "c", 3, 1, 1, ""),
        (7, long_text[5:], "en", "c", 3, 1, 1, ""),
        (7, "aaaa" * 200, "en", "c", 3, 1, 1, ""),
        (8, "of the " * 90, "en", "c", 3, 1, 1, ""),
    ]
    return spark.createDataFrame(rows, DOCS)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def numbered(df):
    """(id, text) in the order that row_keys gives."""
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, (r[1] or "").encode()))


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in WORD_SPACE:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def sha(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


def cut_bytes(texts, width=100):
    """(n_bytes, n_removed, n_spans, kept) of each text, in order."""
    seen, out = set(), []
    for text in texts:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            part = raw[p : p + width]
            if part in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(part)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(raw), sum(gone), spans, bytes(x for x, g in zip(raw, gone, strict=True) if not g)))
    return out


def cut_words(texts, width=13):
    first, split, out = {}, [words(t) for t in texts], []
    for i, w in enumerate(split):
        for p in range(len(w) - width + 1):
            first.setdefault(tuple(w[p : p + width]), i)
    for i, w in enumerate(split):
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < i:
                gone[p : p + width] = [True] * width
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def base_statistics(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    w, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    windows = {}
    for p in range(len(w) - 7):
        windows.setdefault(tuple(w[p : p + 8]), []).append(p)
    repeated = {p + i for at in windows.values() if len(at) > 1 for p in at for i in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def simhash(text, shingle=3):
    import xxhash

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lower)
    if not w:
        return 0
    parts = [" ".join(w[i : i + shingle]) for i in range(max(len(w) - shingle + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def table_files(folder, name):
    path = f"{folder}/{name}.parquet"
    return sorted(glob.glob(f"{path}/*.parquet")) if os.path.isdir(path) else [path]


def unit(vectors):
    x = np.array(vectors, float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
