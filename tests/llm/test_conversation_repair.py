"""Conversation repair against a table of cheapest suffixes, filled backwards."""

import hashlib
import random
import re
import zlib

import pytest

from promoscan.llm import conversation_repair as cr

KIND = "conv_id long, turn long, role string, text string, c long, pos long"
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def edits(rows, state):
    """(cost, audit) of the cheapest repair of (initial, fault) rows."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    follow = [2, 2, 3, 2]
    best = [(0, ""), (4, "II"), (2, "I"), (0, "")]
    for initial, fault in reversed(rows):
        cut, new = fault == "t", []
        for s in range(4):
            ways = [(3 + best[s][0], "D" + best[s][1])]
            if fault not in "bd":
                if (s, initial) in step:
                    cost, rest = best[step[s, initial]]
                    ways.append((cost + cut, "K" + rest))
                cost, rest = best[follow[s]]
                ways.append((2 + cost + cut, "R" + rest))
            new.append(min(ways))
        for _ in range(4):
            new = [min(w, (2 + new[follow[s]][0], "I" + new[follow[s]][1])) for s, w in enumerate(new)]
        best = new
    return best[state]


def expected(rows):
    """Result rows of all conversations."""
    out = []
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in own:
            bare = [x for x in text if x not in SPACE]
            fault = "b" if not bare else "d" if (role, text) in seen else "-" if bare[-1] in ".!?" else "t"
            seen.add((role, text))
            marked.append((role[:1] if role[:1] in ("s", "u", "a") else "x", fault))
        cost, audit = edits(marked, 0)
        lines, state, i = [], 0, 0
        for e in audit:
            wanted = "uuau"[state]
            role, text = ("", "") if e == "I" else own[i][1:]
            i += e != "I"
            if e in "IR":
                role = {"u": "user", "a": "assistant"}[wanted]
            if e != "D":
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
                lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        turns = [r[0] for r in own if r[0] is not None]
        faults = [f for _, f in marked]
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(marked, marked[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *map(faults.count, "bdt"), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], KIND)
    return sorted((tuple(r) for r in cr.repaired_after_damage(df).collect()), key=repr)


def talk(rnd, conv, n, roles=("user", "assistant", "system", "tool", "")):
    texts = ["Yes.", "No", "Why?", " \n", "", "Go on!", "I see. ", "x" * 5000 + "."]
    return [(conv, rnd.choice([t, t, t + 1]), rnd.choice(roles), rnd.choice(texts) + rnd.choice(["", f" {t}."])) for t in range(n)]


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert sorted((tuple(r) for r in cr.repaired_after_damage(df).collect()), key=repr) == expected(rows)


@pytest.mark.parametrize("segment", [2, 8, 128])
def test_random_conversations(spark, monkeypatch, segment):
    monkeypatch.setattr(cr, "SEGMENT", segment)
    rnd = random.Random(segment)
    rows = [r for conv in range(40) for r in talk(rnd, conv, rnd.randrange(1, 12))]
    rows += talk(rnd, 99, 300) + talk(rnd, 98, 260, ("user",)) + talk(rnd, 97, 200, ("system", "tool"))
    rows += [(96, t, "user", "Same.") for t in range(200)]
    assert found(spark, rows) == expected(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "a."), (1, None, "user", "a."), (1, 2, "assistant", None)]
    rows += [(2, 5, "user", "b.")] * 40 + [(3, 2**62, "user", "c."), (3, -(2**62), "assistant", "ä\U0001f600!")]
    rows += [(i, i, "user", "d.") for i in range(100, 160)]  # some lose their only row
    got = found(spark, rows)
    assert got == expected(rows)
    assert any(r[1:8] == (0, 0, 0, 0, 0, 0, "") for r in got)
    assert found(spark, []) == []


def test_search_between_states():
    rows = [("u", "-"), ("u", "-")]
    assert cr.cheapest(rows, 0, cr.ACCEPT) == (2, "KR")
    assert cr.cheapest(rows, 3, 0) is None and cr.cheapest(rows, 0, 0) == (6, "DD")
    assert cr.cheapest([], 2, cr.ACCEPT) == (2, "I")
    assert cr.applied(rows, 0, "KIKI") == ["K", "aK", "a"]


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hm"), (1, 2, "tool", " ")], "c long, turn long, role string, text string")
    result, repaired = cr.repair(df)
    assert result.first().audit == "KRD" and result.first().cost == 6
    assert [tuple(r)[3:] for r in repaired.orderBy("pos", "place").collect()] == [("user", "Hi."), ("assistant", "Hm")]
