"""Secrets in texts, and weak candidates that count only where complementary parts meet.

Sure patterns are found text by text. A value that merely looks like a key, or a user name that is
set somewhere, is weak evidence: it is reported only if its counterpart lies in the same scope. The
counterparts are linked by an interval join over pieces of the text, so that a document with any
number of parts is spread over many tasks.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoscan.llm.common import slices, stored

# The sure patterns and the fewest characters of their values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# runs of hex digits are maximal, so that asking for the least number drops just the short ones
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
#: Kinds in the order in which spans of equal start are listed; the last two are weak.
KINDS = ("assign", "access", "hex", "identifier", "key")
WEAK = KINDS[3:]

#: Names that identify an account, where they are set to a value.
IDENTIFIER = re.compile(
    r"""\b(user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?key_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""",
    re.IGNORECASE | re.ASCII,
)
#: A run of key characters that mixes cases and digits, as random keys do and words don't.
KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}", re.ASCII)
DISTINCT = 12
ENDPOINT = re.compile(
    r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|\b(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:_-]{3,}|\b\d{1,3}(?:\.\d{1,3}){3}:\d{1,5}\b""",
    re.IGNORECASE | re.ASCII,
)
#: A scope is a paragraph; in it, parts with at most so many characters between them belong together.
REACH = 200
PIECE = 512
_BREAK = re.compile(r"\n[\x20\t\r]*\n")
_HINTS = ("passw", "secret", "token", "api")

SPAN = "struct<start: long, rank: int, kind: string, end: long>"
PART = "struct<secret: boolean, kind: string, scope: long, start: long, end: long>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the sure patterns, kind by kind."""
    lower = text.lower()
    out = []
    if any(hint in lower for hint in _HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def _mixed(value: str) -> bool:
    """Whether a run looks drawn at random: two digits, capitals and small letters at least, few characters twice."""
    digits, upper = sum(map(str.isdigit, value)), sum(map(str.isupper, value))
    return digits >= 2 and upper >= 2 and sum(map(str.islower, value)) >= 2 and len(set(value)) >= DISTINCT


def weak_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates of both weak kinds, and endpoints; none overlaps a sure one, and no key an endpoint."""
    endpoints = [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    names = [("identifier", *m.span()) for m in IDENTIFIER.finditer(text)]
    keys = [("key", *m.span()) for m in KEY.finditer(text) if _mixed(m[0])]
    return _apart(endpoints + names, base) + _apart(keys, base + endpoints)


def _apart(spans: list[tuple[str, int, int]], others: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The ``spans`` that overlap none of ``others``."""
    ends = sorted((a, b) for _, a, b in others)
    starts, reach, far = [a for a, _ in ends], [0], 0
    for _, b in ends:
        far = max(far, b)
        reach.append(far)  # the furthest end up to each start
    return [(kind, a, b) for kind, a, b in spans if reach[bisect_right(starts, b - 1)] <= a]


def parts_of(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """What may be linked; nothing if the document lacks secrets, counterparts, or weak candidates."""
    weak = weak_spans(text, base)
    if not any(kind in WEAK for kind, _, _ in weak):
        return []
    breaks = [m.start() for m in _BREAK.finditer(text)]
    parts = [
        {"secret": kind in ("assign", "hex", "key"), "kind": kind, "scope": bisect_right(breaks, a), "start": a, "end": b}
        for kind, a, b in (*base, *weak)
    ]
    return parts if len({p["secret"] for p in parts}) == 2 else []


def _found(batches):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64())]))
    parts = pa.list_(pa.struct([("secret", pa.bool_()), ("kind", pa.string()), ("scope", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for part in slices(batch, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            rows = [sorted(({"start": a, "rank": KINDS.index(k), "kind": k, "end": b} for k, a, b in x), key=lambda s: (s["start"], s["rank"])) for x in base]
            links = [parts_of(t, x) for t, x in zip(texts, base, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rows, spans), pa.array(links, parts)], names=["id", "base", "parts"])


def _pieces(start: Column, end: Column) -> Column:
    """Numbers of the pieces of the text that an interval touches."""
    return F.sequence(F.floor(start / PIECE), F.floor((end - 1) / PIECE))


def linked(parts: DataFrame) -> DataFrame:
    """The weak candidates of ``parts`` (k, secret, kind, scope, start, end) that lie near a counterpart.

    A secret and an identifier or endpoint of one scope are counterparts if at most ``REACH``
    characters lie between them. Both sides are cut into pieces of the text. Spans of a kind don't overlap,
    so that a piece holds a bounded number of them, whatever the document holds.
    """
    secrets = parts.filter("secret").withColumn("piece", F.explode(_pieces(F.col("start") - REACH, F.col("end") + REACH)))
    others = parts.filter("not secret").withColumn("piece", F.explode(_pieces(F.col("start"), F.col("end"))))
    near = F.expr(f"s.k = o.k and s.scope = o.scope and s.piece = o.piece and s.start - o.end <= {REACH} and o.start - s.end <= {REACH}")
    met = secrets.alias("s").join(others.alias("o"), near)
    both = F.explode(F.array(*[F.struct(F.col(f"{x}.k").alias("k"), F.col(f"{x}.kind").alias("kind"), F.col(f"{x}.start").alias("start"), F.col(f"{x}.end").alias("end")) for x in "so"]))
    return met.select(both.alias("p")).select("p.*").filter(F.col("kind").isin(*WEAK)).distinct()


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``base``, ``spans``) of every row of ``docs``: arrays of (start, rank, kind, end) in order.

    ``base`` are the spans of the sure patterns, leftmost and not overlapping within a kind; ``spans``
    adds the weak candidates with a counterpart in their scope. Places are code points, the end is
    exclusive, equal starts are in the order of ``KINDS``. Whole texts are read once and never shuffled.
    A null or empty text has no spans. Rows keep null and repeated ids, each with the spans of its own text; other
    columns are ignored. An empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        _found, f"id {kind}, base array<{SPAN}>, parts array<{PART}>"
    )
    # the numbers are written, so that every later use reads the same
    found = stored(found.withColumn("k", F.monotonically_increasing_id()), "secrets")
    parts = found.select("k", F.explode("parts").alias("p")).select("k", "p.*")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    added = linked(parts).groupBy("k").agg(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end")).alias("added"))
    spans = F.coalesce(F.array_sort(F.concat("base", "added")), F.col("base"))
    return found.join(added, "k", "left").select(F.col("id").alias(id_col), "base", spans.alias("spans"))


def listed(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
