"""Windows that repeat across a corpus, found without shuffling every window.

The sequence of a document is cut at content-defined anchors (:mod:`anchors`). An anchor and the
windows it stands for form a *context*. The work goes in four steps, each bounded in memory:

1. every task hashes its anchors and contexts. Contexts of equal hash in one task are compared
   symbol by symbol; of equal ones only the earliest is sent on, and the spans of the others are
   noted at once. A context thus comes once from each combined part of a task, however many copies there are;
2. contexts meet by anchor. Those alone with their anchor are done, the others are needed; without
   ``whole_copies`` those of equal hash (anchor and context, 64 bits each) count as equal here;
3. these are cut from the texts. Contexts of equal hash are compared again, byte by byte, and
   form classes. ``refine`` (the suffix structure of the operator) gets each class as one set of
   suffixes with its count, all classes of an anchor together, and decides which windows repeat. An
   anchor with very many distinct contexts (``HOT``) isn't gathered: its windows are sent out singly
   by two independent 64-bit hashes of the whole window, with the same combining per task;
4. the spans of a document are joined with its text.

"Earlier" means a smaller key, or with ``same_doc`` also the same key and an earlier start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promoscan.llm.anchors import RangeHash, anchor_runs, byte_grams, mix, symbol_grams
from promoscan.llm.common import lean, slices, split_words

#: More distinct contexts of an anchor than these in one task, or over all, make it hot.
HOT_IN_TASK, HOT = 64, 4096
#: Anchors that a task combines at a time, and context symbols compared at a time.
COMBINE, COMPARE = 1 << 19, 1 << 20
#: Bytes of text whose anchors are sought at a time; each takes some hundred bytes of arrays.
SOUGHT = 1 << 20
SPAN, MARK, SOME, MANY = 0, 1, 2, 3
_PART_OF_HASH = np.uint64(0xFFFFFFFF)

_ROWS = "route long, kind byte, g long, k long, at long"
_PARTS = "k long, kind byte, a long, b long"
_CONTEXTS = _ROWS + ", context binary"


@dataclass(frozen=True)
class Windows:
    """What a window is: ``width`` symbols, anchored by grams of ``gram``; words or bytes.

    With ``whole_copies`` the texts of all contexts that recur are sent to the structure, otherwise
    those of different contexts of an anchor only.

    Raises ValueError if a window reaches further from its anchor than ``_pack`` holds.
    """

    width: int
    gram: int
    words: bool
    same_doc: bool
    whole_copies: bool = True

    def __post_init__(self):
        if self.width - self.gram > 255:
            raise ValueError(f"a width of {self.width} is too large, {self.gram + 255} at most")

    @property
    def count(self) -> int:
        return self.width - self.gram + 1

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Callable[[int, int], bytes]]:
        """All symbols, where each document starts (with the end), and the text of a range of symbols."""
        if self.words:
            parts = [split_words(t) for t in texts.to_pylist()]
            tokens = [x for p in parts for x in p]
            starts = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
            return word_hashes(tokens), starts, lambda a, b: b" ".join(tokens[a:b])
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = texts.buffers()[2]
        data = np.frombuffer(whole, np.uint8) if whole is not None else np.empty(0, np.uint8)
        data = data[offsets[0] : offsets[-1]]
        return data, offsets - offsets[0], lambda a, b: data[a:b].tobytes()

    def sizes(self, ranges: pa.Array) -> np.ndarray:
        """Symbols in each text of a range."""
        found = pc.add(pc.count_substring(ranges, pattern=" "), 1) if self.words else pc.binary_length(ranges)
        return found.to_numpy(zero_copy_only=False).astype(np.int64)

    def joined(self, ranges: pa.Array) -> np.ndarray:
        """The symbols of all ranges in a row."""
        if self.words:
            return word_hashes([x for r in ranges.to_pylist() for x in r.split(b" ")])
        return np.frombuffer(b"".join(ranges.to_pylist()), np.uint8)

    def grams(self, data: np.ndarray) -> np.ndarray:
        return (symbol_grams if self.words else byte_grams)(data, self.gram)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words. Nothing is cached: invented words are many, and a cache is no faster."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def merged(k: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans [a, b) of each k."""
    if not len(k):
        return k, a, b
    order = np.lexsort((a, k))
    k, a, b = k[order], a[order], b[order]
    new_k = np.concatenate(([True], k[1:] != k[:-1]))
    # the furthest end so far within a key: keys in order get disjoint ranges
    lift = np.cumsum(new_k) * (int(b.max()) + 1)
    reach = np.maximum.accumulate(b + lift)
    new = np.concatenate(([True], (a + lift)[1:] > reach[:-1])) | new_k
    last = np.concatenate((new[1:], [True]))
    return k[new], a[new], (reach - lift)[last]


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


_ROW_SCHEMA = pa.schema([("route", pa.int64()), ("kind", pa.int8()), ("g", pa.int64()), ("k", pa.int64()), ("at", pa.int64())])
_PART_SCHEMA = pa.schema([("k", pa.int64()), ("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64())])
_CONTEXT_SCHEMA = _ROW_SCHEMA.append(pa.field("context", pa.binary()))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _rows(route, kind, g, k, at) -> pa.RecordBatch:
    n = len(route)
    return _batch(_ROW_SCHEMA, _signed(route), np.full(n, kind, np.int8), _signed(g), k, at)


def _span_rows(k, a, b) -> pa.RecordBatch:
    k, a, b = merged(k, a, b)
    return _rows(mix(k.astype(np.uint64)), SPAN, a, k, b)


def _pack(at, first, last):
    return (at << 16) | ((at - first) << 8) | (at - last)


def _window_bounds(packed):
    at = packed >> 16
    return at - ((packed >> 8) & 255), at - (packed & 255)


def _firsts(keys: list[np.ndarray], k: np.ndarray, at: np.ndarray, same_doc: bool):
    """Order by (keys, k, at); (order, new key here, this row is earliest of its key)."""
    order = np.lexsort((at, k, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in keys:
        x = x[order]
        new[1:] |= x[1:] != x[:-1]
    if same_doc:
        return order, new, new
    ks = k[order]
    return order, new, ks == ks[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]


def _run_starts(new: np.ndarray) -> np.ndarray:
    """For each row the first row of its run."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """``parts`` in a row; the list is emptied, so that they go once nothing else holds them."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def _columns_of(held: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """The columns of all ``held`` parts, which are let go one column after the other."""
    columns = [list(c) for c in zip(*held, strict=True)]
    held.clear()
    return [_joined(c) for c in columns]


def equal_ranges(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` symbols (one or more) at a and at b are the same, a bounded number at a time."""
    out = np.empty(len(a), bool)
    ends = np.cumsum(size)
    low = 0
    while low < len(a):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + COMPARE, side="right")))
        n = size[low:high]
        base = np.cumsum(n) - n
        inner = np.arange(n.sum()) - np.repeat(base, n)
        same = data[np.repeat(a[low:high], n) + inner] == data[np.repeat(b[low:high], n) + inner]
        out[low:high] = np.logical_and.reduceat(same, base)
        low = high
    return out


def anchor_rows(w: Windows):
    """Step 1, per partition of (key, text)."""

    def combine(data, h, g, k, at, start) -> Iterator[pa.RecordBatch]:
        order, new, first = _firsts([h, g], k, at, w.same_doc)
        h, g, k, at, start = h[order], g[order], k[order], at[order], start[order]
        later = np.flatnonzero(~first)
        of = _run_starts(new)[later]
        alike = (at[later] & 0xFFFF) == (at[of] & 0xFFFF)
        low, high = _window_bounds(at[later])
        alike[alike] = equal_ranges(data, start[later[alike]], start[of[alike]], (high - low + w.width)[alike])
        # a context of equal hash that differs goes on as one of its own
        first[later[~alike]] = True
        yield _span_rows(k[later[alike]], low[alike], high[alike] + w.width)
        new_h = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        group = np.cumsum(new_h) - 1
        hot = np.bincount(group, weights=new) > HOT_IN_TASK
        many = hot[group]
        yield _rows(h[new_h & many], MARK, np.zeros((new_h & many).sum()), k[new_h & many], at[new_h & many])
        x = first & ~many
        # part of the hash is enough where contexts of equal hash are compared
        yield _rows(h[x], SOME, g[x] & _PART_OF_HASH if w.whole_copies else g[x], k[x], at[x])
        x = first & many
        yield _rows(mix(h[x] ^ mix(g[x])), MANY, g[x], k[x], at[x])

    def run(batches):
        held, texts, size, symbols = [], [], 0, 0
        for batch in batches:
            for part in slices(batch, "text", SOUGHT):
                keys = part.column("k").to_numpy()
                data, starts, _ = w.read(part.column("text"))
                grams = w.grams(data)
                at, first, last = anchor_runs(grams, w.count, w.width, starts)
                if not len(at):
                    continue
                doc = np.searchsorted(starts, first, side="right") - 1
                g = RangeHash(data)(first, last + w.width, at - first)
                packed = _pack(at - starts[doc], first - starts[doc], last - starts[doc])
                held.append((grams[at], g, keys[doc], packed, first + symbols))
                texts.append(data)
                size, symbols = size + len(at), symbols + len(data)
                if size >= COMBINE:
                    yield from combine(_joined(texts), *_columns_of(held))
                    size, symbols = 0, 0
        if held:
            yield from combine(_joined(texts), *_columns_of(held))

    return lean(run)


def whole_groups(batches, limit: int, weight: Callable | None = None):
    """Sorted batches regrouped so that rows of one route stay together: (table, split route).

    A route of over ``limit`` is cut between different g; its parts are then marked as split.
    """
    held: list[pa.Table] = []
    size, split = 0, None
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            size += weight(batch) if weight else batch.num_rows
        if size < limit:
            continue
        table = pa.concat_tables(held).combine_chunks()
        route = table.column("route").to_numpy()
        bounds = _changes(route)
        cut = int(bounds[-1]) if len(bounds) else 0
        if cut:
            yield table.slice(0, cut), split
            split = None if split is not None and route[cut] != split else split
        elif size >= 4 * limit:
            inner = _changes(table.column("g").to_numpy())
            cut = int(inner[-1]) if len(inner) else 0
            if cut:
                split = int(route[0])
                yield table.slice(0, cut), split
        held = [table.slice(cut)]
        size = weight(held[0]) if weight else held[0].num_rows
    if held:
        yield pa.concat_tables(held).combine_chunks(), split


def _changes(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(x[1:] != x[:-1]) + 1


def _columns(table: pa.Table, *names):
    return [table.column(n).to_numpy() for n in names]


def meet(w: Windows):
    """Step 2, per partition sorted by (route, kind, g, k, at)."""

    def run(batches):
        for table, split in whole_groups(batches, 1 << 18):
            route, kind, g, k, at = _columns(table, "route", "kind", "g", "k", "at")
            x = kind == SPAN
            yield _batch(_PART_SCHEMA, k[x], np.full(x.sum(), SPAN, np.int8), g[x], at[x])
            group = np.concatenate(([0], np.cumsum(route[1:] != route[:-1])))
            marked = np.bincount(group, weights=kind == MARK) > 0
            if split is not None:
                marked[group[route == split]] = True
            y = kind >= SOME
            group, kind, g, k, at = group[y], kind[y], g[y], k[y], at[y]
            if not len(g):
                continue
            order, new, first = _firsts([group, kind, g], k, at, w.same_doc)
            group, kind, g, k, at = group[order], kind[order], g[order], k[order], at[order]
            distinct = np.bincount(group, weights=new, minlength=len(marked))
            many = (marked | (distinct > HOT))[group] | (kind == MANY)
            copies = ~first if not w.whole_copies else (kind == MANY) & ~first
            low, high = _window_bounds(at[copies])
            mk, ma, mb = merged(k[copies], low, high + w.width)
            yield _batch(_PART_SCHEMA, mk, np.full(len(mk), SPAN, np.int8), ma, mb)
            # of a class alone with its anchor one row of the first document will do
            repeated = np.bincount(group, weights=~first, minlength=len(marked)) > 0
            need = ~copies & (many | (distinct[group] > 1) | (w.whole_copies & repeated[group] & (new | ~first)))
            yield _batch(_PART_SCHEMA, k[need], np.where(many, MANY, SOME)[need].astype(np.int8), at[need], g[need])

    return lean(run)


def contexts(w: Windows):
    """Step 3a, per partition of (key, text, needs): contexts, and single windows of hot anchors."""

    def combine(h1, h2, k, p) -> Iterator[pa.RecordBatch]:
        order, _, first = _firsts([h1, h2], k, p, w.same_doc)
        h1, h2, k, p = h1[order], h2[order], k[order], p[order]
        spans = _span_rows(k[~first], p[~first], p[~first] + w.width)
        for rows in (spans, _rows(h1[first], MANY, h2[first], k[first], p[first])):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(rows.num_rows, pa.binary())], schema=_CONTEXT_SCHEMA)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text", SOUGHT):
                data, starts, text = w.read(part.column("text"))
                needs = part.column("needs")
                count = np.diff(needs.offsets.to_numpy())
                doc = np.repeat(np.arange(part.num_rows), count)
                flat = needs.flatten()
                kind, at, g = (flat.field(n).to_numpy() for n in ("kind", "a", "b"))
                key = part.column("k").to_numpy()[doc]
                low, high = _window_bounds(at)
                low, high = low + starts[doc], high + starts[doc]
                x = kind == SOME
                if x.any():
                    h = w.grams(data)[(at[x] >> 16) + starts[doc[x]]]
                    raw = [text(a, b + w.width) for a, b in zip(low[x], high[x], strict=True)]
                    n = int(x.sum())
                    yield _batch(_CONTEXT_SCHEMA, _signed(h), np.full(n, SOME, np.int8), g[x], key[x], low[x] - starts[doc[x]], pa.array(raw, pa.binary()))
                x = ~x
                if x.any():
                    n = high[x] - low[x] + 1
                    at = np.repeat(low[x] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    d = np.repeat(doc[x], n)
                    h1, h2 = (RangeHash(data, base)(at, at + w.width) for base in (0, 1))
                    held.append((h1, h2, np.repeat(key[x], n), at - starts[d]))
                    size += len(at)
                    if size >= COMBINE:
                        yield from combine(*_columns_of(held))
                        size = 0
        if held:
            yield from combine(*_columns_of(held))

    return lean(run)


def compare(w: Windows, refine: Callable):
    """Step 3b, per partition sorted by (route, kind, g, k, at): spans of windows that repeat."""

    def spans(k, p):
        mk, ma, mb = merged(k, p, p + w.width)
        return _batch(_PART_SCHEMA, mk, np.full(len(mk), SPAN, np.int8), ma, mb)

    def weight(x):
        return x.num_rows * 16 + x.column("context").nbytes // (4 if w.words else 1)

    def classes(some: pa.Table):
        """Rows that enter the structure, with the number of equal contexts; the others, as copies."""
        route, g, k = _columns(some, "route", "g", "k")
        raw = some.column("context").combine_chunks()
        new = np.concatenate(([True], (route[1:] != route[:-1]) | (g[1:] != g[:-1])))
        of = _run_starts(new)
        later = np.flatnonzero(~new if w.same_doc else k != k[of])
        same = pc.equal(raw.take(pa.array(later)), raw.take(pa.array(of[later]))).to_numpy(zero_copy_only=False)
        copy = np.zeros(len(k), bool)
        copy[later[same]] = True
        count = 1 + np.bincount(of[copy], minlength=len(k))
        return some.append_column("count", pa.array(count)).filter(pa.array(~copy)), some.filter(pa.array(copy))

    def decide(some: pa.Table):
        k, low, count = _columns(some, "k", "at", "count")
        raw = some.column("context").combine_chunks()
        size, data = w.sizes(raw), w.joined(raw)
        base = np.cumsum(size) - size
        n = size - w.width + 1
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(base, n) + inner
        node = refine(data, start, w.width, np.repeat(count, n))
        keep = node >= 0
        k, p, node = np.repeat(k, n)[keep], (np.repeat(low, n) + inner)[keep], node[keep]
        order, _, first = _firsts([node], k, p, w.same_doc)
        later = order[~first]
        return spans(k[later], p[later])

    def run(batches):
        # classes of the last anchor so far, which may go on in the next table
        open_rows: pa.Table | None = None
        # a first window of a g that was cut off in the last table is no first here
        for table, _ in whole_groups(batches, COMPARE, weight):
            kind = table.column("kind").to_numpy()
            x = kind == SPAN
            if x.any():
                k, a, b = _columns(table.filter(pa.array(x)), "k", "g", "at")
                yield _batch(_PART_SCHEMA, k, np.full(len(k), SPAN, np.int8), a, b)
            x = kind == MANY
            if x.any():
                route, g, k, p = _columns(table.filter(pa.array(x)), "route", "g", "k", "at")
                order, _, first = _firsts([route, g], k, p, w.same_doc)
                later = order[~first]
                yield spans(k[later], p[later])
            x = kind == SOME
            if x.any():
                some, copies = classes(table.filter(pa.array(x)))
                # a copy shares every suffix of its class, which counts two or more
                k, low = _columns(copies, "k", "at")
                mk, ma, mb = merged(k, low, low + w.sizes(copies.column("context").combine_chunks()))
                yield _batch(_PART_SCHEMA, mk, np.full(len(mk), SPAN, np.int8), ma, mb)
                if open_rows is not None:
                    some = pa.concat_tables([open_rows, some])
                route = some.column("route").to_numpy()
                ended = int(np.searchsorted(route, route[-1]))
                if ended:
                    yield decide(some.slice(0, ended))
                open_rows = some.slice(ended)
        if open_rows is not None:
            yield decide(open_rows)

    return lean(run)


def with_repeats(docs: DataFrame, w: Windows, refine: Callable) -> DataFrame:
    """``docs`` (k long, text string, row struct) with ``spans``: array of (a, b), maybe null."""
    order = ["route", "kind", "g", "k", "at"]
    rows = docs.select("k", "text").mapInArrow(anchor_rows(w), _ROWS)
    parts = rows.repartition("route").sortWithinPartitions(*order).mapInArrow(meet(w), _PARTS)
    needs = parts.filter(F.col("kind") >= SOME).groupBy("k").agg(F.collect_list(F.struct("kind", "a", "b")).alias("needs"))
    # all columns of docs go along in both joins, so that Spark shuffles the texts once
    cut = docs.join(needs, "k").select(*docs.columns, "needs").mapInArrow(contexts(w), _CONTEXTS)
    found = cut.repartition("route").sortWithinPartitions(*order).mapInArrow(compare(w, refine), _PARTS)
    spans = (
        parts.filter(F.col("kind") == SPAN)
        .unionByName(found)
        .groupBy("k")
        .agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    )
    return docs.join(spans, "k", "left")


def union_of(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The spans of one document as disjoint runs in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
