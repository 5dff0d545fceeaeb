"""SentencePiece merge-type encoding by a score-ordered agenda of adjacent symbol pairs, and decoding.

Text becomes units that start with the space mark; as no piece has the mark after another character,
no merge crosses from one unit to the next, and units can be encoded apart and cached. Within a
unit, all adjacent pairs that form a piece wait in an agenda; the best score merges first, the
leftmost among equals, and each merge puts its two new neighbours on the agenda. The agendas of all new
units of a slice of texts are rows of arrays and take their merges in step. What isn't a piece falls back
to bytes. In every Arrow batch, each unit that is new to the worker and one whole document are
checked against the sentencepiece library, in both directions; on a difference the library's
answer is taken and counted in ``n_corrected`` (of the first document of the slice, for units).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscan.llm.common import lean, slices

MARK = "▁"
UNITS = re.compile(f"{MARK}+[^{MARK}]*")
CACHED_UNITS = 1_000_000
#: Units of more characters than these are forgotten after the text that brought them; all others
#: when the cache is estimated to hold more bytes than these.
LONGEST_KEPT, CACHE_BYTES, ENTRY_BYTES = 64, 100_000_000, 200
#: Agendas of units of up to so many symbols are rows of one array, so many at a time; those of longer units are heaps.
WIDTHS, ROWS = (8, 16, 32, LONGEST_KEPT + 1), 1 << 14
_NEVER = np.iinfo(np.int32).max


class Codec:
    """Encoder and decoder of one model; raises ValueError if the model isn't of the merge type.

    It caches ``CACHED_UNITS`` units of ``LONGEST_KEPT`` characters at most, and longer ones (whole
    paragraphs, in text without spaces) only while the texts at hand are encoded. Beyond ``CACHE_BYTES``
    and at the end of a partition it is emptied.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        sp = self.library
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = {i for i in range(len(names)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)}
        self.rank = {p: (-sp.get_score(i), i) for i, p in enumerate(names) if i not in special}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece goes over the end of a word")
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(sp.is_byte(i) for i in byte_ids):
            raise ValueError("the model has no byte pieces")
        self.byte_ids, self.first, self.last = byte_ids, sp.bos_id(), sp.eos_id()
        self.bytes = [b"" if sp.is_control(i) else bytes([byte_ids.index(i)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.bytes[sp.unk_id()] = " ⁇ ".encode()
        self.plain = [i not in special for i in range(len(names))]
        self.shows = np.array([bool(b) or p for b, p in zip(self.bytes, self.plain, strict=True)])
        self.texts = pa.array(self.bytes, pa.large_binary())
        self._tables(len(names))
        self.units: dict[str, bytes] = {}
        self.held = 0
        self.corrected = 0

    def _tables(self, n: int) -> None:
        """Symbols as numbers (pieces by id, other characters from ``n`` on), and which pairs form which piece."""
        self.n_pieces, self.n_symbols = n, n + 0x110000
        self.symbol = np.arange(n, self.n_symbols)
        for piece, (_, i) in self.rank.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i

        def number(part: str) -> int | None:
            return int(self.symbol[ord(part)]) if len(part) == 1 else self.rank[part][1] if part in self.rank else None

        order = {score: at for at, score in enumerate(sorted({score for score, _ in self.rank.values()}))}
        found = []
        for piece, (score, i) in self.rank.items():
            for cut in range(1, len(piece)):
                left, right = number(piece[:cut]), number(piece[cut:])
                if left is not None and right is not None:
                    found.append((left * self.n_symbols + right, order[score], i))
        found.append((self.n_symbols**2, _NEVER, 0))  # above all pairs, so that each search ends on an entry
        self.pairs, turns, joined = np.array(sorted(found), np.int64).T.copy()
        self.turns, self.joined = turns.astype(np.int32), joined

    def encode_unit(self, unit: str) -> list[int]:
        rank = self.rank
        if unit in rank and len(unit) == 1:
            return [rank[unit][1]]
        symbols: list[str | None] = list(unit)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            found = rank.get(symbols[i] + symbols[i + 1])
            if found:
                agenda.append((found[0], i, symbols[i] + symbols[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] is None or j >= n or len(piece) != len(symbols[i]) + len(symbols[j]):
                continue  # one of the two has merged meanwhile
            symbols[i], symbols[j] = piece, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                joined = piece + symbols[k]
                if joined in rank:
                    heapq.heappush(agenda, (rank[joined][0], i, joined))
            h = before[i]
            if h >= 0:
                joined = symbols[h] + piece
                if joined in rank:
                    heapq.heappush(agenda, (rank[joined][0], h, joined))
        ids: list[int] = []
        for s in symbols:
            if s is not None:
                found = rank.get(s)
                ids.extend([found[1]] if found else [self.byte_ids[b] for b in s.encode()])
        return ids

    def split(self, text: str) -> list[str]:
        """Units of a text, without their first mark."""
        if MARK not in text and "  " not in text and text[0] != " ":
            return text.split(" ")
        return [u[1:] for u in UNITS.findall(MARK + text.replace(" ", MARK))]

    def _turn(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """When pairs of symbols merge (``_NEVER`` if they form no piece), and into what."""
        key = left * self.n_symbols + right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.turns[at], _NEVER), self.joined[at]

    def _agendas(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of units, one after the other, and how many of each.

        ``codes`` has a unit's characters in a row, of which the first ``size`` count. Columns of the
        agenda are the places of left symbols; each round merges the best pair of each row.
        """
        n, width = codes.shape
        symbols = np.zeros((n, width + 2), np.int64)  # a place before and one after, which pair with nothing
        symbols[:, 1:-1] = self.symbol[codes]
        places = np.arange(width + 2)
        alive = (places > 0) & (places <= size[:, None])
        symbols[~alive] = self.n_symbols - 1
        before, after = (np.tile(places + d, (n, 1)).astype(np.int32) for d in (-1, 1))
        agenda, joined = np.full((n, width + 2), _NEVER, np.int32), np.zeros((n, width + 2), np.int32)
        r, c = np.nonzero(alive[:, :-1] & alive[:, 1:])
        agenda[r, c], joined[r, c] = self._turn(symbols[r, c], symbols[r, c + 1])
        rows = np.arange(n)
        while len(rows):
            some = agenda[rows]
            i = some.argmin(axis=1)  # the leftmost of equals
            open_ = some[np.arange(len(rows)), i] != _NEVER
            rows, i = rows[open_], i[open_]
            j = after[rows, i]
            k = after[rows, j]
            symbols[rows, i] = joined[rows, i]
            alive[rows, j] = False
            agenda[rows, j] = _NEVER
            after[rows, i] = k
            before[rows, k] = i
            h = before[rows, i]
            agenda[rows, i], joined[rows, i] = self._turn(symbols[rows, i], symbols[rows, k])
            agenda[rows, h], joined[rows, h] = self._turn(symbols[rows, h], symbols[rows, i])
        return symbols[alive], alive.sum(axis=1)

    def _symbol_ids(self, symbol: int) -> bytes:
        ids = [symbol] if symbol < self.n_pieces else [self.byte_ids[b] for b in chr(symbol - self.n_pieces).encode()]
        return np.array(ids, "<u4").tobytes()

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit, given with its mark; long units go singly."""
        out: list[bytes | None] = [None] * len(units)
        sizes = np.array([len(u) for u in units])
        codes = np.frombuffer("".join(units).encode("utf-32-le"), "<u4")
        starts = np.cumsum(sizes) - sizes
        for low, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            which = np.flatnonzero((sizes > low) & (sizes <= width))
            if not len(which):
                continue
            at = starts[which, None] + np.arange(width)
            left, n = self._agendas(codes[np.minimum(at, len(codes) - 1)], sizes[which])
            stops = np.cumsum(n)
            whole = np.add.reduceat(left >= self.n_pieces, stops - n) == 0
            ids = left.astype("<u4").tobytes()
            for w, a, b, ok in zip(which.tolist(), (4 * (stops - n)).tolist(), (4 * stops).tolist(), whole.tolist(), strict=True):
                out[w] = ids[a:b] if ok else b"".join(map(self._symbol_ids, left[a // 4 : b // 4].tolist()))
        return [np.array(self.encode_unit(u), "<u4").tobytes() if x is None else x for u, x in zip(units, out, strict=True)]

    def forget(self) -> None:
        """Empty the cache."""
        self.units.clear()
        self.held = 0

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Encode units that aren't cached and check them against the library; keeps those that aren't long."""
        if len(self.units) + len(new) > CACHED_UNITS or self.held > CACHE_BYTES:
            self.forget()
        found = [x for low in range(0, len(new), ROWS) for x in self.encode_units([MARK + u for u in new[low : low + ROWS]])]
        expected = self.library.encode([u.replace(MARK, " ") for u in new], num_threads=1)
        right = np.fromiter(chain.from_iterable(expected), "<u4").tobytes()
        stops = [4 * n for n in accumulate(map(len, expected), initial=0)]
        for at, unit in enumerate(new):
            ids = right[stops[at] : stops[at + 1]]
            if unit and found[at] != ids:
                self.corrected += 1
                found[at] = ids
        learnt = dict(zip(new, found, strict=True))
        kept = {u: x for u, x in learnt.items() if len(u) <= LONGEST_KEPT} if max(map(len, new)) > LONGEST_KEPT else learnt
        self.units.update(kept)
        self.held += ENTRY_BYTES * len(kept) + 4 * sum(map(len, kept)) + sum(map(len, kept.values()))
        return learnt

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text with the begin and the end id. New units of all texts are encoded together."""
        parts, gaps = [], []
        for text in texts:
            units = self.split(text) if text else []
            found = list(map(self.units.get, units))
            parts.append(found)
            if None in found:
                gaps += [(found, at, units[at]) for at, x in enumerate(found) if x is None]
        if gaps:
            learnt = self.learn(list(dict.fromkeys(unit for _, _, unit in gaps)))
            for found, at, unit in gaps:
                found[at] = learnt[unit]
        first, last = (np.array([i], "<u4").tobytes() for i in (self.first, self.last))
        return [np.frombuffer(b"".join([first, *found, last]), "<u4") for found in parts]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text with the begin and the end id."""
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """Text of any ids: control ids vanish, the first mark too, a wrong byte becomes U+FFFD."""
        raw = self.texts.take(pa.array(ids)).buffers()[2]
        raw = raw.to_pybytes() if raw else b""
        first = next((i for i in ids[:8].tolist() if self.shows[i]), None)
        if first is None:
            first = next((i for i in ids.tolist() if self.shows[i]), None)
        if first is not None and self.plain[first] and raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return "".join(_valid_or_replaced(raw))


def _valid_or_replaced(raw: bytes):
    while raw:
        try:
            yield raw.decode()
            return
        except UnicodeDecodeError as e:
            yield raw[: e.start].decode() + "�"
            raw = raw[e.start + 1 :]


_codecs: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def _encode(model_file: str, with_ids: bool, with_text: bool):
    def run(batches):
        c = codec(model_file)
        for batch in batches:
            for at, part in enumerate(slices(batch, "text")):
                all_ids, ids_sha, text_sha, texts = [], [], [], []
                c.corrected = 0
                found = part.column("text").to_pylist()
                for i, (text, ids) in enumerate(zip(found, c.encode_all(found), strict=True)):
                    decoded = c.decode(ids)
                    if at == i == 0:
                        right = c.library.encode(text or "", add_bos=True, add_eos=True, num_threads=1)
                        if ids.tolist() != right:
                            ids, c.corrected = np.array(right, "<u4"), c.corrected + 1
                        right_text = c.library.decode(right)
                        if decoded != right_text:
                            decoded, c.corrected = right_text, c.corrected + 1
                    all_ids.append(ids)
                    ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_text:
                        texts.append(decoded)
                n_tokens = np.array([len(x) for x in all_ids], np.int64)
                corrected = [c.corrected] + [0] * (len(all_ids) - 1)
                columns = [part.column("row"), pa.array(n_tokens), pa.array(ids_sha), pa.array(text_sha), pa.array(corrected, pa.int64())]
                names = ["row", "n_tokens", "ids_sha256", "decoded_sha256", "n_corrected"]
                if with_ids:
                    stops = pa.array(np.concatenate(([0], np.cumsum(n_tokens))).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(stops, pa.array(np.concatenate(all_ids).astype(np.int32))))
                    names.append("ids")
                if with_text:
                    columns.append(pa.array(texts, pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        # most units are met in one partition only, so that the next gains little by them
        c.forget()

    return lean(run)


def sentencepiece_round_trip(docs: DataFrame, model_file: str, text_col: str = "text", carry: list[str] | None = None, with_ids: bool = False, with_text: bool | None = None) -> DataFrame:
    """Encode and decode every text of ``docs`` in place; nothing is shuffled.

    One row per input row: ``row`` (struct of the columns ``carry``, all by default), ``n_tokens`` with
    begin and end ids, ``ids_sha256`` (ids as little-endian unsigned 32-bit integers), ``decoded_sha256``,
    ``n_corrected``, with ``with_ids`` also ``ids`` and with ``with_text`` (unless given, as ``with_ids``)
    also ``decoded``. A null or empty text has the begin and end ids alone and decodes to the empty text. Repeated rows and ids are left as they
    are; an empty table gives an empty one.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    frame = docs.select(carried.alias("row"), F.col(text_col).alias("text"))
    fields = [frame.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("n_corrected", T.LongType())]
    with_text = with_ids if with_text is None else with_text
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    if with_text:
        fields.append(T.StructField("decoded", T.StringType()))
    return frame.mapInArrow(_encode(model_file, with_ids, with_text), T.StructType(fields))
