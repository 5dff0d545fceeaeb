"""Content-defined anchors: positions that any two equal windows choose alike.

A window of ``width`` symbols holds ``width - k + 1`` grams of k symbols. Its anchor is the gram of
the smallest hash, the leftmost among equals. Equal windows therefore have the same anchor at the
same place, so comparing the neighbourhoods of equal anchors finds every pair of equal windows,
and only about one position in ``width / 2`` has to be shuffled.
"""

from __future__ import annotations

import numpy as np

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
#: Grams are compared by 40 bits, so that the index fits beside them.
INDEX_BITS = 24
PIECE = 1 << 23


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M2
    x = x ^ (x >> np.uint64(27))
    x = x * _M3
    return x ^ (x >> np.uint64(31))


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte grams of uint8 ``data``; k is a multiple of 8."""
    n = len(data) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    w = data.astype(np.uint64)
    for step in (1, 2, 4):
        w = w[:-step] | (w[step:] << np.uint64(8 * step))
    h = w[:n] * _M1
    for at in range(8, k, 8):
        h = (h ^ (h >> np.uint64(29))) * _M2 + w[at : at + n]
    return mix(h)


def symbol_grams(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all grams of k symbols, the symbols being uint64 hashes."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = symbols[:n] * _M1
    for at in range(1, k):
        h = (h ^ (h >> np.uint64(29))) * _M2 + symbols[at : at + n]
    return mix(h)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes the index of its smallest, leftmost first."""
    if len(values) - width + 1 <= 0:
        return np.empty(0, np.int64)
    low = np.uint64((1 << INDEX_BITS) - 1)
    best = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span < width:
        step = min(span, width - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    return (best & low).astype(np.int64)


_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, base: int = 0, inverse: bool = False) -> np.ndarray:
    """The first n powers of a base (or of its inverse) modulo 2**64."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        factor = pow(_BASES[base], -1, 1 << 64) if inverse else _BASES[base]
        factors = np.full(max(n, 1 << 20), factor, np.uint64)
        factors[0] = 1
        have = _powers[base, inverse] = np.cumprod(factors, dtype=np.uint64)
    return have[:n]


class RangeHash:
    """Hashes of ranges of a symbol sequence by prefix sums; equal ranges have equal hashes.

    The two bases give independent hashes: their symbols are scrambled and weighted differently.
    """

    def __init__(self, symbols: np.ndarray, base: int = 0):
        self.base = base
        s = mix(symbols.astype(np.uint64) + _M1 * np.uint64(base + 1)) * powers(len(symbols), base)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(s, dtype=np.uint64)))

    def __call__(self, start: np.ndarray, stop: np.ndarray, seed: np.ndarray | int = 0) -> np.ndarray:
        raw = (self.sums[stop] - self.sums[start]) * powers(len(self.sums), self.base, True)[start]
        return mix(raw ^ mix((stop - start + np.asarray(seed) * 65_536).astype(np.uint64) * _M1))


def anchor_runs(grams: np.ndarray, count: int, width: int, starts: np.ndarray):
    """Anchors of all windows that lie within one document: (position, first window, last window).

    ``starts`` has the bounds of the documents in the symbol sequence, one more than documents.
    """
    found = []
    for low in range(0, max(len(grams) - count + 1, 0), PIECE):
        at = sliding_argmin(grams[low : low + PIECE + count - 1], count) + low
        window = np.arange(low, low + len(at))
        ok = window + width <= starts[np.searchsorted(starts, window, side="right")]
        at, window = at[ok], window[ok]
        if len(at):
            new = np.concatenate(([True], at[1:] != at[:-1]))
            end = np.concatenate((new[1:], [True]))
            found.append((at[new], window[new], window[end]))
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
