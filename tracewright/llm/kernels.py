"""NumPy kernels over the bytes of many texts at once.

Texts stay UTF-8 in the Arrow buffer. A polynomial prefix hash modulo 2**64
gives the hash of any byte range in constant time, so words, shingles and
q-grams cost a few nanoseconds a byte and no Python object each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes worked on at once (a longer text makes a longer slice of its own).
SLICE = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240607)
#: A random odd number for each byte value.
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
#: The same with A-Z as a-z.
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]

#: Byte classes: True where a byte ends a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PUNCT = np.zeros(256, bool)
PUNCT[0x00:0x30] = PUNCT[0x3A:0x41] = PUNCT[0x5B:0x61] = PUNCT[0x7B:0x80] = True

_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and their inverses; kept up to the slice size."""
    global _powers
    if _powers is not None and len(_powers[0]) >= n:
        return _powers
    size = max(n, SLICE + (1 << 17))
    ups, downs = np.empty(size, U), np.empty(size, U)
    ups[0] = downs[0] = 1
    ups[1:], downs[1:] = _BASE, _INVERSE
    np.cumprod(ups, out=ups)
    np.cumprod(downs, out=downs)
    if size <= 4 * SLICE:
        _powers = (ups, downs)
    return ups, downs


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads each bit over all (a copy is returned)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def seeds(n: int, start: int = 1) -> np.ndarray:
    return mix(np.arange(start, start + n, dtype=U) * U(_BASE))


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n+1 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(column, most: int = SLICE, rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of at most ``rows`` rows and about ``most`` bytes."""
    data, offsets = raw(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, i + rows, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Text:
    """A slice's prefix hash."""

    def __init__(self, data: np.ndarray, values: np.ndarray = FOLDED):
        n = len(data)
        ups, self.downs = powers(n + 1)
        self.sums = np.empty(n + 1, U)
        self.sums[0] = 0
        product = values[data]
        product *= ups[:n]
        np.cumsum(product, out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.sums[ends] - self.sums[starts]
        h *= self.downs[starts]
        h += (ends - starts).astype(U) * U(0xD6E8FEB86659FD93)
        return mix(h)

    def grams(self, q: int) -> np.ndarray:
        """The hash of each q bytes; unmixed ends of texts are the caller's care."""
        n = len(self.sums) - 1
        h = self.sums[q:] - self.sums[: n + 1 - q]
        h *= self.downs[: n + 1 - q]
        return mix(h)


def words(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each run of bytes that are not in the class ``ends``."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~ends[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


def chained(hashes: np.ndarray, offsets_of: list[int]) -> np.ndarray:
    """The hash of the items at i+offset for each i for which all exist."""
    n = len(hashes) - max(offsets_of)
    out = np.zeros(max(n, 0), U)
    if n <= 0:
        return out
    for k, (step, seed) in enumerate(zip(offsets_of, seeds(len(offsets_of), 101), strict=True)):
        out += mix(hashes[step : step + n] ^ seed) * U(2 * k + 3)
    return mix(out)


def shingles(hashes: np.ndarray, doc: np.ndarray, k: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct k-word shingles, sorted; a text of fewer words has one of all its words."""
    count = np.bincount(doc, minlength=n_docs)
    full = chained(hashes, list(range(k)))
    same = doc[: len(full)] == doc[len(hashes) - len(full) :] if len(full) else np.zeros(0, bool)
    parts_d, parts_h = [doc[: len(full)][same]], [full[same]]
    short = (count > 0) & (count < k)
    if short.any():
        at = short[doc]
        d, h = doc[at], hashes[at]
        first = np.r_[0, np.flatnonzero(d[1:] != d[:-1]) + 1]
        place = np.arange(len(d)) - np.repeat(first, np.diff(np.r_[first, len(d)]))
        mixed = mix(h ^ seeds(k, 101)[place]) * (place * 2 + 3).astype(U)
        parts_d.append(d[first])
        parts_h.append(mix(np.add.reduceat(mixed, first) + U(0xA5A5A5A5)))
    d, h = np.concatenate(parts_d), np.concatenate(parts_h)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    if len(d):
        new = np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])]
        d, h = d[new], h[new]
    return d, h


def sliding(a: np.ndarray, w: int, f=np.minimum) -> np.ndarray:
    """f over each w neighbours, by doubling."""
    span, out = 1, a
    while span * 2 <= w:
        out = f(out[:-span], out[span:])
        span *= 2
    if span < w:
        rest = w - span
        out = f(out[: len(out) - rest], out[rest:])
    return out
