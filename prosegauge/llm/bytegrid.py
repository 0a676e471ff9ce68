"""Vectorised work on many texts at once: word edges and prefix polynomial hashes over one flat buffer.

Hashes are modulo 2**64 with an odd base, so that powers have inverses; callers that need certainty compare the bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 18), base, np.uint64)
        out[0] = 1
        _powers[base] = have = np.multiply.accumulate(out)
    if len(have) > 1 << 20:  # one long buffer; not kept
        _powers.pop(base)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of (code + 1) * BASE**k for k in i..j-1."""
    out = np.empty(len(codes) + 1, np.uint64)
    out[0] = 0
    terms = codes.astype(np.uint64)
    terms += np.uint64(1)
    terms *= powers(BASE, len(codes))
    np.cumsum(terms, out=out[1:])
    return out


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span, the same wherever it stands."""
    return mixed((h[end] - h[start]) * powers(INVERSE, len(h))[start])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] over bytes of UTF-8, after lower-casing A-Z.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


class Words:
    """Lower-cased words of many texts: start, end and hash of each word, and the first word of each text."""

    def __init__(self, column: pa.Array):
        self.off, raw = buffers(column)
        self.low = LOWER[raw]
        inside = WORD[self.low]
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.off] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.hash = span_hashes(prefix_hashes(self.low), self.start, self.end)
        self.first = np.searchsorted(self.start, self.off)

    def bytes_of(self, i: int, j: int) -> bytes:
        return b" ".join(self.low[self.start[k] : self.end[k]].tobytes() for k in range(i, j))
