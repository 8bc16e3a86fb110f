"""Word shingles of whole texts as 64-bit hashes, computed over an Arrow column's bytes at once.

Words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z, so words never split a UTF-8
character. A text's set holds the hashes of its distinct five-word shingles; with fewer words, of the whole
sequence; without words, nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_P = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: One random 64-bit value for each byte, from the mixing function itself.


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 whose output bits each depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)


def _powers(n: int) -> np.ndarray:
    p = np.empty(n, dtype=np.uint64)
    p[0] = 1
    p[1:] = _P
    return np.multiply.accumulate(p)


_POW = _powers(1 << 16)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n+1 offsets from 0; a null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(column: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges of a column whose texts hold about `most` bytes together, or one longer text alone."""
    _, offsets = column_bytes(column)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield start, end
        start = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word in order, and for each text the index of its first word (n+1 entries)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    place = np.arange(n, dtype=np.int64)
    place -= np.repeat(start, np.diff(np.append(start, n))) if start[0] == 0 else np.concatenate([np.arange(start[0]), np.repeat(start, np.diff(np.append(start, n)))])
    place &= 0xFFFF
    value = _BYTE[_LOWER[data]]
    value *= _POW[place]
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(value, out=total[1:])
    h = mix((total[end] - total[start]) ^ ((end - start).astype(np.uint64) << np.uint64(48)))
    return h, np.searchsorted(start, offsets).astype(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles."""
    h, first = words(data, offsets)
    m = len(h)
    out: list[np.ndarray] = []
    if m >= width:
        s = np.zeros(m - width + 1, dtype=np.uint64)
        for k in range(width):
            s = s * _P + h[k : m - width + 1 + k]
        s = mix(s)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(s[a : b - width + 1]))
        elif b > a:
            x = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for k in range(a, b):
                    x = x * _P + h[k]
            out.append(mix(np.array([x ^ np.uint64(0x5BD1E995)], dtype=np.uint64)))
        else:
            out.append(h[:0])
    return out
