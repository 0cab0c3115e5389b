"""Numpy views of string columns: bytes, word spans and substring hashes."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_OTHER_LETTERS = np.random.default_rng(20240502).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings, end to end, and the n + 1 offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1]
    off = off.astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def parts(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each, or one row where that is longer."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed scramble of 64-bit words (splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BLOCK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p)


_UP, _DOWN = _powers(_BASE, _BLOCK), _powers(_INVERSE, _BLOCK)
_FAR = [pow(x, _BLOCK, 1 << 64) for x in (_BASE, _INVERSE)]


class Hasher:
    """64-bit hashes of any substrings of one buffer, from prefix sums.

    Powers come from two tables of _BLOCK entries and one entry per block of the
    buffer, so nothing as long as the buffer outlives the hasher. `other` asks for a second
    hash that is independent of the first.
    """

    def __init__(self, buf: np.ndarray, lower: bool = False, other: bool = False):
        n = len(buf)
        letters = _OTHER_LETTERS if other else _LETTERS
        if lower:
            letters = letters.copy()
            letters[65:91] = letters[97:123]
        up, self.far = (_powers(x, n // _BLOCK + 1) for x in _FAR)
        self.prefix = np.zeros(n + 1, np.uint64)
        for k, lo in enumerate(range(0, n, _BLOCK)):
            part = letters[buf[lo:lo + _BLOCK]]
            part *= _UP[:len(part)] * up[k]
            np.cumsum(part, out=self.prefix[lo + 1:lo + 1 + len(part)])
            if lo:
                self.prefix[lo + 1:lo + 1 + len(part)] += self.prefix[lo]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.prefix[end] - self.prefix[start]) * _DOWN[start & (_BLOCK - 1)]
        h *= self.far[start >> 16]
        return mix(h + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def word_spans(buf: np.ndarray, off: np.ndarray, inside: np.ndarray | None = None):
    """Starts and ends of the words of all rows, and the n + 1 word offsets of the rows.

    `inside` tells for each byte whether it belongs to a word; by default all but
    the six ASCII white-space bytes do. No word crosses rows.
    """
    inside = ~SPACE[buf] if inside is None else inside
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    edges = off[(off > 0) & (off < n)]
    first[edges] = True
    starts = np.flatnonzero(first & inside)
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[edges - 1] = True
    ends = np.flatnonzero(last & inside) + 1
    return starts, ends, np.searchsorted(starts, off)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)      # where the C library has it


def release() -> None:
    """Gives what numpy and Arrow have freed back to the system; workers live on and serve later stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def digest(*arrays: np.ndarray) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for a in arrays:
        h.update(a.tobytes())
    return h.digest()
