"""Suffix arrays over byte buffers: refinement by doubled ranks, common prefixes, repeats."""

from __future__ import annotations

import numpy as np


def words8(buf: np.ndarray, more: int = 0) -> np.ndarray:
    """The 8 bytes from each position as one little-endian word, zeros after the end."""
    padded = np.zeros(len(buf) + more + 8, np.uint8)
    padded[:len(buf)] = buf
    return np.ndarray((len(buf) + more,), "<u8", padded.data, strides=(1,))


def _ordered(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of `bits` bits and where each was. One plain sort where both fit a word."""
    n = len(key)
    place = max(1, int(n - 1).bit_length())
    if bits + place <= 64:
        both = np.sort((key.astype(np.uint64) << np.uint64(place)) | np.arange(n, dtype=np.uint64))
        return both >> np.uint64(place), (both & np.uint64((1 << place) - 1)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    return key[order], order


def _fresh(key: np.ndarray) -> np.ndarray:
    new = np.empty(len(key), bool)
    new[:1] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return new


def suffix_array(buf: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes in the order of their first `depth` bytes or more, by Larsson-Sadakane refinement.

    Sorted by a few bytes first. Then only groups that are still tied are sorted again, by
    the rank of the suffix h places on, and h doubles. Suffixes equal that far keep any order.
    Also returned: whether a suffix was tied with the one before it when the last round
    began, and for how many bytes that was.
    """
    n = len(buf)
    used = np.unique(buf)
    code = np.zeros(256, np.uint64)
    code[used] = np.arange(1, len(used) + 1)
    width = int(len(used)).bit_length()
    place = max(1, int(max(n - 1, 1)).bit_length())
    h = max(1, min(8, depth, (64 - place) // width))
    text = np.zeros(n + h, np.uint64)
    text[:n] = code[buf]
    key = np.zeros(n, np.uint64)
    for j in range(h):
        key = (key << np.uint64(width)) | text[j:j + n]
    key, sa = _ordered(key, h * width)
    new = _fresh(key)
    head = np.flatnonzero(new)
    size = np.diff(np.r_[head, n])
    rank = np.zeros(n + 1, np.uint32)
    rank[sa] = np.repeat((head + 1).astype(np.uint32), size)
    more = np.repeat(size > 1, size)
    tied = np.flatnonzero(more)
    head = np.repeat(head, size)[more]
    deep = ~new
    reach = h
    while h < depth and len(tied):
        at = sa[tied]
        first = np.empty(len(tied), bool)
        first[0] = True
        np.not_equal(head[1:], head[:-1], out=first[1:])
        group = np.cumsum(first, dtype=np.uint32) - np.uint32(1)
        key = (group.astype(np.uint64) << np.uint64(place + 1)) | rank[np.minimum(at + h, n)]
        deep, reach = np.zeros(n, bool), h
        deep[tied] = ~first
        key, order = _ordered(key, int(group[-1]).bit_length() + place + 1)
        at = at[order]
        sa[tied] = at
        begin = np.flatnonzero(_fresh(key))
        size = np.diff(np.r_[begin, len(tied)])
        head = np.repeat(tied[begin], size)
        rank[at] = head + 1
        more = np.repeat(size > 1, size)
        tied, head = tied[more], head[more]
        h *= 2
    return sa, deep, reach


def common_prefixes(buf: np.ndarray, sa: np.ndarray, deep: np.ndarray, least: int) -> np.ndarray:
    """Whether each suffix shares `least` bytes or more with the one before it in `sa`.

    As in Kasai's method lengths are found in text order and carried on: where the
    neighbour of position i is one after the neighbour of i - 1, the common prefix is one
    shorter. Only the first position of such a chain is compared, eight bytes at a time.
    Suffixes outside `deep` are known to share less.
    """
    n = len(buf)
    out = np.zeros(n, bool)
    some = np.flatnonzero(deep)
    if not len(some):
        return out
    order = np.argsort(sa[some])
    at, before = sa[some][order], sa[some - 1][order]
    chained = np.zeros(len(at), bool)
    chained[1:] = (at[1:] == at[:-1] + 1) & (before[1:] == before[:-1] + 1)
    head = np.flatnonzero(~chained)
    w = words8(buf, 8)
    size = np.zeros(len(head), np.int64)
    live = np.arange(len(head))
    a, b = at[head], before[head]
    while len(live):
        diff = w[a] ^ w[b]
        same = (diff == 0) & (a + 8 <= n) & (b + 8 <= n)
        part = ~same
        low = diff[part]
        low &= ~low + np.uint64(1)
        byte = np.where(low == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        size[live[part]] += np.minimum(byte, n - np.maximum(a[part], b[part]))
        size[live[same]] += 8
        live, a, b = live[same], a[same] + 8, b[same] + 8
    chain = np.cumsum(~chained) - 1
    shared = size[chain] - (at - at[head][chain])
    out[some[order]] = shared >= least
    return out


def repeated(buf: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """Positions whose next `length` bytes, all of one owner, also start in a smaller owner's part.

    `owner` never falls from one byte to the next.
    """
    n = len(buf)
    mark = np.zeros(n, bool)
    if n < length:
        return mark
    sa, deep, reach = suffix_array(buf, length)
    same = common_prefixes(buf, sa, deep, length) if reach < length else deep
    inside = np.zeros(n, bool)
    inside[:n - length + 1] = owner[length - 1:] == owner[:n - length + 1]
    who = np.where(inside, owner, np.iinfo(np.int64).max)[sa]
    head = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(who, head), np.diff(np.r_[head, n]))
    mark[sa] = inside[sa] & (who > least)
    return mark
