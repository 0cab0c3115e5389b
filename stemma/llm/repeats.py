"""Removal of byte strings that already occur in an earlier document."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from stemma.llm.arrays import Hasher, mix, release, utf8
from stemma.llm.ranges import bounds_of, range_number
from stemma.llm.suffix import repeated, words8

U64 = np.uint64
GRAM = 16              # bytes of an anchor
SHARD = 2_000_000      # bytes of text in one suffix array, about
BUCKET = 16_000_000    # bytes of text whose anchors meet in one task, about


# 18 bytes: the two side hashes have 24 bits each, kept together
_ENTRY = np.dtype([("anchor", "<u4"), ("block", "<u8"), ("low", "<u4"), ("high", "<u2")])


def _sides(entry) -> dict[str, np.ndarray]:
    both = entry["low"].astype(np.uint64) | entry["high"].astype(np.uint64) << U64(32)
    return {"left": both & U64(0xFFFFFF), "right": both >> U64(24)}


def _blocks(buf: np.ndarray, off: np.ndarray, length: int):
    """Strings of `length` bytes by their anchor: (first start, last start, anchor, entry).

    An entry holds the anchor's hash, the block's hash and hashes of as many bytes to the left
    and right of the anchor as any string reaches on one side, together with it, 0 where a document ends before.

    The anchor of a string is the 16 bytes in it with the least hash, the leftmost of equals, so
    equal strings have equal anchors wherever they stand. A block is a run of starts with one
    anchor; its hash covers all bytes of its strings.
    """
    n = len(buf)
    w = words8(buf, 8 + length)
    gram = mix(w[:n] * U64(0x9E3779B97F4A7C15) + mix(w[8:n + 8]))
    bits = U64(max(22, n.bit_length()))
    low = (gram >> bits << bits) | np.arange(n, dtype=np.uint64)
    span, size = length - GRAM + 1, 1
    least = np.r_[low, np.full(span, np.iinfo(np.uint64).max, np.uint64)]
    while size * 2 <= span:
        least[:-size] = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least[:n] = np.minimum(least[:n], least[span - size:span - size + n])
    ends = np.repeat(off[1:], np.diff(off))
    starts = np.flatnonzero(np.arange(n) + length <= ends)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, _ENTRY)
    anchor = (least[starts] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    lo, hi, at = starts[first], starts[np.r_[first[1:] - 1, len(starts) - 1]], anchor[first]
    hasher, side = Hasher(buf), (length - GRAM) // 2
    row = np.searchsorted(off, at, "right")
    out = np.zeros(len(at), _ENTRY)
    out["anchor"], out["block"] = gram[at] >> U64(32), hasher.of(lo, hi + length)
    left, right = at - side >= off[row - 1], at + GRAM + side <= off[row]
    sides = np.zeros(len(at), np.uint64)
    sides[left] = hasher.of(at[left] - side, at[left] + GRAM) >> U64(40) | U64(1)
    sides[right] |= (hasher.of(at[right], at[right] + GRAM + side) >> U64(40) | U64(1)) << U64(24)
    out["low"], out["high"] = sides.astype(np.uint32), sides >> U64(32)
    return lo, hi, at, out


def _entries(entry, buckets):
    """Distinct entries by bucket, the cuts between buckets, and the place of each given one."""
    bucket = (mix(entry["anchor"].astype(np.uint64)) % U64(buckets)).astype(np.int64)
    order = np.lexsort((entry["block"], entry["anchor"], bucket))
    e = entry[order]
    new = np.r_[True, (e["anchor"][1:] != e["anchor"][:-1]) | (e["block"][1:] != e["block"][:-1])][:len(e)]
    place = np.empty(len(e), np.int64)
    place[order] = np.cumsum(new) - 1
    return e[new], np.searchsorted(bucket[order][new], np.arange(buckets + 1)), place


def _runs(mark):
    """Starts and ends of the runs of a mask, as bytes of 32-bit numbers."""
    edge = np.flatnonzero(np.diff(np.r_[False, mark, False].astype(np.int8)))
    return edge.astype(np.uint32).tobytes()


def _text(table):
    """The shard's rows by doc_id, their bytes and offsets, and the rank of each row's doc_id."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    buf, off = utf8(table.column("text"))
    ids = table.column("doc_id").to_numpy()
    return table, buf, off, np.cumsum(np.r_[True, ids[1:] != ids[:-1]][:len(ids)])


def _send(length, buckets):
    def run(table):
        shard = table.column("shard")[0].as_py()
        rows = {"bucket": [], "shard": [], "data": []}
        if shard >= 0:
            _, buf, off, _ = _text(table)
            entry, cut, _ = _entries(_blocks(buf, off, length)[3], buckets)
            for k in np.flatnonzero(np.diff(cut)).tolist():
                rows["bucket"].append(k)
                rows["shard"].append(shard)
                rows["data"].append(entry[cut[k]:cut[k + 1]].tobytes())
        return pa.table(rows, schema=_sent)
    return run


_sent = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("data", pa.binary())])
_SENT = "bucket long, shard long, data binary"


def _shared(key, anchor, shard):
    """Whether another shard has the same key (not 0) at the same anchor."""
    if not len(key):
        return np.zeros(0, bool)
    both = mix(anchor.astype(np.uint64) << U64(32) | key)
    order = np.lexsort((shard, both))
    b, s = both[order], shard[order]
    head = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    size = np.diff(np.r_[head, len(b)])
    out = np.empty(len(b), bool)
    out[order] = np.repeat(s[head] < s[head + size - 1], size)
    return out & (key != 0)


def _merge_blocks(table):
    """Tells each shard which of its blocks stand in an earlier shard (1). Of the first ones of
    their kind, it tells which may share a string that reaches far to the left of the
    anchor (2) or to the right of it (4) with a block of another shard; every string of a block
    reaches so far on one side. Others are 0."""
    shards = table.column("shard").to_numpy()
    sent = [np.frombuffer(d, _ENTRY) for d in table.column("data").to_pylist()]
    entry, shard = np.concatenate(sent), np.repeat(shards, [len(x) for x in sent])
    anchors = np.unique(np.concatenate([x["anchor"] for x in sent]))
    # each shard's anchors are looked up in the merged list by binary search
    at = np.concatenate([np.searchsorted(anchors, x["anchor"]) for x in sent])
    order = np.lexsort((shard, entry["block"], at))
    a, b = at[order], entry["block"][order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    state = np.ones(len(at), np.uint8)
    first = order[new]
    state[first] = 0
    several = first[np.bincount(a[new], minlength=len(anchors))[at[first]] > 1]
    sides = _sides(entry[several])
    for side, flag in (("left", 2), ("right", 4)):
        part = _shared(sides[side], entry["anchor"][several], shard[several])
        state[several[part]] |= flag
    cut = np.cumsum([0] + [len(x) for x in sent])
    return pa.table({"shard": shards, "bucket": table.column("bucket"),
                     "data": [state[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])]},
                    schema=pa.schema([("shard", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())]))


def _resolve(length, buckets):
    """Marks of a shard's own repeats and of blocks known from earlier shards, and the
    single strings of the remaining blocks, by bucket of their hash."""
    def run(table, replies):
        rows = {"bucket": [], "shard": [], "data": []}
        shard = table.column("shard")[0].as_py() if table.num_rows else -1
        if shard >= 0:
            _, buf, off, rank = _text(table)
            lo, hi, anchor, entry = _blocks(buf, off, length)
            place = _entries(entry, buckets)[2]
            replies = replies.sort_by("bucket")
            state = np.frombuffer(b"".join(replies.column("data").to_pylist()), np.uint8)[place]
            mark = repeated(buf, np.repeat(rank, np.diff(off)), length)
            steps = np.zeros(len(buf) + 1, np.int32)
            np.add.at(steps, lo[state == 1], 1)
            np.add.at(steps, hi[state == 1] + 1, -1)
            mark |= np.cumsum(steps[:-1]) > 0
            rows["bucket"].append(-1 - shard)
            rows["shard"].append(shard)
            rows["data"].append(_runs(mark))
            # strings that reach `side` bytes to the left start so far before the anchor at least
            side = (length - GRAM) // 2
            middle = anchor - side
            begin = np.where(state & 2, lo, np.maximum(lo, length - 2 * side - GRAM + middle))
            end = np.where(state & 4, hi, np.minimum(hi, middle))
            size = np.where(state > 1, np.maximum(end - begin + 1, 0), 0)
            at = np.repeat(begin - np.cumsum(np.r_[0, size[:-1]]), size) + np.arange(size.sum())
            at = at[~mark[at]]
            if len(at):
                h = Hasher(buf).of(at, at + length)
                w = words8(buf, length)
                g = np.zeros(len(at), np.uint64)
                for j in range(0, length - 7, 8):
                    g = mix(g * U64(31) + w[at + j])
                g = mix(g * U64(31) + w[at + length - 8])
                bucket = (g % U64(buckets)).astype(np.int64)
                order = np.lexsort((h, g, bucket))
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    o = order[cut[k]:cut[k + 1]]
                    rows["bucket"].append(k)
                    rows["shard"].append(shard)
                    rows["data"].append(g[o].tobytes() + h[o].astype(np.uint32).tobytes()
                                        + (h[o] >> U64(48)).astype(np.uint16).tobytes()
                                        + at[o].astype(np.uint32).tobytes())
        return pa.table(rows, schema=_sent)
    return run


def _merge_strings(table):
    """Positions of strings that stand in an earlier shard; marks pass through."""
    shards, buckets = table.column("shard").to_numpy(), table.column("bucket").to_numpy()
    data = table.column("data").to_pylist()
    if buckets[0] < 0:
        return pa.table({"shard": shards, "data": data}, schema=_marks)
    n = [len(d) // 18 for d in data]
    g = [np.frombuffer(d, np.uint64, k) for d, k in zip(data, n)]
    h = [np.frombuffer(d, np.uint32, k, 8 * k).astype(np.uint64)
         | np.frombuffer(d, np.uint16, k, 12 * k).astype(np.uint64) << U64(32) for d, k in zip(data, n)]
    at = np.concatenate([np.frombuffer(d, np.uint32, k, 14 * k) for d, k in zip(data, n)])
    known = np.unique(np.concatenate(g))
    # each shard's sorted strings are looked up in the merged list by binary search
    place = np.concatenate([np.searchsorted(known, x) for x in g])
    shard = np.repeat(shards, n)
    h = np.concatenate(h)
    order = np.lexsort((shard, h, place))
    p, q, s = place[order], h[order], shard[order]
    new = np.r_[True, (p[1:] != p[:-1]) | (q[1:] != q[:-1])]
    first = s[np.flatnonzero(new)[np.cumsum(new) - 1]]
    late = order[s > first]
    late = late[np.lexsort((at[late], shard[late]))]
    cut = np.flatnonzero(np.r_[True, np.diff(shard[late]) != 0, True]) if len(late) else []
    rows = []
    for i, j in zip(cut[:-1], cut[1:]):
        p = at[late[i:j]].astype(np.int64)
        edge = np.flatnonzero(np.r_[True, np.diff(p) > 1])
        rows.append((int(shard[late[i]]), np.stack([p[edge], p[np.r_[edge[1:] - 1, len(p) - 1]] + 1], 1)
                     .astype(np.uint32).tobytes()))
    return pa.table({"shard": [r[0] for r in rows], "data": [r[1] for r in rows]}, schema=_marks)


_marks = pa.schema([("shard", pa.int64()), ("data", pa.binary())])
_DONE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                   ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])


def _apply(length, texts):
    def run(table, marks):
        table, buf, off, _ = _text(table)
        n = len(buf)
        steps = np.zeros(n + length + 1, np.int32)
        for data in marks.column("data").to_pylist():
            at = np.frombuffer(data, np.uint32).astype(np.int64).reshape(-1, 2)
            np.add.at(steps, at[:, 0], 1)
            np.add.at(steps, at[:, 1] + length - 1, -1)
        gone = np.cumsum(steps[:n]) > 0
        if texts:
            kept = [buf[a:b][~gone[a:b]].tobytes().decode(errors="ignore") if gone[a:b].any() else None
                    for a, b in zip(off[:-1], off[1:])]
            kept = pc.coalesce(pa.chunked_array([pa.array(kept, pa.string())]), table.column("text"))
            return table.select(["doc_id", "rest"]).append_column("text", kept)
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        first = np.flatnonzero(gone & (edge[:n] | ~np.r_[False, gone[:-1]][:n]))
        last = np.flatnonzero(gone & (edge[1:] | ~np.r_[gone[1:], False][:n])) + 1
        cut = np.searchsorted(first, off)
        total = np.r_[0, np.cumsum(gone)]
        sha, spans = [], []
        for i in range(len(off) - 1):
            a, b = off[i], off[i + 1]
            kept = buf[a:b] if cut[i] == cut[i + 1] else buf[a:b][~gone[a:b]]
            sha.append(hashlib.sha256(kept.tobytes()).hexdigest())
            at = slice(cut[i], cut[i + 1])
            spans.append(np.stack([first[at] - a, last[at] - a], 1).ravel())
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": np.diff(off),
                         "n_removed": total[off[1:]] - total[off[:-1]], "n_spans": np.diff(cut),
                         "kept_sha256": sha, "spans": spans}, schema=_DONE)
    return run


def _then_release(run):
    """`run` over a pair of groups, and then what it has freed goes back to the system."""
    def go(table, other):
        out = run(table, other)
        release()
        return out
    return go


def _shards(docs: DataFrame, length: int, texts: bool, schema) -> DataFrame:
    total, bounds = bounds_of(docs, SHARD)
    buckets = max(1, math.ceil(total / BUCKET))
    lost = -1 - F.pmod(F.xxhash64("text"), F.lit(max(1, total // SHARD)))
    dealt = docs.withColumn("shard", F.when(F.col("doc_id").isNull(), lost).otherwise(range_number(bounds, "doc_id")))
    by_shard = dealt.groupBy("shard")
    sent = by_shard.applyInArrow(_send(length, buckets), _SENT)
    known = sent.groupBy("bucket").applyInArrow(_merge_blocks, "shard long, bucket long, data binary")
    left = by_shard.cogroup(known.groupBy("shard")).applyInArrow(_then_release(_resolve(length, buckets)), _SENT)
    marks = left.groupBy("bucket").applyInArrow(_merge_strings, "shard long, data binary")
    return by_shard.cogroup(marks.groupBy("shard")).applyInArrow(_then_release(_apply(length, texts)), schema)


def repeated_spans(docs: DataFrame, length: int = 50) -> DataFrame:
    """What an earlier document already holds: one row per row of `docs`.

    Columns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans, a flat list of
    start and end bytes. A byte goes where it lies in a string of `length` UTF-8 bytes that
    also starts in a document with a smaller doc_id, judged on the input.

    Null text is empty. Texts shorter than `length` are never touched. Rows that share a
    doc_id don't remove each other's bytes and are each returned. Rows without doc_id are
    returned whole and are no source for others. Other columns are ignored; an empty table
    gives an empty result.

    Method: documents are dealt into shards by ranges of doc_id, so an earlier shard holds
    smaller ids. Each shard builds one suffix array (ranks refined by doubling), gets common
    prefixes as in Kasai's method, and so finds all repeats within it. Across shards only
    anchors travel: every string has one, about one in 18 positions is an anchor, and
    a shard sends each distinct (anchor, block) once, 18 bytes. Sorted lists are merged by
    binary search. A block known from an earlier shard is removed as a whole. Where two
    blocks differ round one anchor but agree on one side of it, the single strings on that
    side are merged in the same way, as hashes of 112 bits and a position; these are dealt by the string, not the anchor, so a line
    that stands in every third document does not gather in one task. No step holds more than
    a shard, or a bucket whose size follows BUCKET; very long documents are shards of their own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _shards(docs, length, False, "doc_id long, n_bytes long, n_removed long, n_spans long, "
                                        "kept_sha256 string, spans array<long>")


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """`docs` with the bytes that `repeated_spans` finds taken out of text; all other columns stay.

    A character of which only some bytes go is dropped as a whole. Null text stays null.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns], F.lit(0).alias("_"))
    moved = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", rest.alias("rest"))
    moved = moved.withColumn("rest", F.col("rest").dropFields("text"))
    out = _shards(moved, length, True, moved.select("doc_id", "rest", "text").schema)
    return out.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns])
