"""Packing tokenised documents into sequences of a fixed length, best two fit."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stemma.llm.arrays import release
from stemma.llm.bpe import coder
from stemma.plans.durable import written

GROUP = 50_000         # pieces packed together in one task, about


def cut_lengths(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter."""
    if total <= size:
        return [(0, total)]
    first = total % size or size
    return [(0, first)] + [(s, size) for s in range(first, total, size)]


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and place in the bin for each length, all between 1 and `size`.

    Each bin takes the longest piece that fits until none does. If a gap is left, its
    smallest piece gives way to the two unpacked pieces that fill the widened gap most
    tightly, where they fill more than it did. Works on counts by length, so a bin costs
    the number of distinct lengths, at most `size`, however many pieces there are.
    """
    order = np.argsort(lengths, kind="stable")
    have = np.bincount(lengths, minlength=size + 1)
    free = np.flatnonzero(have)
    bins = []

    def take(x):
        nonlocal free
        have[x] -= 1
        if not have[x]:
            free = free[free != x]

    while len(free):
        content, gap = [], size
        while gap and len(free) and free[0] <= gap:
            x = int(free[np.searchsorted(free, gap, "right") - 1])
            n = min(int(have[x]), gap // x)
            content += [x] * n
            gap -= n * x
            have[x] -= n
            if not have[x]:
                free = free[free != x]
        if gap and len(free):
            low = content[-1]
            wide = gap + low
            at = np.searchsorted(free, wide - free, "right") - 1
            fits = at >= 0
            a, b = free[fits], free[at[fits]]
            single = (a == b) & (have[a] < 2)
            lower = np.maximum(at[fits] - 1, 0)
            b = np.where(single, free[lower], b)
            both = np.where(single & (at[fits] == 0), 0, a + b)
            if len(both) and both.max() > low:
                k = int(np.argmax(both))
                content.pop()
                for x in (int(a[k]), int(b[k])):
                    take(x)
                    content.append(x)
                if not have[low]:
                    free = np.sort(np.append(free, low))
                have[low] += 1
        bins.append(content)
    used = np.array([x for b in bins for x in b], np.int64)
    number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    ends = np.cumsum(used)
    begin = ends - used
    first = np.r_[0, np.flatnonzero(np.diff(number)) + 1][:len(bins)]
    place_of = begin - np.repeat(begin[first], [len(b) for b in bins])
    by_length = np.argsort(used, kind="stable")
    bin_of, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    bin_of[order], place[order] = number[by_length], place_of[by_length]
    return bin_of, place


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                    ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def token_pieces(docs: DataFrame, path: str, size: int, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: ids of its text, then `end_id`, cut where longer than `size`."""
    def run(batches):
        tool = coder(path)
        last = int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows = [[] for _ in range(5)]
            kept = []
            for i, text in enumerate(batch.column("text")):
                ids = tool.encode(text.as_py() or "") + last
                for k, (start, length) in enumerate(cut_lengths(len(ids) // 4, size)):
                    part = ids[4 * start:4 * (start + length)]
                    for row, v in zip(rows, (i, k, start, length, zlib.crc32(part))):
                        row.append(v)
                    kept.append(part if keep_ids else None)
            yield pa.record_batch([batch.column("doc_id").take(pa.array(rows[0], pa.int64())),
                                   *(pa.array(r, f.type) for r, f in zip(rows[1:], list(_PIECE)[1:5])),
                                   pa.array(kept, pa.binary())], schema=_PIECE)
        tool.forget()
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most `size` tokens, as few as it can.

    Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids where
    `keep_ids` asks for them (little-endian 32-bit). A document is the ids of its whole text
    by the tokenizer file at `path`, then `end_id`. Only longer ones are cut; the first piece
    may be shorter. Null or empty text is a piece of one token. Rows with a null or repeated
    doc_id are documents of their own. An empty table packs to nothing.

    Pieces are dealt by a hash into groups of about GROUP, however long or alike the documents are,
    and each group is packed by best two fit in one task. A group wastes part of its last
    sequence at most, one in thousands, and sequence numbers of groups never meet.
    """
    pieces = token_pieces(docs, path, size, end_id, keep_ids)
    pieces = written(pieces if keep_ids else pieces.drop("ids"), "pieces")
    groups = max(1, math.ceil(pieces.count() * (10 if keep_ids else 1) / GROUP))
    # The row's place in its file deals equal rows too.
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)))
    names = pieces.columns
    schema = pieces.select(*names, F.lit(0).cast("long").alias("sequence_id"),
                           F.lit(0).cast("long").alias("offset")).schema

    def run(table):
        part = table.column("part")[0].as_py()
        bin_of, place = best_two_fit(table.column("length").to_numpy(), size)
        return (table.select(names).append_column("sequence_id", pa.array(bin_of + (part << 40)))
                .append_column("offset", pa.array(place)))

    return dealt.groupBy("part").applyInArrow(run, schema)
