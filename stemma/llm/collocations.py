"""Collocations: phrases whose words stand together more often than their parts explain."""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stemma.llm.arrays import Hasher, mix, parts, utf8, word_spans
from stemma.plans.durable import written

U64 = np.uint64
SLICE = 1 << 20        # bytes of text whose windows are made at once, or one longer text
SHARD = 1 << 22        # phrases that one piece of the bucket counts is made of, about
SEGMENT = 20           # buckets of a segment, as a power of two
FEWEST, MOST = 16, 29  # buckets in all: 64 MB of bits at most are sent to the tasks
PIECE = 16 << 20       # bytes of bucket counts that one task adds up, about
FAN_IN = 32            # segments that one task adds up
_CUTS = np.zeros(256, bool)
_CUTS[[46, 44, 59, 58, 33, 63, 10, 11, 12, 13]] = True
_INK = ~_CUTS
_INK[[32, 9]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

_PIECE = pa.schema([("segment", pa.int32()), ("salt", pa.int64()), ("dense", pa.bool_()), ("data", pa.binary())])
_PIECES = "segment int, salt long, dense boolean, data binary"


class Windows:
    """The words of a slice of texts and, for each, the hashes of the phrases that begin with it."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, langs: np.ndarray, longest: int, other: bool = False):
        self.buf, self.longest = buf, longest
        self.start, self.end, cut = word_spans(buf, off, _INK[buf])
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(cut))
        cuts = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(_CUTS[buf], out=cuts[1:])
        piece = cuts[self.start]
        n = len(self.start)
        # How many words stand from each word to the end of its piece, up to `longest`.
        self.left = np.ones(n, np.int8)
        for k in range(1, min(longest, n)):
            same = (piece[k:] == piece[:-k]) & (self.row[k:] == self.row[:-k]) & (self.left[:-k] == k)
            self.left[:-k][same] = k + 1
        word = mix(Hasher(buf, lower=True, other=other).of(self.start, self.end) ^ langs[self.row])
        self.hash = [word]
        for k in range(1, longest):
            ahead = np.zeros(n, np.uint64)
            if n > k:
                ahead[:-k] = word[k:]
            self.hash.append(mix(self.hash[-1] * U64(0x9E3779B97F4A7C15) + ahead))


def _strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    to = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=to[1:])
    data = _FOLD[buf[np.repeat(start - to[:-1], size) + np.arange(to[-1])]]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(to), pa.py_buffer(data))


def _lang_hashes(column) -> np.ndarray:
    told = column.to_pylist()
    number = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(told)}
    return np.array([number[x] for x in told], np.uint64)


def _slices(batch, longest: int, other: bool = False):
    buf, off = utf8(batch.column("text"))
    langs = _lang_hashes(batch.column("lang"))
    for i, j in parts(off, SLICE):
        yield i, Windows(buf[off[i]:off[j]], off[i:j + 1] - off[i], langs[i:j], longest, other)


def _bucket_counts(bits: int, salts: int, longest: int):
    """Occurrences of phrases by bucket of their hash, from a part of the texts."""
    def piece(found):
        place, count = np.unique(np.concatenate(found) >> U64(64 - bits), return_counts=True)
        salt = int(mix(place[-1:] + U64(len(place)))[0] % U64(salts))
        segment, cut = np.unique(place >> U64(SEGMENT), return_index=True)
        low = (place & U64((1 << SEGMENT) - 1)).astype(np.uint32)
        count = np.minimum(count, 255).astype(np.uint8)
        return pa.RecordBatch.from_pylist([
            {"segment": k, "salt": salt, "dense": False, "data": low[a:b].tobytes() + count[a:b].tobytes()}
            for k, a, b in zip(segment.tolist(), cut, np.r_[cut[1:], len(place)])], schema=_PIECE)

    def run(batches):
        found, n = [], 0
        for batch in batches:
            for _, w in _slices(batch, longest):
                for k in range(2, longest + 1):
                    found.append(w.hash[k - 1][w.left >= k])
                    n += len(found[-1])
                if n >= SHARD:
                    yield piece(found)
                    found, n = [], 0
        if n:
            yield piece(found)
    return run


def _added(width: int):
    def run(table):
        total = np.zeros(width, np.uint8)
        for dense, data in zip(table.column("dense").to_pylist(), table.column("data")):
            data = data.as_py()
            if dense:
                at, count = slice(None), np.frombuffer(data, np.uint8)
            else:
                at = np.frombuffer(data, np.uint32, len(data) // 5)
                count = np.frombuffer(data, np.uint8, offset=4 * len(at))
            total[at] += np.minimum(count, 255 - total[at])
        head = [table.column(c)[0].as_py() for c in ("segment", "salt")]
        return pa.table({"segment": [head[0]], "salt": [head[1]], "dense": [True], "data": [total.tobytes()]},
                        schema=_PIECE)
    return run


def frequent_buckets(texts: DataFrame, longest: int, least: int, most: int = MOST) -> tuple[int, np.ndarray]:
    """Number of buckets (as a power of two) and one bit for each in which phrases occur `least` times.

    Every phrase that occurs so often is in such a bucket. Parts of the table send their counts by
    bucket, up to 255, which are added up in rounds; the driver gets 2^most bits at most.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(FEWEST, (size // 4).bit_length()), most)
    width = 1 << min(SEGMENT, bits)
    salts = max(1, math.ceil(5 * (longest - 1) * size / 4 / max(1, (1 << bits) // width) / PIECE))
    pieces = texts.mapInArrow(_bucket_counts(bits, salts, longest), _PIECES)
    while True:
        pieces = pieces.groupBy("segment", "salt").applyInArrow(_added(width), _PIECES)
        if salts == 1:
            break
        salts = math.ceil(salts / FAN_IN)
        pieces = pieces.withColumn("salt", F.pmod("salt", F.lit(salts)))

    def enough(batches):
        for batch in batches:
            data = [np.packbits(np.frombuffer(x.as_py(), np.uint8) >= min(least, 255), bitorder="little").tobytes()
                    for x in batch.column("data")]
            yield pa.record_batch([batch.column("segment"), pa.array(data, pa.binary())], names=["segment", "data"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    for segment, data in pieces.select("segment", "data").mapInArrow(enough, "segment int, data binary").toLocalIterator():
        out[segment * (width // 8):(segment + 1) * (width // 8)] = np.frombuffer(data, np.uint8)
    return bits, out


def windows(docs: DataFrame, longest: int, least: int, most: int = MOST) -> DataFrame:
    """(lang, w1 … w<longest>, a): each word and the words that follow it in its piece, with their number.

    Null stands past the end of the piece, and from the first word on with which the phrase cannot
    occur `least` times by the counts of its bucket. That is the same for all places of a phrase, so
    the counts of phrases that do, and of all single words, are sums over whole windows.
    """
    texts = docs.select(F.expr("coalesce(lang, 'und')").alias("lang"), F.expr("coalesce(text, '')").alias("text"))
    bits, often = frequent_buckets(texts, longest, least, most)
    names = [f"w{k}" for k in range(1, longest + 1)]
    schema = f"lang string, {', '.join(f'{n} string' for n in names)}, a long"

    def run(batches):
        for batch in batches:
            langs = batch.column("lang")
            for (i, w), (_, second) in zip(_slices(batch, longest), _slices(batch, longest, True)):
                n = len(w.start)
                size = np.ones(n, np.int64)
                for k in range(2, longest + 1):
                    place = w.hash[k - 1] >> U64(64 - bits)
                    bit = (often[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8)) & 1
                    size[(size == k - 1) & (w.left >= k) & (bit == 1)] = k
                at = size - 1, np.arange(n)
                key, twin = np.array(w.hash)[at], np.array(second.hash)[at]
                # Equal windows are added up by two hashes of 64 bits.
                order = np.lexsort((size, twin, key))
                new = np.ones(n, bool)
                new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (key, twin, size)], axis=0)
                head = np.flatnonzero(new)
                one, count = order[head], np.diff(np.r_[head, n])
                columns = [langs.take(pa.array(i + w.row[one]))]
                for k in range(longest):
                    has = size[one] > k
                    to = np.minimum(one + k, n - 1)
                    words = _strings(w.buf, w.start[to], np.where(has, w.end[to], w.start[to]))
                    columns.append(_masked(words, has))
                yield pa.record_batch([*columns, pa.array(count)], names=["lang", *names, "a"])

    return texts.mapInArrow(run, schema)


def _masked(words: pa.Array, has: np.ndarray) -> pa.Array:
    valid = pa.py_buffer(np.packbits(has, bitorder="little"))
    return pa.StringArray.from_buffers(len(words), words.buffers()[1], words.buffers()[2], valid)


def phrase_counts(docs: DataFrame, longest: int, least: int, most: int = MOST) -> DataFrame:
    """(lang, size, phrase, a): phrases of 1 to `longest` words that occur `least` times, and the total as size 0.

    Only the longest windows are counted, padded at the ends of pieces. A rollup then
    sums them by ever shorter prefixes: each occurrence of a shorter phrase begins one window.
    The count of windows is written once and read for the longest phrases and for the rollup.
    """
    names = [f"w{k}" for k in range(1, longest + 1)]
    counted = windows(docs, longest, least, most).groupBy("lang", *names).agg(F.sum("a").alias("a"))
    counted = written(counted, "windows")
    shorter = counted.rollup("lang", *names[:-1]).agg(F.sum("a").alias("a"), F.grouping_id().alias("open"))

    def phrases(rows: DataFrame, size: int) -> DataFrame:
        words = names[:size]
        if words:
            rows = rows.filter(F.col(words[-1]).isNotNull()).filter(F.col("a") >= least)
        return rows.select("lang", F.lit(size).alias("size"), F.concat_ws(" ", *words).alias("phrase"), "a")

    parts = [phrases(counted, longest)]
    told = shorter.filter("lang is not null").withColumn("size", F.lit(longest - 1) - F.bit_count("open"))
    kept = reduce(lambda x, y: x | y, (
        (F.col("size") == k) & F.col(names[k - 1]).isNotNull() & (F.col("a") >= least) for k in range(1, longest)),
        F.col("size") == 0)
    parts.append(told.filter(kept).select("lang", "size", F.concat_ws(" ", *names[:-1]).alias("phrase"), "a"))
    return written(reduce(DataFrame.unionByName, parts), "phrase-counts")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, share: int = 50,
                 most: int = MOST) -> DataFrame:
    """The `top` best phrases of 2 to `longest` words of each language.

    Columns lang, rank, phrase, a, l, r, n, score. Texts are cut at `.,;:!?` and the line breaks
    LF, VT, FF and CR into pieces, those at spaces and tabs into words, A-Z lower-cased. a is the number of places
    of the phrase, l and r those of its two parts at the cut with the lowest
    score = floor(1000000 a a / (l r)), the earliest cut on ties; n is the number of words of the
    language. Phrases occur at least `least` times. One whose words stand in a longer such phrase
    with at least `share` hundredths of its occurrences is left out. Order: score, then a, falling, then phrase by
    bytes. A null lang is `und`; null and empty texts have no words; a language without
    phrases has no rows, an empty table none at all. Rows count as often as they are repeated, doc_id
    and other columns are ignored. Products are exact up to 38 digits, which a = 10^15 does not reach.

    Method: top-order marginalisation, see `phrase_counts`. Before, phrases are counted by bucket of a
    64-bit hash, and windows end where the bucket is too rare for any phrase that counts: the
    result is the same without, but few windows are left to shuffle. There is a bucket for four bytes of text up
    to 2^most; beyond that windows are cut less. Every grouping is combined before its
    shuffle, and what comes after holds only phrases that occur `least` times.
    """
    counts = phrase_counts(docs, longest, least, most)
    known = counts.filter("size > 0").select("lang", "phrase", "a")
    found = counts.filter("size > 1").withColumn("w", F.split("phrase", " "))
    cuts = found.selectExpr("lang", "phrase", "w", "a", "explode(sequence(1, size - 1)) as cut").selectExpr(
        "lang", "phrase", "a", "cut", "array_join(slice(w, 1, cut), ' ') as left",
        "array_join(slice(w, cut + 1, size(w)), ' ') as right")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.toDF("lang", side, name), ["lang", side])
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.expr(
        "min(struct(cast((cast(a as decimal(38, 0)) * a * 1000000) div (cast(l as decimal(38, 0)) * r) as long) "
        "as score, cut, l, r)) as best"))
    spans = "flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), i -> slice(w, i, k))))"
    inside = found.filter("size > 2").selectExpr("lang", "a", f"explode({spans}) as part").groupBy(
        "lang", F.array_join("part", " ").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").filter(f"longer is null or 100 * longer < {share} * a")
    best = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = counts.filter("size = 0").select("lang", F.col("a").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                            "n", "score")
