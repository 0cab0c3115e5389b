"""Lempel-Ziv phrase fingerprints of texts, of their edited texts, and of their neighbours."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stemma.llm.arrays import mix
from stemma.llm.ranges import bounds_of, range_number

U64 = np.uint64
WIDTH = 64             # minimum hashes of a fingerprint
BUCKET = 16_000_000    # bytes of text in one doc_id range, about
_rng = np.random.default_rng(11)
_ODD = (_rng.integers(0, 1 << 31, WIDTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_MASK = _rng.integers(0, 1 << 32, WIDTH, dtype=np.uint32)[:, None]
_STEP = 0x9E3779B97F4A7C15 | 1


def parse(text: str, start: int, known: set, ends: list, stop: int | None = None) -> int:
    """Goes on with the phrases of `text` from `start`; adds them to `known`, their ends to `ends`.

    A phrase is the shortest string from its start that is not known yet. All beginnings of a
    known phrase are known, so the search starts from the length of the last phrase. Stops
    after the first phrase that ends beyond `stop`, without it at the end of the text; what
    is left there is a phrase too, a known one. Returns where it stopped.
    """
    n, i, size = len(text), start, 5
    add, end = known.add, ends.append
    stop = n if stop is None else stop
    while i < n:
        j = i + size
        if j > n:
            j = n
        phrase = text[i:j]
        if phrase in known:
            while j < n:
                j += 1
                phrase = text[i:j]
                if phrase not in known:
                    break
        else:
            while j > i + 1:
                shorter = text[i:j - 1]
                if shorter in known:
                    break
                phrase = shorter
                j -= 1
        if j > stop:
            return i
        add(phrase)
        end(j)
        size = j - i
        i = j
    return i


def _minima(text: str, start: int, ends: list) -> np.ndarray:
    """Minimum hashes of the phrases that end at `ends`, the first from `start`."""
    if not ends:
        return np.full(WIDTH, 0xFFFFFFFF, np.uint32)
    chars = np.frombuffer(text[start:ends[-1]].encode("utf-32-le", "surrogatepass"), "<u4")
    end = np.array(ends) - start
    begin = np.r_[0, end[:-1]]
    size = end - begin
    # hash of a phrase: characters scrambled with their place in it, added up
    place = (np.arange(len(chars)) - np.repeat(begin, size)).astype(np.uint64)
    one = mix(chars.astype(np.uint64) + (place << U64(32)) + U64(1))
    x = (mix(np.add.reduceat(one, begin) + size.astype(np.uint64)) >> U64(32)).astype(np.uint32)
    out = np.full(WIDTH, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 4096):
        y = (x[None, lo:lo + 4096] ^ _MASK) * _ODD
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(out, (y ^ (y >> np.uint32(13))).min(axis=1), out=out)
    return out


class Parsed:
    """A text's phrases, with the state at the last phrase inside its kept first part."""

    def __init__(self, text: str):
        self.text = text
        self.half = len(text) // 2
        known, ends = set(), []
        self.at = parse(text, 0, known, ends, len(text) - self.half)
        self.known = set(known)
        self.head = _minima(text, 0, ends)
        ends = []
        parse(text, self.at, known, ends)
        self.print = np.minimum(self.head, _minima(text, self.at, ends))

    def edited(self, other: str) -> tuple[str, np.ndarray]:
        """The edited text and its minimum hashes; the phrases of the first part are not parsed again."""
        text = self.text[:len(self.text) - self.half] + other[:self.half]
        ends = []
        parse(text, self.at, self.known, ends)
        return text, np.minimum(self.head, _minima(text, self.at, ends))


def written_out(minima: np.ndarray) -> str:
    return (minima >> np.uint32(16)).astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal places of two fingerprints."""
    return float(((a >> np.uint32(16)) == (b >> np.uint32(16))).mean())


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                  ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                  ("near_edited", pa.float64()), ("near_next", pa.float64())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Phrase fingerprints of every text and of its edited text.

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next. In the edited text the last half of the characters gives way to as many first
    ones of the next document by ascending doc_id, or all it has; after the last comes the
    first. near_* is the share of equal places of two fingerprints of 64 minimum hashes, an
    estimate of the Jaccard likeness of the phrase sets. Null text is empty; an empty text
    has no phrase, and two of them are alike (1). Rows without doc_id come before all others;
    rows that share a doc_id follow each other by a hash of their text. One row per row;
    other columns are ignored; an empty table gives an empty result.

    Documents are dealt by doc_id ranges of about BUCKET bytes, sorted and streamed, so a task
    holds one batch. The first document of each range is also sent to the range before.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total, bounds = bounds_of(docs, BUCKET)
    dealt = docs.withColumn("part", range_number(bounds, "doc_id")).withColumn("tie", F.xxhash64("text"))
    first = dealt.groupBy("part").agg(F.min_by(F.struct("doc_id", "text", "tie"), F.struct("doc_id", "tie")).alias("r"))
    used = sorted(r[0] for r in dealt.select("part").distinct().collect())      # one number per range
    after = dict(zip(used, used[-1:] + used[:-1]))
    spark = docs.sparkSession
    before = spark.createDataFrame(list(after.items()) or [(0, 0)], "part long, before long")
    guests = (first.join(before, "part").select("r.doc_id", "r.text", F.col("before").alias("part"), "r.tie")
              .withColumn("guest", F.lit(True)))
    rows = dealt.withColumn("guest", F.lit(False)).unionByName(guests)
    rows = rows.repartition("part").sortWithinPartitions("part", "guest", "doc_id", "tie")

    def run(batches):
        held = None
        for batch in batches:
            out = []
            for doc_id, text, guest in zip(batch.column("doc_id").to_pylist(), batch.column("text"),
                                           batch.column("guest").to_pylist()):
                now = Parsed(text.as_py())
                if held:
                    last_id, last = held
                    edited, minima = last.edited(now.text)
                    out.append((last_id, len(last.text), hashlib.sha256(edited.encode()).hexdigest(),
                                written_out(last.print), written_out(minima),
                                likeness(last.print, minima), likeness(last.print, now.print)))
                held = None if guest else (doc_id, now)
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out), _OUT)] if out
                                  else [pa.array([], f.type) for f in _OUT], schema=_OUT)

    return rows.select("doc_id", "text", "guest").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
