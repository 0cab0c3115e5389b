"""Lines that many documents hold: two Bloom filters pick suspects, an exact count decides."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from stemma.llm.arrays import SPACE, Hasher, mix, parts, utf8
from stemma.plans.durable import written

U64 = np.uint64
SLICE = 1 << 20        # bytes of text worked on at once, or one longer text
SHARD = 1 << 20        # (document, line) pairs that one piece of the filters is made of, about
SEGMENT = 22           # a segment of a filter has 2^SEGMENT bits
FEWEST, MOST = 16, 29  # a filter has 2^FEWEST to 2^MOST bits: 64 MB at most are sent to the tasks
PIECE = 16 << 20       # bytes of filter positions that one task adds up, about
FAN_IN = 64            # filters that one task adds up
KNOWN = 500_000        # repeated lines that are sent to the tasks at most; more are joined
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_PIECE = pa.schema([("segment", pa.int32()), ("salt", pa.int64()), ("dense", pa.bool_()),
                    ("once", pa.binary()), ("twice", pa.binary())])
_PIECES = "segment int, salt long, dense boolean, once binary, twice binary"


class Lines:
    """The lines of a slice of texts: rows, spans of their keys, and which keys are long enough."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, least: int):
        self.buf, self.n = buf, len(off) - 1
        cuts = np.flatnonzero(buf == 10)
        self.first = np.searchsorted(cuts, off) + np.arange(self.n + 1)   # first line of each row
        self.start = np.empty(self.n + len(cuts), np.int64)
        self.end = np.empty_like(self.start)
        opens = np.zeros(len(self.start), bool)
        opens[self.first[:-1]] = True
        closes = np.zeros(len(self.start), bool)
        closes[self.first[1:] - 1] = True
        self.start[opens], self.start[~opens] = off[:-1], cuts + 1
        self.end[closes], self.end[~closes] = off[1:], cuts
        ink = np.flatnonzero(~SPACE[buf])
        a, b = np.searchsorted(ink, self.start), np.searchsorted(ink, self.end)
        points = np.zeros(len(buf) + 1, np.int32)
        np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
        at = np.flatnonzero(b > a)
        s, e = ink[a[at]], ink[b[at] - 1] + 1
        long = points[e] - points[s] >= least
        self.line, self.s, self.e = at[long], s[long], e[long]            # lines with a key that counts
        self.row = np.searchsorted(self.first, self.line, "right") - 1
        self.hash = Hasher(buf, lower=True).of(self.s, self.e)

    def digest(self, k: int) -> bytes:
        key = self.buf[self.s[k]:self.e[k]].tobytes().translate(_FOLD)
        return hashlib.blake2b(key, digest_size=16).digest()


def _places(hashes: np.ndarray, bits: int):
    """The two places of a line in a filter of 2^bits bits."""
    far = U64(64 - bits)
    return hashes >> far, mix(hashes ^ U64(0xA24BAED4963EE407)) >> far


def _slices(batch, least: int):
    buf, off = utf8(batch.column("text"))
    for i, j in parts(off, SLICE):
        yield i, j, Lines(buf[off[i]:off[j]], off[i:j + 1] - off[i], least)


def _seen(bits: int, salts: int, least: int):
    """Positions that a part of the documents sets once, and twice, by segment of the filters."""
    def piece(docs, hashes):
        docs, hashes = np.concatenate(docs), np.concatenate(hashes)
        order = np.lexsort((docs, hashes))
        docs, hashes = docs[order], hashes[order]
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])][:len(docs)]
        word, count = np.unique(hashes[new], return_counts=True)
        both = [p for w in (word, word[count > 1]) for p in _places(w, bits)]
        place, count = np.unique(np.concatenate(both), return_counts=True)
        salt = int(mix(place[-1:] + U64(len(place)))[0] % U64(salts))
        segment, cut = np.unique(place >> U64(SEGMENT), return_index=True)
        low = (place & U64((1 << SEGMENT) - 1)).astype(np.uint32)
        for k, a, b in zip(segment.tolist(), cut, np.r_[cut[1:], len(place)]):
            yield {"segment": k, "salt": salt, "dense": False, "once": low[a:b].tobytes(),
                   "twice": low[a:b][count[a:b] > 1].tobytes()}

    def run(batches):
        docs, hashes, n = [], [], 0
        for batch in batches:
            # A missing doc_id is one more document; its number need not differ from all others here.
            ids = pc.fill_null(batch.column("doc_id"), -1).to_numpy(zero_copy_only=False)
            for i, j, lines in _slices(batch, least):
                docs.append(ids[i:j][lines.row])
                hashes.append(lines.hash)
                n += len(lines.hash)
                if n >= SHARD:
                    yield pa.RecordBatch.from_pylist(list(piece(docs, hashes)), schema=_PIECE)
                    docs, hashes, n = [], [], 0
        if n:
            yield pa.RecordBatch.from_pylist(list(piece(docs, hashes)), schema=_PIECE)
    return run


def _merged(size: int):
    """Adds up filters of one segment: a place set by two of them is set twice."""
    def places(data, dense):
        if dense:
            return np.frombuffer(data, np.uint8)
        full = np.zeros(size, np.uint8)
        full[np.frombuffer(data, np.uint32)] = 1
        return np.packbits(full, bitorder="little")

    def run(table):
        once, twice = np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)
        for dense, a, b in zip(*(table.column(c) for c in ("dense", "once", "twice"))):
            a, b = places(a.as_py(), dense.as_py()), places(b.as_py(), dense.as_py())
            twice |= b | (once & a)
            once |= a
        head = [table.column(c)[0].as_py() for c in ("segment", "salt")]
        return pa.table({"segment": [head[0]], "salt": [head[1]], "dense": [True], "once": [once.tobytes()],
                         "twice": [twice.tobytes()]}, schema=_PIECE)
    return run


def twice_filter(docs: DataFrame, least: int, most: int = MOST) -> tuple[int, np.ndarray]:
    """Bits (as a power of two) and bytes of the filter of lines seen twice.

    Two Bloom filters are built over all lines: what one document sets goes to the first, what a
    second one sets again to the second. Parts of the table send the places that they set;
    segments are added up in rounds of FAN_IN, so no task holds more than FAN_IN segments
    or PIECE bytes of places. The second filter alone reaches the driver, 2^most bits at most.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(FEWEST, (size // 8).bit_length()), most)
    width = 1 << min(SEGMENT, bits)
    # Two places of four bytes for each line of `least` bytes at the least.
    salts = max(1, math.ceil(size * 8 / max(least, 8) / max(1, (1 << bits) // width) / PIECE))
    pieces = docs.mapInArrow(_seen(bits, salts, least), _PIECES)
    while True:
        pieces = pieces.groupBy("segment", "salt").applyInArrow(_merged(width), _PIECES)
        if salts == 1:
            break
        salts = math.ceil(salts / FAN_IN)
        pieces = pieces.withColumn("salt", F.pmod("salt", F.lit(salts)))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for segment, data in pieces.select("segment", "twice").toLocalIterator():
        out[segment * (width // 8):(segment + 1) * (width // 8)] = np.frombuffer(data, np.uint8)
    return bits, out


_SUSPECT = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("hash", pa.int64()), ("digest", pa.binary())])


def _suspects(bits: int, twice: np.ndarray, least: int):
    """(document, line) pairs whose places the filter has all seen twice, each once a batch."""
    def has(place):
        return (twice[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8)) & 1

    def run(batches):
        for batch in batches:
            rows = set()
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            for i, _, lines in _slices(batch, least):
                a, b = _places(lines.hash, bits)
                for k in np.flatnonzero(has(a) & has(b)).tolist():
                    r = i + int(lines.row[k])
                    rows.add((ids[r], texts[r], int(lines.hash[k].view(np.int64)), lines.digest(k)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 4, _SUSPECT)], schema=_SUSPECT)
    return run


def repeated_lines(docs: DataFrame, least: int = 40, documents: int = 5, most: int = MOST):
    """Suspected pairs, and the lines that at least `documents` documents hold.

    The first has (doc_id, text_hash, hash, digest), the second (digest, hash, n_documents, keep)
    with the largest doc_id that holds the line. Lines are told apart by 128-bit digests of their keys.
    A line that every document holds is combined before each shuffle.
    """
    bits, twice = twice_filter(docs, least, most)
    suspects = written(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        _suspects(bits, twice, least), "doc_id long, text_hash long, hash long, digest binary"), "suspects")
    counted = suspects.groupBy("digest", "doc_id").agg(F.min("hash").alias("hash")).groupBy("digest").agg(
        F.count("*").alias("n_documents"), F.max("doc_id").alias("keep"), F.min("hash").alias("hash"))
    return suspects, written(counted.filter(F.col("n_documents") >= documents), "repeated-lines")


def drop_repeated_lines(docs: DataFrame, least: int = 40, documents: int = 5, most: int = MOST,
                        known: int = KNOWN) -> DataFrame:
    """All columns of `docs` with n_lines, n_dropped and kept_text.

    A text is split at line feeds; null or empty text is one empty line. A line's key
    is the line without the six ASCII white-space characters at its ends, A-Z
    lower-cased. Keys of at least `least` code points that at least `documents` different doc_ids
    hold lose all their lines, but for those in the largest doc_id that holds it. The other lines
    stay as they are, joined by line feeds; kept_text is empty where none does. Rows that share a doc_id
    are one document, whose lines count once; rows without doc_id are one further
    document, smaller than the others. Columns of `docs` that have one of the three names are replaced;
    an empty table gives an empty result.

    Method: two Bloom filters, of lines seen once and of lines seen twice, are made of 64-bit
    hashes of all lines. Only lines that the second filter has are shuffled, as digests, for an
    exact count and the choice of the document that keeps them. Filters have two bits per 16 bytes
    of text up to 2^most bits; beyond that more lines are suspects, up to all of them, and the
    result is the same. Up to `known` repeated lines are sent to the tasks (40 bytes each); where
    there are more, each document gets its own by a join.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = (rows.withColumn("n_lines", F.lit(0).cast("long")).withColumn("n_dropped", F.lit(0).cast("long"))
              .withColumn("kept_text", F.lit("")).schema)
    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    suspects, lines = repeated_lines(pairs, least, documents, most)
    if lines.count() <= known:
        found = lines.select("hash", "digest", "keep").toArrow()
        keep = dict(zip(found.column("digest").to_pylist(), found.column("keep").to_pylist()))
        hashes = np.unique(found.column("hash").to_numpy())

        def judge(batch, i, lines):
            """Keys that one of the repeated lines has and another document keeps."""
            ids = batch.column("_id")
            hash_ = lines.hash.view(np.int64)
            at = np.minimum(np.searchsorted(hashes, hash_), max(len(hashes) - 1, 0))
            for k in np.flatnonzero(hashes[at] == hash_).tolist() if len(hashes) else []:
                digest = lines.digest(k)
                if digest in keep and keep[digest] != ids[i + int(lines.row[k])].as_py():
                    yield k

        told = rows.withColumn("_id", F.col("doc_id").cast("long"))
    else:
        lost = (suspects.join(lines.select("digest", "keep"), "digest")
                .filter(~F.col("doc_id").eqNullSafe(F.col("keep")))
                .groupBy("doc_id", "text_hash").agg(F.collect_set("digest").alias("_lost"))
                .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_lost"))

        def judge(batch, i, lines):
            """Keys that the document is to lose; a document's list is no longer than its text."""
            lost, last, gone = batch.column("_lost"), -1, set()
            for k, r in enumerate(lines.row.tolist()):
                if r != last:
                    last, gone = r, set(lost[i + r].as_py() or ())
                if gone and lines.digest(k) in gone:
                    yield k

        told = rows.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
                         & (F.xxhash64("text") == F.col("_hash")), "left").drop("_id", "_hash")

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for i, j, lines in _slices(batch, least):
                gone = np.zeros(len(lines.start), bool)
                gone[lines.line[np.fromiter(judge(batch, i, lines), np.int64)]] = True
                lost = np.add.reduceat(gone, lines.first[:-1]).astype(np.int64)
                kept = texts.slice(i, j - i)
                if gone.any():
                    cut = []
                    for r in np.flatnonzero(lost).tolist():
                        of = np.arange(lines.first[r], lines.first[r + 1])
                        cut.append(b"\n".join(lines.buf[lines.start[k]:lines.end[k]].tobytes()
                                              for k in of[~gone[of]].tolist()).decode())
                    kept = pc.replace_with_mask(kept, pa.array(lost > 0), pa.array(cut, texts.type))
                part = batch.slice(i, j - i)
                yield pa.record_batch([*(part.column(c) for c in names), pa.array(np.diff(lines.first)),
                                       pa.array(lost), kept], names=[*names, "n_lines", "n_dropped", "kept_text"])

    return told.mapInArrow(run, schema)
