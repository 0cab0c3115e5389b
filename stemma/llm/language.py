"""Language identification with string kernels, Nystroem landmarks and kernel ridge regression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from stemma.llm.arrays import parts, release, utf8
from stemma.llm.near import SMALL
from stemma.llm.sample import least_hashed
from stemma.llm.suffix import words8
from stemma.plans.durable import written

U64 = np.uint64
GRAMS = (1, 2, 3, 4)   # the blended spectrum: runs of so many bytes
BITS = 14              # presence vectors have 2^BITS places
PER_LANGUAGE = 1500    # training documents of one language at most
LANDMARKS = 48         # landmark documents of one language at most
MARKS = 1024           # landmark documents of all languages, about; each has one at least, however many there are
BATCH = 64             # documents of one matrix product
SLICE = 4 << 20
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def presence(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """0/1 matrix of the hashed byte runs of each row, A-Z lower-cased, white space alike.

    A run belongs to the row in which it ends as a whole; runs never cross rows.
    """
    n = len(off) - 1
    out = np.zeros((n, 1 << BITS), np.float32)
    flat = out.ravel()
    w = words8(_FOLD[buf])
    place = np.repeat(np.arange(n, dtype=np.int64) << BITS, np.diff(off))
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(buf))
    for k in GRAMS:
        h = (w & U64((1 << (8 * k)) - 1)) * U64(0x9E3779B97F4A7C15) + U64(k * 0x1000193)
        h ^= h >> U64(29)
        h *= U64(0xBF58476D1CE4E5B9)
        at = place + (h >> U64(64 - BITS)).astype(np.int64)
        flat[at[left >= k]] = 1
    return out


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised presence kernel: shared runs over the root of the product of the counts."""
    na, nb = np.sqrt(np.maximum(a.sum(1), 1)), np.sqrt(np.maximum(b.sum(1), 1))
    return (a @ b.T) / na[:, None] / nb[None, :]


class Model:
    """One-versus-rest ridge regression on Nystroem features of the presence kernel.

    `marks` are the landmarks' packed presence vectors, 2 KB a document. The regression needs
    sums over documents only, which `sums` makes of any part of them.
    """

    def __init__(self, marks: np.ndarray, langs: list[str]):
        self.langs, self.bits, self._marks = langs, marks, None
        if len(langs):
            value, vector = np.linalg.eigh(_kernel(self.marks, self.marks).astype(np.float64))
            good = value > 1e-6 * value.max()
            self.root = vector[:, good] / np.sqrt(value[good])

    def __getstate__(self):
        return self.__dict__ | {"_marks": None}

    @property
    def marks(self) -> np.ndarray:
        if self._marks is None:
            self._marks = np.unpackbits(self.bits, axis=1).astype(np.float32)
        return self._marks

    def sums(self, bits: np.ndarray, code: np.ndarray, share: np.ndarray):
        """z'z of documents weighted by the `share` of their language, and {language number: sum of z}."""
        size = self.root.shape[1] + 1
        square, of = np.zeros((size, size)), {}
        for i in range(0, len(bits), 256):
            rows = np.unpackbits(bits[i:i + 256], axis=1).astype(np.float32)
            z = np.c_[_kernel(rows, self.marks) @ self.root, np.ones(len(rows))]
            k = code[i:i + 256]
            square += z.T @ (z * share[k][:, None])
            for x in np.unique(k).tolist():
                of[x] = of.get(x, 0) + z[k == x].sum(0)
        return square, of

    def solve(self, square: np.ndarray, of: np.ndarray, share: np.ndarray, ridge: float = 1.0):
        """Weights of each language from the sums of all documents; languages weigh alike."""
        of = of * share[:, None]
        beta = np.linalg.solve(square + ridge * np.eye(len(square)), (2 * of - of.sum(0)).T)
        self.weight = (self.root @ beta[:-1]).astype(np.float32)
        self.bias = beta[-1].astype(np.float32)
        return self

    def score(self, rows: np.ndarray) -> np.ndarray:
        return _kernel(rows, self.marks) @ self.weight + self.bias


def _packed(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, (1 << BITS) // 8)


def _added(table):
    rows = [np.frombuffer(x) for x in table.column("data").to_pylist()]
    return pa.table({"kind": table.column("kind")[:1], "at": table.column("at")[:1],
                     "data": pa.array([np.sum(rows, axis=0).tobytes()], pa.binary())})


def train(docs: DataFrame, learn) -> Model:
    """Fits on at most PER_LANGUAGE documents of each language, those with the least id hash; equal rows are one.

    `learn` is a condition on rows. Every language is learned. Tasks make the presence vectors
    from whole texts, packed, 2 KB a document, and then the sums of the regression; the driver
    holds the landmarks, one square matrix of their number and one row of it per language.
    """
    known = (docs.filter(learn).filter("lang is not null and text is not null and doc_id is not null")
             .select(F.col("doc_id").cast("long").alias("id"), "lang"))
    chosen = written(least_hashed(known.distinct(), "lang", "id", PER_LANGUAGE), "language-ids")
    if chosen.count() <= SMALL:
        chosen = F.broadcast(chosen)

    def run(batches):
        for batch in batches:
            buf, off = utf8(batch.column("text"))
            for i in range(0, batch.num_rows, BATCH):
                j = min(i + BATCH, batch.num_rows)
                bits = np.packbits(presence(buf[off[i]:off[j]], off[i:j + 1] - off[i]).astype(bool), axis=1)
                yield pa.record_batch([batch.column("id").slice(i, j - i), batch.column("lang").slice(i, j - i),
                                       pa.array([b.tobytes() for b in bits], pa.binary())],
                                      names=["id", "lang", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "lang", "text").filter("text is not null")
    # Rows may share an id, so the bound is kept once more on the vectors themselves.
    sample = rows.join(chosen, ["id", "lang"]).mapInArrow(run, "id long, lang string, bits binary").distinct()
    sample = written(least_hashed(sample, "lang", "id", PER_LANGUAGE, "bits"), "language-sample")
    counts = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model(np.zeros((0, (1 << BITS) // 8), np.uint8), [])
    share = sum(counts.values()) / (len(langs) * np.array([counts[x] for x in langs], float))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "bits")
    marks = (sample.withColumn("nth", F.row_number().over(first))
             .filter(F.col("nth") <= max(1, min(LANDMARKS, MARKS // len(langs)))).select("lang", "nth", "bits").toArrow())
    model = Model(_packed(marks.sort_by([("lang", "ascending"), ("nth", "ascending")]).column("bits")), langs)
    number = {x: k for k, x in enumerate(langs)}

    def add(batches):
        square, of = 0, {}
        for batch in batches:
            if batch.num_rows:
                code = np.array([number[x] for x in batch.column("lang").to_pylist()])
                more, part = model.sums(_packed(batch.column("bits")), code, share)
                square = square + more
                for k, z in part.items():
                    of[k] = of.get(k, 0) + z
        if of:
            yield pa.record_batch([pa.array([0] * len(square) + [1] * len(of), pa.int32()),
                                   pa.array([*range(len(square)), *of], pa.int32()),
                                   pa.array([x.tobytes() for x in [*square, *of.values()]], pa.binary())],
                                  names=["kind", "at", "data"])

    kind = "kind int, at int, data binary"
    total = (sample.select("lang", "bits").mapInArrow(add, kind).groupBy("kind", "at").applyInArrow(_added, kind)
             .toArrow().sort_by([("kind", "ascending"), ("at", "ascending")]))
    size = model.root.shape[1] + 1
    flat = np.frombuffer(b"".join(total.column("data").to_pylist())).reshape(-1, size)
    return model.solve(flat[:size], flat[size:], share)


def held_out():
    """Whether crc32 of the id's decimal digits leaves 2 when divided by 4; null ids are held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """All columns of `docs` with held_out, lang_pred and score.

    lang_pred is a language seen in training, or `und` with score 0 where the text is null or
    has no letter, or nothing could be learned. score is the softmax share of the best
    language, 0 to 1. Learned from text and non-null lang of rows that are not held out;
    a prediction sees the text alone. Ties go to the smaller language name. doc_id may be
    null (never learned from) or repeated. Columns of `docs` with one of the three names
    are replaced; an empty table gives an empty result.

    Method: the kernel of two texts is the number of byte runs of 1 to 4 bytes that both
    hold, over the root of the product of their numbers; runs are hashed to 2^14 places.
    Landmarks give Nystroem features, on which one ridge regression per language is solved.
    Each task scores its texts in batches by two matrix products.
    """
    names = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    docs = docs.select(*names)
    model = train(docs, ~held_out())
    docs = docs.withColumn("held_out", held_out())
    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def run(batches):
        for batch in batches:
            buf, off = utf8(batch.column("text"))
            texts = batch.column("text")
            for lo, hi in parts(off, SLICE):
                for i in range(lo, hi, BATCH):
                    j = min(i + BATCH, hi)
                    letter = np.array([bool(_LETTER.search(t.as_py() or "")) for t in texts.slice(i, j - i)])
                    lang, best = np.full(j - i, "und", object), np.zeros(j - i)
                    if model.langs and letter.any():
                        s = model.score(presence(buf[off[i]:off[j]], off[i:j + 1] - off[i])).astype(np.float64)
                        k = s.argmax(1)
                        p = np.exp(4 * (s - s.max(1, keepdims=True)))
                        lang[letter] = np.array(model.langs, object)[k[letter]]
                        best[letter] = (1 / p.sum(1))[letter]
                    part = batch.slice(i, j - i)
                    yield pa.record_batch([*part.columns, pa.array(lang.tolist(), pa.string()), pa.array(best)],
                                          names=[*part.schema.names, "lang_pred", "score"])
        release()

    return docs.mapInArrow(run, schema)
