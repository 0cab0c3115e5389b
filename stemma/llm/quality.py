"""Quality classifier: ordinal regression of graded ratings on hashed text features."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stemma.llm.arrays import Hasher, mix, parts, release, utf8, word_spans
from stemma.llm.sample import least_hashed

U64 = np.uint64
SIZE = 1 << 18         # weights
SLICE = 1 << 19        # bytes of text whose features are made at once, or one longer text
PREFIXES = (4, 5)      # bytes of a longer word that are a feature too
EVIDENCE = 10          # likelihood ratio that a feature needs; by chance 1 in 150 has it, at any sample size
PER_GRADE = 4000       # labelled documents of one grade that a fit takes at most
STEPS = np.array([1e-9, 0.005, 0.02, 0.06, 0.15, 0.35, 0.7])   # bounds of the share features


def _word_bytes() -> np.ndarray:
    inside = np.zeros(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        inside[a:b] = True
    return inside


_LETTER = _word_bytes()
_UPPER = np.zeros(256, np.int8)
_UPPER[65:91] = 1
_ODD = np.zeros(256, np.int8)
_ODD[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126]] = 1


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, distinct and sorted: hashed words, their first bytes, and steps of a few shares.

    Words are runs of ASCII letters and digits and all bytes beyond ASCII, A-Z lower-cased.
    The shares are those of upper-case words, of words with unusual marks, with an exclamation
    mark, with digits, of repeated words, of lone marks and of distinct words.
    """
    n = len(off) - 1
    starts, ends, cut = word_spans(buf, off, _LETTER[buf])
    row = np.repeat(np.arange(n), np.diff(cut))
    hasher = Hasher(buf, lower=True)
    word = hasher.of(starts, ends)
    who = row.astype(np.uint64) << U64(18)
    keys = np.unique(who | (word & U64(SIZE - 1)))
    distinct = np.bincount((keys >> U64(18)).astype(np.int64), minlength=n)
    heads = [keys]
    for size in PREFIXES:
        long = ends - starts > size
        head = mix(hasher.of(starts[long], starts[long] + size) + U64(size))
        heads.append(who[long] | (head & U64(SIZE - 1)))

    s, e, at = word_spans(buf, off)
    who = np.repeat(np.arange(n), np.diff(at))
    count = np.maximum(np.diff(at), 1)

    total = np.zeros(len(buf) + 1, np.int32)

    def with_any(table):
        np.cumsum(table[buf], out=total[1:])
        return total[e] - total[s]

    bang, digit = np.zeros(256, np.int8), np.zeros(256, np.int8)
    bang[33], digit[48:58] = 1, 1
    letters = with_any(_LETTER.astype(np.int8))
    token = hasher.of(s, e)
    same = np.r_[False, (token[1:] == token[:-1]) & (who[1:] == who[:-1])][:len(token)]
    kinds = [(with_any(_UPPER) == letters) & (letters > 1), with_any(_ODD) > 0, with_any(bang) > 0,
             with_any(digit) > 0, same, letters == 0]
    shares = [np.bincount(who, k, n) / count for k in kinds] + [distinct / np.maximum(np.diff(cut), 1)]
    extra = []
    for k, share in enumerate(shares):
        step = np.searchsorted(STEPS, share, "right")
        h = mix((np.uint64(1_000_003 * (k + 1)) + step.astype(np.uint64)) * U64(0x9E3779B97F4A7C15)) & U64(SIZE - 1)
        extra.append((np.arange(n, dtype=np.uint64) << U64(18)) | h)
    keys = np.unique(np.concatenate([*heads, *extra]))
    return (keys >> U64(18)).astype(np.int64), (keys & U64(SIZE - 1)).astype(np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _evidence(rows, grades, total):
    """Likelihood ratio of each feature's presence by grade against one share for all grades."""
    have = np.zeros((len(total), SIZE), np.int64)
    for row, grade in zip(rows, grades):
        have[grade, row] += 1      # the features of a row are distinct
    lack = total[:, None] - have
    out = np.zeros(SIZE)
    for part in (have, lack):
        mean = part.sum(0) / total.sum() * total[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            out += 2 * np.nansum(np.where(part > 0, part * np.log(part / mean), 0), axis=0)
    return out


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, rounds: int = 800, l1: float = 3.0,
        rate: float = 0.5):
    """Shared weights and ordered thresholds: P(grade > k) = sigmoid(w.x - t[k]).

    Cumulative-link likelihood, AdaGrad with an L1 shrinkage that keeps rare words at zero;
    grades weigh alike. Features whose presence says little about the grade, by the
    likelihood ratio against independence, have no weight; the bound is the same for every
    sample, so that words of a small language pass once a few of its documents tell. Rows
    are cut to the features that have a weight before anything is laid out flat.
    """
    weight, cuts = np.zeros(SIZE), np.linspace(-6, -3, max(n_grades - 1, 1))
    if not len(rows) or len(np.unique(grades)) < 2:
        return weight, cuts
    told = _evidence(rows, grades, np.bincount(grades, minlength=n_grades)) > EVIDENCE
    rows = [row[told[row]] for row in rows]
    flat = np.concatenate(rows)
    who = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, flat = np.unique(flat, return_inverse=True)
    w, square = np.zeros(len(used)), np.full(len(used), 1e-6)
    square_t = np.full(len(cuts), 1e-6)
    share = len(grades) / (len(np.unique(grades)) * np.bincount(grades, minlength=n_grades)[grades])
    for _ in range(rounds):
        eta = np.bincount(who, w[flat], len(rows))
        above = np.c_[np.ones(len(rows)), _sigmoid(eta[:, None] - cuts), np.zeros(len(rows))]
        hi, lo = above[np.arange(len(rows)), grades], above[np.arange(len(rows)), grades + 1]
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / p * share, lo * (1 - lo) / p * share
        slope = d_lo - d_hi
        g = np.bincount(flat, slope[who], len(used))
        square += g * g
        step = rate / np.sqrt(square)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        g = np.zeros(len(cuts))
        np.add.at(g, grades[grades > 0] - 1, d_hi[grades > 0])
        low = grades < n_grades - 1
        np.add.at(g, grades[low], -d_lo[low])
        square_t += g * g
        cuts = np.maximum.accumulate(cuts - 0.1 / np.sqrt(square_t) * g)
    weight[used] = w
    return weight, cuts


def _rated(labels: DataFrame, grade) -> DataFrame:
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))
    rated = rated.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    return least_hashed(rated, "grade", "doc_id", PER_GRADE)


def grade_of_labels():
    """0: poor quality, 1: good but toxic, 2: good and clean; null where a label is missing."""
    return F.expr("case when quality = 0 then 0 when quality = 1 and toxic = 1 then 1 "
                  "when quality = 1 and toxic = 0 then 2 end")


def train(docs: DataFrame, labels: DataFrame, grade, n_grades: int):
    """Fits on at most PER_GRADE documents of each grade, those with the least id hash; equal rows are one.

    Their features are made by tasks from whole texts; the driver holds that bounded sample.
    """
    rated = F.broadcast(_rated(labels, grade))     # at most PER_GRADE rows of each grade

    def run(batches):
        for batch in batches:
            buf, off = utf8(batch.column("text"))
            for i, j in parts(off, SLICE):
                row, feature = features(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                cut = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                yield pa.record_batch([*(batch.column(c).slice(i, j - i) for c in ("doc_id", "grade")),
                                       pa.ListArray.from_arrays(pa.array(cut), pa.array(feature.astype(np.int32)))],
                                      names=["doc_id", "grade", "features"])
        release()

    sample = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(rated, "doc_id")
              .select("doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, features array<int>"))
    # Rows may share an id, so the bound is kept once more on the rows themselves.
    sample = least_hashed(sample.distinct(), "grade", "doc_id", PER_GRADE, "features").select("grade", "features").toArrow()
    grades = sample.column("grade").to_numpy()
    lists = sample.column("features").combine_chunks()
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    rows = [flat[a:b] for a, b in zip(at[:-1], at[1:])]
    name = [hashlib.blake2b(row, digest_size=16).digest() for row in rows]
    order = sorted(range(len(rows)), key=lambda i: (grades[i], len(rows[i]), name[i]))
    return fit([rows[i] for i in order], np.array([grades[i] for i in order], np.int64), n_grades)


def rate(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """All columns of `docs` with expected_grade, tail_probability and kept.

    Grades: 0 poor, 1 good but toxic, 2 good and clean. expected_grade is the mean grade under
    the model (0 to 2), tail_probability that of the highest grade, kept whether it reaches
    `least`. A text that is null or blank has no evidence and is not kept. Rows are judged by
    their text alone, so doc_id may be null or repeated. Columns of `docs` that have one of
    the three names are replaced. Without labels of two grades the model is flat: every
    text with a word gets the same probability. An empty table gives an empty result.

    Method: cumulative-link regression; one weight vector over hashed words and a few shares,
    shared by all grades, and ordered thresholds. Each task rates whole texts, in
    slices, with the weights in its closure (2 MB).
    """
    weight, cuts = train(docs, labels, grade_of_labels(), 3)
    weight = weight.astype(np.float32)
    names = [c for c in docs.columns if c not in ("expected_grade", "tail_probability", "kept")]
    docs = docs.select(*names)
    schema = (docs.withColumn("expected_grade", F.lit(0.0)).withColumn("tail_probability", F.lit(0.0))
              .withColumn("kept", F.lit(True)).schema)

    def run(batches):
        for batch in batches:
            buf, off = utf8(batch.column("text"))
            for i, j in parts(off, SLICE):
                text, at = buf[off[i]:off[j]], off[i:j + 1] - off[i]
                row, feature = features(text, at)
                eta = np.bincount(row, weight[feature], j - i)
                above = _sigmoid(eta[:, None] - cuts)
                words = np.diff(word_spans(text, at)[2]) > 0
                part = batch.slice(i, j - i)
                yield pa.record_batch([*part.columns, pa.array(np.where(words, above.sum(1), 0.0)),
                                       pa.array(np.where(words, above[:, -1], 0.0)),
                                       pa.array(words & (above[:, -1] >= least))],
                                      names=[*part.schema.names, "expected_grade", "tail_probability", "kept"])
        release()

    return docs.mapInArrow(run, schema)
