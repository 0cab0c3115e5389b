"""Scoring of whole documents by word counts of the corpus and by a recurrent model."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stemma.llm.arrays import Hasher, mix, utf8, word_spans
from stemma.llm.recurrent import END, UNKNOWN, Recurrent
from stemma.plans.durable import written

U64 = np.uint64
SHARD = 8_000_000      # bytes of text of one shard, about
BUCKET = 16_000_000    # bytes of text whose words meet in one task, about
STREAM = 1 << 18       # words that a task trains on at a time, about; documents stay whole
ROUNDS = (1, 2, 4, 8)  # eighths of the training documents that each round ends with
CHUNK = 1 << 16        # numbers of a model that are averaged together
SALTS = 256            # groups of models that are averaged first
END_WORD = 0x51ED270B27A5F3C1

_sent = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("data", pa.binary())])
_SENT = "bucket long, shard long, data binary"


def _words(table):
    """Word hashes of a shard with an end after each text, the offsets of texts, and held_out."""
    table = table.select(["doc_id", "held_out", "text"]).sort_by(
        [("doc_id", "ascending"), ("held_out", "ascending"), ("text", "ascending")])
    buf, off = utf8(table.column("text"))
    starts, ends, cut = word_spans(buf, off)
    n = len(off) - 1
    out = np.full(len(starts) + n, END_WORD, np.uint64)
    row = np.repeat(np.arange(n), np.diff(cut))
    out[np.arange(len(starts)) + row] = Hasher(buf, lower=True).of(starts, ends)
    return table, out, cut + np.arange(n + 1), table.column("held_out").to_numpy()


def _distinct(words, buckets):
    """Distinct words by bucket and value, the cuts between buckets, and each token's entry."""
    word, entry = np.unique(words, return_inverse=True)
    bucket = (mix(word) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return word[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), place[entry]


def _count(buckets):
    def run(table):
        shard = table.column("shard")[0].as_py()
        _, words, cut, held = _words(table)
        word, at, entry = _distinct(words, buckets)
        count = np.bincount(entry[np.repeat(~held, np.diff(cut))], minlength=len(word))
        rows = {"bucket": [], "shard": [], "data": []}
        for k in np.flatnonzero(np.diff(at)).tolist():
            part = slice(at[k], at[k + 1])
            rows["bucket"].append(k)
            rows["shard"].append(shard)
            rows["data"].append(word[part].tobytes() + count[part].astype(np.uint32).tobytes())
        return pa.table(rows, schema=_sent)
    return run


_COUNTS = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("data", pa.binary()), ("tokens", pa.int64()),
                     ("distinct", pa.int64()), ("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def _total(vocabulary: int):
    def run(table):
        return _summed(table, vocabulary)
    return run


def _summed(table, vocabulary):
    """Adds up the counts of a bucket and gives each shard the sums of its words, in its order.

    One more row, of shard -1, has the bucket's tokens, distinct words and most frequent words.
    """
    sent = []
    for d in table.column("data").to_pylist():
        n = len(d) // 12
        sent.append((np.frombuffer(d, np.uint64, n), np.frombuffer(d, np.uint32, n, 8 * n)))
    word, entry = np.unique(np.concatenate([w for w, _ in sent]), return_inverse=True)
    total = np.bincount(entry, np.concatenate([c for _, c in sent]).astype(np.float64)).astype(np.int64)
    back, lo = [], 0
    for w, _ in sent:
        back.append(total[entry[lo:lo + len(w)]].tobytes())
        lo += len(w)
    top = np.lexsort((word, -total))[:vocabulary]
    top = top[total[top] > 0]
    n, none = table.num_rows, [None]
    return pa.table({
        "bucket": table.column("bucket").to_pylist() + [table.column("bucket")[0].as_py()],
        "shard": table.column("shard").to_pylist() + [-1], "data": back + none,
        "tokens": [None] * n + [int(total.sum())], "distinct": [None] * n + [int((total > 0).sum())],
        "words": [None] * n + [word[top].view(np.int64).tolist()], "counts": [None] * n + [total[top].tolist()],
    }, schema=_COUNTS)


def _numbers(words, known, number):
    """Vocabulary numbers of word hashes; words outside are UNKNOWN."""
    if not len(known):
        return np.where(words == U64(END_WORD), END, UNKNOWN)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return np.where(known[at] == words, number[at], UNKNOWN)


def classes_for(n_bytes: int) -> int:
    """Output classes of the model; their square, the vocabulary, grows with the text (1024 words at 170 MB)."""
    return max(16, round(n_bytes ** 0.2 / 1.4))


_MODEL = pa.schema([("chunk", pa.int32()), ("salt", pa.int32()), ("part", pa.int32()), ("tokens", pa.int64()),
                    ("data", pa.binary())])
_MODELS = "chunk int, salt int, part int, tokens long, data binary"


def _averaged(table):
    """The mean of a chunk over models, weighted by the words that each has seen."""
    table = table.sort_by("part")
    tokens = table.column("tokens").to_pylist()
    total = sum(tokens)
    mean = sum(np.frombuffer(x.as_py()) * (n / total) for x, n in zip(table.column("data"), tokens))
    head = [table.column(c)[0].as_py() for c in ("chunk", "salt")]
    return pa.table({"chunk": [head[0]], "salt": [head[1]], "part": [head[1]], "tokens": [total], "data": [mean.tobytes()]},
                    schema=_MODEL)


def train(docs: DataFrame, known: np.ndarray, number: np.ndarray, classes: int) -> Recurrent:
    """The recurrent model after one pass over all rows of `docs` that are not held out.

    Documents are dealt by id into rounds of growing size. In a round each task goes on from the model
    of the last round over its own documents, whole ones end to end, and the tasks' models are averaged
    in chunks; the driver holds one model.
    """
    model = Recurrent(classes)
    eighth = F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(ROUNDS[-1]))
    for low, high in zip((0, *ROUNDS), ROUNDS):
        def run(batches, start=model.flat()):
            mine, waiting, n, seen = Recurrent(classes).load(start), [], 0, 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                _, words, cut, _ = _words(pa.Table.from_batches([batch]))
                for a, b in zip(cut[:-1], cut[1:]):
                    waiting.append(_numbers(words[a:b], known, number))
                    n += b - a
                    if n >= STREAM:
                        mine.train(np.concatenate([[END], *waiting]))
                        waiting, n, seen = [], 0, seen + n
            if n:
                mine.train(np.concatenate([[END], *waiting]))
                seen += n
            if seen:
                flat, part = mine.flat().astype(np.float64), TaskContext.get().partitionId()
                for k, lo in enumerate(range(0, len(flat), CHUNK)):
                    yield pa.record_batch([pa.array([k], pa.int32()), pa.array([part % SALTS], pa.int32()),
                                           pa.array([part], pa.int32()), pa.array([int(seen)]),
                                           pa.array([flat[lo:lo + CHUNK].tobytes()], pa.binary())], schema=_MODEL)

        part = docs.filter(~F.col("held_out")).filter((eighth >= low) & (eighth < high))
        mean = (part.mapInArrow(run, _MODELS).groupBy("chunk", "salt").applyInArrow(_averaged, _MODELS)
                .groupBy("chunk").applyInArrow(_averaged, _MODELS).toArrow().sort_by("chunk"))
        if mean.num_rows:
            model.load(np.frombuffer(b"".join(mean.column("data").to_pylist())))
    return model


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                  ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def held_out():
    """Whether crc32 of the id's decimal digits leaves 2 when divided by 7; null ids are held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(True))


def score_documents(docs: DataFrame) -> DataFrame:
    """Log10 probabilities of whole texts: one row per row of `docs`.

    Columns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Tokens are
    the white-space words of the text, A-Z lower-cased, and one end. base_score adds up
    log10((c + 1) / (N + V + 1)) with the corpus counts of the rows that are not held out. score is
    the recurrent model's; a word outside its vocabulary has the model's probability of
    the unknown word times its base probability. Null text is empty: one end. Rows that
    share a doc_id count and are scored each; rows without doc_id are held out. Without any
    row to learn from, N and V are 0. Other columns are ignored; an empty table gives an
    empty result. Words are told apart by 64-bit hashes.

    Word counts cover all rows: shards send each distinct word once, buckets of words add up
    and answer each shard, and nothing larger than a shard or a bucket meets in a task. A word
    in every document is one entry per shard. The vocabulary is that of the most frequent words, more of
    them the more text there is (`classes_for`). The model is trained by the tasks on all documents that are
    not held out, whole, in windows of truncated backpropagation (`train`). Scoring carries the state
    through each whole document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("held_out", held_out())
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    classes = classes_for(n_bytes or 0)
    shards = max(1, math.ceil((n_bytes or 0) / SHARD))
    buckets = max(1, math.ceil((n_bytes or 0) / BUCKET))
    by_shard = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(shards))).groupBy("shard")
    counts = (by_shard.applyInArrow(_count(buckets), _SENT).groupBy("bucket")
              .applyInArrow(_total(classes * classes), "bucket long, shard long, data binary, tokens long, distinct long, "
                                    "words array<long>, counts array<long>"))
    counts = written(counts, "word-counts")
    stats = counts.filter("shard = -1")
    tokens, kinds = stats.agg(F.sum("tokens"), F.sum("distinct")).first()
    tokens, kinds = tokens or 0, kinds or 0
    top = (stats.select(F.explode(F.arrays_zip("counts", "words")).alias("w")).select("w.*")
           .filter(F.col("words") != F.lit(END_WORD)).orderBy(F.desc("counts"), "words").limit(classes * classes - 2).collect())
    ranked = np.array([END_WORD] + [r["words"] for r in top], np.int64).view(np.uint64)
    number = np.r_[END, np.arange(2, len(ranked) + 1)]
    order = np.argsort(ranked)
    known, number = ranked[order], number[order]

    model = train(docs, known, number, classes)
    model.square = {}
    low = math.log10(tokens + kinds + 1)

    def run(table, replies):
        table, words, cut, held = _words(table)
        _, _, entry = _distinct(words, buckets)
        c = np.frombuffer(b"".join(replies.sort_by("bucket").column("data").to_pylist()), np.int64)[entry]
        base = np.log10(c + 1) - low
        n = _numbers(words, known, number)
        p = model.score(n, cut) + np.where(n == UNKNOWN, base, 0)
        rows = len(cut) - 1
        add = [np.add.reduceat(x, cut[:-1]) for x in (c > 0, base, p)]
        return pa.table([table.column("doc_id"), table.column("held_out"), pa.array(np.diff(cut)),
                         pa.array(add[0].astype(np.int64)), pa.array(np.full(rows, tokens)), pa.array(add[1]),
                         pa.array(add[2])], schema=_OUT)

    return by_shard.cogroup(counts.filter("shard >= 0").select("shard", "bucket", "data").groupBy("shard")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
