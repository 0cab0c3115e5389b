"""The text operators on a small awkward table, against plain Python."""

import hashlib
import math
import random
import re
import sys
import unicodedata
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from stemma.llm import language, licenses, near, neighbours, packing, phrases, quality, repeats, scoring  # noqa: E402
from stemma.llm.bpe import coder, encode_digests, encode_in_chunks  # noqa: E402
from stemma.llm.sample import least_hashed  # noqa: E402
from stemma.llm.suffix import repeated  # noqa: E402

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score string, kept string"
FOLD = {i: i + 32 for i in range(65, 91)}


def words_of(text):
    return re.findall("[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def awkward():
    """Nulls, empty, blank and very long texts, ties, repeated rows, exact and near copies."""
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 400)}é" for _ in range(400)]
    near_copy = list(base)
    near_copy[7] = "changed"
    passage = "This passage of more than fifty bytes stands in several documents of the table. "
    texts = [" ".join(base), " ".join(base).upper().replace("É", "é"), " ".join(near_copy), None, "", "   \n",
             "one two", "One  TWO", "a", passage, "Before it. " + passage + "After it.", passage * 3,
             "The MIT License. Released under the Apache License, Version 2.0!", "General\nPublic-License mit license",
             "x" * 300_000, "é" * 20, "12 34 !!", "<|endoftext|> and  more", " ".join(base[:200]),
             "日本語 テキスト です " * 30, "ab" * 200]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [(0, " ".join(base)), (0, " ".join(base)), (9, "same id, other text"), (None, passage), (None, None)]
    return [(i, t, ("en", "fr", None)[k % 3], "s", 1, 2, "x", "y") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    """Stands here and not in a conftest module, which would hide the one of the other tests."""
    session = (
        SparkSession.builder.master("local[4]").appName("llm-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def got_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- repeats ---------------------------------------------------------------

def repeats_by_hand(rows, length=50):
    first = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for k in range(len(b) - length + 1):
                s = b[k:k + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k:k + length]] < i:
                gone[k:k + length] = b"\1" * length
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(b)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [500, 2_000_000])
def test_repeats(docs, corpus, monkeypatch, shard):
    monkeypatch.setattr(repeats, "SHARD", shard)
    monkeypatch.setattr(repeats, "BUCKET", 4 * shard)
    small = [(r[0], r[1]) for r in awkward() if r[1] is None or len(r[1]) < 100_000]
    got = got_of(repeats.repeated_spans(docs.filter("text is null or length(text) < 100000")).drop("spans"))
    assert got == repeats_by_hand(small)
    if shard > 500:
        got = got_of(repeats.repeated_spans(corpus).drop("spans"))
        assert got == repeats_by_hand([(r.doc_id, r.text) for r in corpus.collect()])


def test_repeats_edges(docs, empty):
    assert repeats.repeated_spans(empty).count() == 0
    out = repeats.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = {r.text for r in out.filter("doc_id in (30, 33)").collect()}
    assert got == {"Before it. After it.", ""} or "Before it. " in "".join(got)


def test_repeated_against_sets():
    rng = np.random.default_rng(1)
    for _ in range(100):
        length = int(rng.integers(2, 12))
        parts = [bytes(rng.integers(97, 99, rng.integers(0, 60)).astype(np.uint8)) for _ in range(4)]
        seen, want = set(), []
        for p in parts:
            s = [p[i:i + length] for i in range(len(p))]
            want += [len(x) == length and x in seen for x in s]
            seen.update(x for x in s if len(x) == length)
        owner = np.repeat(np.arange(4), [len(p) for p in parts])
        assert repeated(np.frombuffer(b"".join(parts), np.uint8), owner, length).tolist() == want


# ---- near copies -----------------------------------------------------------

def near_by_hand(rows, n, percent=80):
    sets = []
    for i, t in rows:
        w = words_of(t)
        grams = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        sets.append((i, grams))
    top = {i: i for i, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b:
                if 100 * len(a & b) >= percent * len(a | b):
                    p, q = find(i), find(j)
                    top[max(p, q)] = min(p, q)
    return sorted([(i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets], key=repr)


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(docs, corpus, words):
    got = got_of(near.near_duplicates(docs, words=words))
    assert got == near_by_hand([(r[0], r[1]) for r in awkward()], words)
    if words == 4:
        got = got_of(near.near_duplicates(corpus, words=4))
        assert got == near_by_hand([(r.doc_id, r.text) for r in corpus.collect()], 4)


def test_near_duplicates_in_blocks(spark, empty, monkeypatch):
    """A group of chained near copies, whose nodes and clusters are cut into small blocks."""
    monkeypatch.setattr(near, "BLOCK", 8)
    monkeypatch.setattr(near, "SMALL", 0)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        copy = list(base)
        for k in rng.sample(range(120), rng.randint(0, 8)):
            copy[k] = f"x{i}-{k}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_of(near.near_duplicates(df, words=4, node_size=16)) == near_by_hand(rows, 4)
    assert near.near_duplicates(empty).count() == 0


# ---- neighbours ------------------------------------------------------------

def test_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype("float32").tolist(), 1) for i in range(400)]
    rows += [(900 + i, rows[0][1], 2) for i in range(15)]
    rows += [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, [1.0, None] * 4, 0), (1003, [float("nan")] * 8, 0),
             (1100, [1.0] * 4, 0), (None, [1.0] * 8, 0), (5, rows[5][1], 3), (1200, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, size int")
    got = {}
    for q, rank, v, s in got_of(neighbours.nearest(df, df.filter("vec_id % 100 = 0"))):
        got.setdefault(q, []).append((rank, v, s))
    good = {i: np.array(v, np.float64) for i, v, _ in rows if i is not None and i < 1000}
    assert set(got) == {0, 100, 200, 300, 900}
    hits = 0
    for q, found in got.items():
        far = sorted((float(np.sqrt(((good[v] - good[q]) ** 2).sum())), v) for v in good if v != q)[:10]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert all(s == float(np.sqrt(((good[v] - good[q]) ** 2).sum())) for _, v, s in found)
        hits += len({v for _, v in far} & {v for _, v, _ in found})
    assert hits >= 0.9 * 50
    assert neighbours.nearest(df.limit(0), df).count() == 0 and neighbours.nearest(df, df.limit(0)).count() == 0


def test_forest_recall_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in df.collect()}
    ids = np.array(sorted(rows))
    points = np.array([rows[i] for i in ids])
    hit = 0
    got = neighbours.nearest(df, df.filter("vec_id % 100 = 0")).collect()
    for q in {r.query_id for r in got}:
        far = np.sqrt(((points - rows[q]) ** 2).sum(1))
        far[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, far))[:10]].tolist())
        hit += len(best & {r.vec_id for r in got if r.query_id == q})
    assert hit >= 0.9 * len(got)


# ---- licenses --------------------------------------------------------------

def licenses_by_hand(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    found = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w))
             if w[k:k + len(p.split())] == p.split()]
    at = [k for k, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_licenses(docs, corpus, empty):
    for df in (docs, corpus):
        got = got_of(licenses.scan_licenses(df).select(
            "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))
        want = [(r.doc_id, *licenses_by_hand(r.text)) for r in df.select("doc_id", "text").collect()]
        assert got == sorted(want, key=repr)
    assert licenses.scan_licenses(empty).count() == 0


def test_license_rules_suppress_contained_matches(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, "GNU General Public License v3 or mit license"),
            (3, "SPDX-License-Identifier: MPL-2.0"), (4, "plain words"), (5, "CC BY-NC-SA 4.0 license")]
    got = {r.doc_id: r for r in licenses.scan_licenses(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "apache,apache-2.0" and got[1].score == 0.8
    assert set(got[2].labels.split(",")) >= {"gpl", "mit"}
    assert got[3].labels == "mpl-2.0" and got[3].score == 1.0 and got[3].n_base == 0
    assert got[4].labels == "" and got[4].score == 0.0
    assert got[5].labels == "cc-by-nc-sa"
    assert len(licenses.rules()) > 300


def test_license_scan_is_sql_only(corpus):
    plan = licenses.scan_licenses(corpus)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def phrases_of(pattern):
    """All texts that a pattern stands for; of a set of characters the first, of repeats the fewest and one."""
    from re import _constants as c, _parser as parser

    def texts(items):
        out = [""]
        for op, arg in items:
            if op is c.LITERAL:
                more = [chr(arg)]
            elif op is c.IN:
                more = [chr(arg[0][1]) if arg[0][0] is c.LITERAL else chr(arg[0][1][0]) if arg[0][0] is c.RANGE else "a"]
            elif op is c.BRANCH:
                more = [t for branch in arg[1] for t in texts(branch)]
            elif op is c.SUBPATTERN:
                more = texts(arg[3])
            else:
                assert op is c.MAX_REPEAT
                more = [t * n for n in {arg[0], max(arg[0], 1)} for t in texts(arg[2])]
            out = [a + b for a in out for b in more]
        return out

    got = texts(parser.parse(pattern))
    assert all(re.fullmatch(pattern, t) for t in got)
    return got


def test_every_license_phrase_has_the_keywords_of_its_rule():
    for label, _, pattern, one, two in licenses.rules():
        for t in phrases_of(pattern):
            assert one in t and any(k in t for k in two) and re.search(licenses.GATE, t), (label, t)


def test_plain_statements_of_the_gpl(spark):
    texts = [("licensed under the GPL", "gpl-any"), ("Released under the terms of the General Public Licence", "gpl-any"),
             ("This is GPL licensed.", "gpl-any"), ("free code, GPLv2", "gpl-2.0"), ("free code: LGPLv2.1", "lgpl-2.1"),
             ("either version 2 of the License, or (at your option) any later version", "gpl-any"),
             ("licensed under the GPL version 3", "gpl-3.0")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(df).collect()}
    assert [got[i] for i in range(len(texts))] == [label for _, label in texts]


def test_license_rules_fire_on_their_own_phrase_alone(spark):
    texts = [(f"SPDX-License-Identifier: {ident.replace(' ', '-').upper()}", label)
             for label, _, ident, _ in licenses.FAMILIES]
    texts += [("licensed under the Expat license", "mit"), ("licensed under the Open Database License", "odbl"),
              ("licensed under the 2 clause license", "bsd-2-clause"),
              ("released under the Internet Systems Consortium license", "isc")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan_licenses(df).collect()}
    assert [t for i, t in enumerate(texts) if t[1] not in got[i]] == []


# ---- language and quality --------------------------------------------------

def test_language(docs, corpus, empty):
    out = language.identify(corpus).select("doc_id", "lang", "held_out", "lang_pred", "score").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    got = language.identify(docs)
    assert got.count() == docs.count()
    for r in got.collect():
        if not any(unicodedata.category(c)[0] == "L" for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "fr")
    assert language.identify(empty).count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    """More than 200 values of lang, each with letters of its own and two documents to learn from."""
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 != 2]
    letters = [chr(0x4E00 + 37 * k) for k in range(230)]
    rows = [(ids[2 * k + n], (letters[k] + " ") * 9, f"l{k:03}") for k in range(230) for n in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in (1024, 120):       # also one landmark a language
        monkeypatch.setattr(language, "MARKS", most)
        out = language.identify(df).collect()
        assert len({r.lang_pred for r in out}) > 225
        assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)


def test_kernel_is_the_share_of_common_runs():
    texts = ["abcab", "ABC", "zz", ""]
    raw = [t.encode() for t in texts]
    off = np.r_[0, np.cumsum([len(b) for b in raw])]
    rows = language.presence(np.frombuffer(b"".join(raw), np.uint8), off)
    grams = [{t.lower()[i:i + n] for n in language.GRAMS for i in range(len(t) - n + 1)} for t in texts]
    assert rows.sum(1).tolist() == [len(g) for g in grams]
    assert (rows[0] @ rows[1], rows[0] @ rows[2]) == (len(grams[0] & grams[1]), 0)


@pytest.fixture(scope="module")
def rated(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return (quality.rate(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id")
            .select("lang", "quality", "toxic", "kept").collect())


def test_quality(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.rate(d, labels).join(labels, "doc_id").select("quality", "toxic", "kept", "expected_grade").collect()
    clean = [r.kept for r in out if r.quality == 1 and r.toxic == 0]
    poor = [r.kept for r in out if r.quality == 0]
    toxic = [r.kept for r in out if r.quality == 1 and r.toxic == 1]
    assert sum(clean) >= 0.97 * len(clean) and sum(poor) <= 0.25 * len(poor) and sum(toxic) <= 0.4 * len(toxic)
    assert all(0 <= r.expected_grade <= 2 for r in out)
    got = quality.rate(docs, labels)
    assert got.count() == docs.count() and got.columns[-3:] == ["expected_grade", "tail_probability", "kept"]
    assert not any(r.kept for r in got.collect() if not words_of(r.text))
    assert quality.rate(empty, labels.limit(0)).count() == 0
    assert quality.rate(docs, labels.limit(0)).count() == docs.count()


def test_samples_are_the_least_hashes(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 10 = 0, 'rare', 'often') as kind", "xxhash64(id) as h")
    rows = rows.unionByName(rows.filter("id = 7"))
    got = [(r.kind, r.id) for r in least_hashed(rows, "kind", "id", 300).collect()]
    for kind in ("rare", "often"):
        all_of = sorted((r.h, r.id) for r in rows.filter(f"kind = '{kind}'").collect())
        assert sorted(i for k, i in got if k == kind) == sorted(i for _, i in all_of[:300])
    assert least_hashed(rows.limit(0), "kind", "id", 3).count() == 0


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for i in range(300):
        g = i % 3
        rows.append(np.unique(np.r_[rng.integers(100, 200, 20), [g]]))
        grades.append(g)
    weight, cuts = quality.fit(rows, np.array(grades), 3)
    eta = np.array([weight[r].sum() for r in rows])
    assert np.diff(cuts) > 0 and [eta[np.array(grades) == g].mean() for g in range(3)] == sorted(
        eta[np.array(grades) == g].mean() for g in range(3))
    assert ((eta[:, None] > cuts).sum(1) == grades).mean() > 0.95


def test_evidence_of_a_small_language_counts_in_a_large_sample():
    """Eight toxic texts of a language share a word that no other text has, among 6000 rows."""
    rng = np.random.default_rng(1)
    rows, grades, lang = [], [], []
    for i in range(6000):
        small, g = i % 60 == 0, (0, 2, 2, 2, 1)[i // 60 % 5] if i % 60 == 0 else (0, 1, 2)[i % 3]
        small_toxic = small and g == 1 and lang.count(1) < 60
        g = g if not small or g != 1 or small_toxic else 2
        base = 1000 * (2 if small else 1)
        rows.append(np.unique(np.r_[rng.integers(base, base + 300, 20), [base + 500 + g]]))
        grades.append(g)
        lang.append(int(small))
    grades, lang = np.array(grades), np.array(lang)
    weight, cuts = quality.fit(rows, grades, 3)
    kept = np.array([weight[r].sum() for r in rows]) > cuts[1]
    for k in (0, 1):
        assert kept[(lang == k) & (grades == 1)].mean() <= 0.25 and kept[(lang == k) & (grades == 2)].mean() >= 0.9


@pytest.mark.parametrize("lang", ["de", "en", "es", "fr"])
def test_toxic_recall_of_each_language(spark, lang, rated):
    clean = [r.kept for r in rated if r.lang == lang and r.quality == 1 and r.toxic == 0]
    toxic = [r.kept for r in rated if r.lang == lang and r.quality == 1 and r.toxic == 1]
    assert sum(toxic) <= 0.25 * len(toxic) and sum(clean) >= 0.85 * len(clean)


# ---- tokens ----------------------------------------------------------------

def test_bpe(docs, empty):
    tool = Tokenizer.from_file(BPE)
    want = []
    for r in awkward():
        ids = tool.encode(r[1] or "", add_special_tokens=False).ids
        text = tool.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    assert got_of(encode_digests(docs, BPE)) == sorted(want, key=repr)
    assert encode_digests(empty, BPE).count() == 0


def test_chunk_joins_are_exact():
    rng = random.Random(0)
    tool = coder(BPE)
    parts = [" ", "a", "bc", "'s", "\n", "é", "日", "1", "!", "  ", " the", " of", "　", "\x1c", "<|endoftext|>"]
    for k in range(120):
        text = "".join(rng.choices(parts[:-1] if k % 9 else parts, k=rng.randint(1, 4000)))
        got = np.frombuffer(encode_in_chunks(tool, text), "<u4").tolist()
        assert got == tool.tool.encode(text, add_special_tokens=False).ids


def test_packing(docs, empty):
    tool = Tokenizer.from_file(BPE)
    rows = packing.pack(docs, BPE, keep_ids=True).collect()
    by_doc = Counter()
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 2048 and zlib.crc32(r.ids) == r.ids_crc32
        by_doc[r.doc_id] += r.length
    want = Counter()
    for r in awkward():
        want[r[0]] += len(tool.encode(r[1] or "", add_special_tokens=False).ids) + 1
    assert by_doc == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 2048
    # no two pieces of more than half a sequence share one
    assert len(bins) == max(math.ceil(sum(want.values()) / 2048), sum(r.length > 1024 for r in rows))
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 42)
    assert [s for _, s, _ in long] == [0, *np.cumsum([n for *_, n in long])[:-1].tolist()]
    assert all(n == 2048 for *_, n in long[1:])
    assert packing.pack(empty, BPE).count() == 0


def test_best_two_fit():
    rng = np.random.default_rng(0)
    for n, high in ((1, 5), (60, 10), (2000, 100), (2000, 64)):
        x = rng.integers(1, high + 1, n)
        number, place = packing.best_two_fit(x, 100)
        fill = np.bincount(number, x)
        assert fill.max() <= 100 and len(fill) <= math.ceil(x.sum() / 100) * 1.05 + 1
        for k in range(len(fill)):
            i = np.flatnonzero(number == k)
            i = i[np.argsort(place[i])]
            assert place[i].tolist() == [0, *np.cumsum(x[i])[:-1].tolist()]
    # the smallest piece (3) gives way to two (2 and 4) that fill the gap
    number, _ = packing.best_two_fit(np.array([7, 5, 3, 4, 2]), 13)
    assert len(set(number.tolist())) == 2


# ---- language model and phrases --------------------------------------------

def test_scores(docs, corpus, empty):
    for df in (docs, corpus):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        count = Counter()
        for i, t in rows:
            if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
                count.update(words_of(t) + [0])
        total, kinds = sum(count.values()), len(count)
        want = []
        for i, t in rows:
            w = words_of(t) + [0]
            held = i is None or zlib.crc32(str(i).encode()) % 7 == 2
            base = sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w)
            want.append((i, held, len(w), sum(count[x] > 0 for x in w), total, round(base, 5)))
        out = scoring.score_documents(df).collect()
        assert sorted([(*r[:5], round(r.base_score, 5)) for r in out], key=repr) == sorted(want, key=repr)
        assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert scoring.score_documents(empty).count() == 0


def test_recurrent_model_learns_and_sums_to_one():
    from stemma.llm.recurrent import Recurrent
    rng = np.random.default_rng(0)
    stream = np.tile([5, 9, 40, 2, 7], 600)
    model = Recurrent()
    words, cut = stream[:50], np.array([0, 30, 50])
    before = model.score(words, cut).sum()
    for _ in range(5):
        model.train(stream, rows=16)
    assert model.score(words, cut).sum() > before / 5
    state = rng.normal(size=(1, 16)).astype(np.float32)
    every = np.arange(model.classes ** 2)
    assert abs((10 ** model.outputs(np.repeat(state, len(every), 0), every)).sum() - 1) < 1e-3
    alone = np.concatenate([model.score(words[a:b], np.array([0, b - a])) for a, b in zip(cut[:-1], cut[1:])])
    assert np.allclose(alone, model.score(words, cut), atol=1e-4)


def test_model_of_all_documents(spark):
    """Held-out perplexity is below the base's and falls with the size of the corpus."""
    rng = random.Random(6)
    follow = {f"w{k}": [f"w{(k * 7 + j) % 60}" for j in range(3)] for k in range(60)}

    def text():
        w = ["w0"]
        for _ in range(80):
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w)

    rows = [(i, text()) for i in range(4000)]
    told = []
    for n in (300, 4000):
        out = scoring.score_documents(spark.createDataFrame(rows[:n], "doc_id long, text string").repartition(2))
        held = [r for r in out.collect() if r.held_out and r.doc_id < 300]
        told.append(sum(r.score for r in held) / sum(r.n_tokens for r in held))
        assert told[-1] > sum(r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert told[1] > told[0] + 0.04
    assert scoring.classes_for(10**9) > scoring.classes_for(10**8) > scoring.classes_for(0) == 16


def test_scores_against_a_plain_forward_pass(spark, monkeypatch):
    """Every word of every held-out document, one at a time, through the weights that training gave."""
    kept = []
    real = scoring.train
    monkeypatch.setattr(scoring, "train", lambda *a: kept.append((real(*a), *a[1:3])) or kept[-1][0])
    rows = [(i, f"one two {'three ' * (i % 5)}four x{i}") for i in range(60)]
    out = {r.doc_id: r for r in scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    model, known, number = kept[0]
    p = {k: v.astype(float) for k, v in model.p.items()}
    h, c = 16, model.classes
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*words_of(t), None])
    low = sum(counts.values()) * 1 + len(counts) + 1
    for i, t in rows:
        table = scoring._words(__import__("pyarrow").table({"doc_id": [i], "held_out": [True], "text": [t]}))
        ids = scoring._numbers(table[1], known, number).tolist()
        s, last, total = np.zeros(h), 0, 0.0
        for w, word in zip(ids, [*words_of(t), None]):
            a = p["input"][last]
            g = 1 / (1 + np.exp(-(a[:2 * h] + s @ p["gates"])))
            s = s + g[h:] * (np.tanh(a[2 * h:] + (g[:h] * s) @ p["state"]) - s)
            for logits, k in ((s @ p["classes"] + p["class_bias"], w // c), (s @ p["words"][w // c] + p["word_bias"][w // c], w % c)):
                total += (logits[k] - np.log(np.exp(logits).sum())) / np.log(10)
            if w == 1:
                total += math.log10((counts[word] + 1) / low)
            last = w
        assert abs(out[i].score - total) < 1e-3


def test_samples_stay_bounded_where_ids_repeat(spark, monkeypatch):
    """Many rows of a few ids: as many are fitted as the bound says, and equal ones once."""
    monkeypatch.setattr(quality, "PER_GRADE", 10)
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, grades, n: seen.append(len(rows)) or (
        np.zeros(quality.SIZE), np.array([-1.0, 1.0])))
    docs = spark.createDataFrame([(i % 3, f"word{i % 500} and more") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.rate(docs, labels).count() == 3000 and seen == [30]
    monkeypatch.setattr(language, "PER_LANGUAGE", 10)
    sums = []
    real = language.Model.solve
    monkeypatch.setattr(language.Model, "solve", lambda self, square, of, share: sums.append(square[-1, -1]) or real(
        self, square, of, share))
    told = docs.selectExpr("doc_id + 4 as doc_id", "text", "'en' as lang")
    assert language.identify(told).count() == 3000
    assert sums and sums[0] <= 10


def test_equal_rows_are_dealt_to_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 100)
    docs = spark.createDataFrame([(1, "same text")] * 1000, "doc_id long, text string")
    got = packing.pack(docs, BPE, 64).collect()
    groups = Counter(r.sequence_id >> 40 for r in got)
    assert len(got) == 1000 and len(groups) == 10 and max(groups.values()) < 200


def phrase_ends(text):
    known, out, i = set(), [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i:j] in known:
            j += 1
        known.add(text[i:j])
        out.append(j)
        i = j
    return out


def test_phrases():
    rng = random.Random(3)
    for _ in range(150):
        text, other = ("".join(rng.choices("abé", k=rng.randint(0, 200))) for _ in range(2))
        ends = []
        phrases.parse(text, 0, set(), ends)
        assert ends == phrase_ends(text)
        parsed = phrases.Parsed(text)
        edited, minima = parsed.edited(other)
        assert edited == text[:len(text) - len(text) // 2] + other[:len(text) // 2]
        assert (minima == phrases.Parsed(edited).print).all()


@pytest.mark.parametrize("bucket", [400, 16_000_000])
def test_fingerprints(docs, corpus, empty, monkeypatch, bucket):
    monkeypatch.setattr(phrases, "BUCKET", bucket)
    for df in (docs.filter("doc_id is not null and doc_id not in (0, 9)"), corpus):
        rows = sorted((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())
        want = []
        for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
            edited = a[:len(a) - len(a) // 2] + b[:len(a) // 2]
            pa, pe, pb = (phrases.Parsed(t).print for t in (a, edited, b))
            want.append((i, len(a), hashlib.sha256(edited.encode()).hexdigest(), phrases.written_out(pa),
                         phrases.written_out(pe), phrases.likeness(pa, pe), phrases.likeness(pa, pb)))
        assert got_of(phrases.fingerprints(df)) == sorted(want, key=repr)
    assert phrases.fingerprints(docs).count() == docs.count()
    assert phrases.fingerprints(empty).count() == 0


# ---- pipeline --------------------------------------------------------------

def test_pipeline(spark, docs):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    kept, names = rows, [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "quality", "near_copies", "repeats", "packing"]
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = kept
        kept = stage(spark, kept, sf)
        assert kept.columns == rows.columns
        kept = kept.cache()
        if name == "near_copies":
            want = near_by_hand([(r.doc_id, r.text) for r in before.collect()], 5)
            assert {r.doc_id for r in kept.collect()} == {i for i, _, _, k in want if k}
        elif name == "repeats":
            want = {i: n for i, _, n, *_ in repeats_by_hand([(r.doc_id, r.text) for r in before.collect()])}
            size = {r.doc_id: len(r.text.encode()) for r in before.collect()}
            got = {r.doc_id: len(r.text.encode()) for r in kept.collect()}
            assert all(size[i] - want[i] - 6 * (want[i] > 0) * 50 <= got[i] <= size[i] - want[i] for i in size)
        else:
            assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in before.collect()}
    packed = corpus_pipeline.packing(spark, kept, sf)
    assert packed.select("doc_id").distinct().count() == kept.count()
    odd = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        odd = stage(spark, odd, sf)
        assert odd.columns == docs.columns
    assert corpus_pipeline.packing(spark, odd, sf).count() >= odd.select("doc_id").distinct().count()


def test_near_copies_by_row(spark):
    """Different texts of one doc_id stay, and copies go whatever their ids."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (2, b), (2, c), (2, a + " more"), (3, c), (4, d), (4, d), (None, b), (None, "x " + d), (None, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_copies(spark, df, "")
    assert got.columns == df.columns
    want = [(1, a), (2, b), (2, c), (4, d), (None, "alone here")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
