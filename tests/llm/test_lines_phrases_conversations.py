"""Line dedup, collocations and conversation repair against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from stemma.llm import collocations as col, conversations as con, lines
from test_text_operators import FOLD, SCHEMA, awkward, corpus, docs, empty, got_of, spark  # noqa: F401

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


# ---- line dedup ------------------------------------------------------------

def lines_by_hand(rows, least, documents):
    holders = defaultdict(set)

    def key(line):
        return line.strip(WHITE).translate(FOLD)

    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    keep = {k: max((i for i in of if i is not None), default=None) for k, of in holders.items() if len(of) >= documents}
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if key(x) not in keep or keep[key(x)] == i]
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows():
    """Repeated lines in other case and padding, at the edge of the length, in one document only, without id."""
    rng = random.Random(9)
    common = ["A common line of exactly forty code point", "é" * 40, "short", " \t ", "x" * 39,
              "Another line that many of the documents do hold"]
    rows = [(r[0], r[1]) for r in awkward()]
    for i in range(100, 130):
        some = [rng.choice([c, c.upper(), f"  {c}\r", f"\x0b{c}\t"]) if c != "é" * 40 else c
                for c in rng.choices(common, k=rng.randint(0, 6))]
        rows.append((i, "\n".join([*some, f"own line {i} " * 5, *some[:1]])))
    rows += [(None, common[0] + "\n" + common[5]), (None, common[5]), (129, common[5]), (7, "\n"), (8, "\n\n" + common[0])]
    return rows


@pytest.mark.parametrize("least, documents, most, known", [(40, 5, 29, 1000), (40, 5, 16, 0), (5, 2, 29, 0), (1, 2, 18, 1000)])
def test_lines(spark, monkeypatch, least, documents, most, known):
    monkeypatch.setattr(lines, "SHARD", 50)
    monkeypatch.setattr(lines, "PIECE", 2000)
    monkeypatch.setattr(lines, "FAN_IN", 2)
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows],
                                 "doc_id long, text string, n_lines string, hash string").repartition(5)
    out = lines.drop_repeated_lines(docs, least, documents, most, known)
    assert out.columns == ["doc_id", "text", "hash", "n_lines", "n_dropped", "kept_text"]
    assert got_of(out.select("doc_id", "n_lines", "n_dropped", "kept_text")) == lines_by_hand(rows, least, documents)


def test_lines_with_a_crowded_filter(spark):
    """A filter much too small calls every line a suspect; the result is the same."""
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bits, twice = lines.twice_filter(docs, 1, 4)
    assert bits == 4 and len(twice) == 2 and twice.all()
    out = lines.drop_repeated_lines(docs, 40, 5, most=4)
    assert got_of(out.select("doc_id", "n_lines", "n_dropped", "kept_text")) == lines_by_hand(rows, 40, 5)


def test_few_lines_are_suspects(spark):
    """Lines that one document holds are not shuffled, however often it holds them."""
    docs = spark.range(2000).selectExpr(
        "id as doc_id", "concat_ws('\n', sha2(string(id), 256), sha2(string(id), 256), if(id < 6, repeat('a', 50), '')) as text")
    suspects, kept = lines.repeated_lines(docs.repartition(3))
    assert suspects.count() < 100 and [r.n_documents for r in kept.collect()] == [6]


def test_lines_edges(empty):
    out = lines.drop_repeated_lines(empty)
    assert out.count() == 0 and out.columns[-3:] == ["n_lines", "n_dropped", "kept_text"]


# ---- collocations ----------------------------------------------------------

def collocations_by_hand(rows, longest, least, top, share=50):
    f, total = defaultdict(Counter), Counter()
    for t, lang in rows:
        for piece in re.split("[.,;:!?\x0A-\x0D]", (t or "").translate(FOLD)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, n in f.items():
        found = [w for w, a in n.items() if len(w) > 1 and a >= least]
        longer = Counter()
        for w in found:
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    longer[w[i:i + k]] = max(longer[w[i:i + k]], n[w])
        scored = []
        for w in found:
            cuts = [(1_000_000 * n[w] ** 2 // (n[w[:k]] * n[w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if not (longer[w] and 100 * longer[w] >= share * n[w]):
                scored.append((-score, -n[w], " ".join(w).encode(), n[w[:k]], n[w[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -score)
                for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("longest, least, top", [(3, 10, 2000), (2, 2, 30), (4, 3, 50)])
def test_collocations(spark, corpus, longest, least, top):
    table = [(r.text, r.lang) for r in corpus.collect()]
    extra = [("a b c. " * 12 + "A B c\td " * 6, None), ("a b a b a b " * 5, "und"), (None, "en"), ("", None), ("...", "xx"),
             ("É é É é É é x É é " * 4, "fr"), ("一 二,三 " * 20, "zh"), ("one", "q")] * 2
    small = spark.createDataFrame([(i, t, lang, "x") for i, (t, lang) in enumerate(table + extra)],
                                  "doc_id long, text string, lang string, size string").repartition(4)
    got = col.collocations(small, longest, least, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert got_of(got) == collocations_by_hand(table + extra, longest, least, top)


def test_collocation_products_pass_64_bits(spark, monkeypatch):
    """Counts of 10^12 keep their exact score."""
    a, x, y = 10**12, 10**12 + 7, 3 * 10**12 + 1
    counts = spark.createDataFrame([("en", 0, "", 10**13), ("en", 1, "u", x), ("en", 1, "v", y), ("en", 2, "u v", a)],
                                   "lang string, size int, phrase string, a long")
    monkeypatch.setattr(col, "phrase_counts", lambda *_: counts)
    assert got_of(col.collocations(counts)) == [("en", 1, "u v", a, x, y, 10**13, 10**6 * a * a // (x * y))]


def test_collocations_edges(spark, docs, empty):
    assert col.collocations(empty).count() == 0
    small = [(r[1], r[2]) for r in awkward()]
    assert got_of(col.collocations(docs, 3, 2, 100)) == collocations_by_hand(small, 3, 2, 100)


# ---- conversations ---------------------------------------------------------

def repaired_by_hand(rows):
    """Each conversation by keeping, for the initials put out so far, the least (cost, letters)."""
    convs = {c: [] for c, *_ in rows}
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        r = "user" if k == 4 else r
        convs[c] += [(t, r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return sorted(((c, *_repaired(m)) for c, m in convs.items()), key=repr)


def _repaired(m):
    m = sorted(m, key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), hashlib.md5(z[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, r, x in m:
        ink = x.strip(WHITE)
        faults.append("blank" if not ink else "duplicate" if (r, x) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((r, x))
    turns = [t for t, _, _ in m if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(m, m[1:]))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def put(to, last, new, cost, audit, out):
        new = after.get((last, new))
        if new and (new not in to or (cost, audit) < to[new][:2]):
            to[new] = (cost, audit, out)

    def insert(to):
        for _ in range(4):
            for last, (cost, audit, out) in list(to.items()):
                for r in ("user", "assistant"):
                    put(to, last, r[0], cost + 5, audit + "I", (*out, f"{r}:"))

    insert(best)
    for (_, r, x), fault in zip(m, faults):
        new = {last: (cost + 2, audit + "D", out) for last, (cost, audit, out) in best.items()}
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            for last, (cost, audit, out) in best.items():
                put(new, last, r[:1], cost + more, audit + "K", (*out, f"{r}:{x}"))
                for q in ("user", "assistant"):
                    put(new, last, q[0], cost + 1 + more, audit + "R", (*out, f"{q}:{x}"))
        best = new
        insert(best)
    cost, audit, out = min(best[k] for k in ("", "a") if k in best)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def talks():
    rng = random.Random(3)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "Super"]
    texts = ["Fine.", "What?", "cut off", "", " \t\n", None, "Odd! ", "end\r\n", "é."]
    rows = []
    for c in [*range(40), None]:
        for t in range(rng.choice([1, 2, 3, 6, 12, 40])):
            t = rng.choice([t, t, t, 3 * t, None])
            rows.append((c, t, rng.choice(roles[:rng.choice([3, 9])]), rng.choice([f"Line {t}.", *texts])))
    rows += [(77, k, ("user", "assistant")[k % 2], f"Words {k % 90}.") for k in range(600)]
    return rows + rows[:5]


@pytest.mark.parametrize("chunk", [20_000, 13, 1])
def test_conversations(spark, chunk):
    rows = talks()
    if chunk == 1:
        rows = rows[:200]
    table = spark.createDataFrame([(*r, "x") for r in rows],
                                  "conv_id long, turn long, role string, text string, audit string").repartition(3)
    got = con.repair(table, con.damaged(table), chunk)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got_of(got) == repaired_by_hand(rows)


def test_repaired_messages(spark):
    rows = spark.createDataFrame([
        (1, 0, "assistant", "Hello."), (1, 1, "user", "Why?"), (1, 2, "user", "Because."), (1, 3, "user", "So it is."),
        (2, 0, "system", "Be brief."), (2, 1, "user", "How?")], "conv_id long, turn long, role string, text string")
    told = con.audits(rows)
    assert got_of(told.select("conv_id", "cost", "audit")) == [(1, 3, "RRKR"), (2, 2, "RR")]
    assert got_of(con.repaired_messages(rows, told)) == [
        (1, 0, "R", "user", "Hello."), (1, 1, "R", "assistant", "Why?"), (1, 2, "K", "user", "Because."),
        (1, 3, "R", "assistant", "So it is."), (2, 0, "R", "user", "Be brief."), (2, 1, "R", "assistant", "How?")]


def test_conversations_edges(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert con.repair(none, none).count() == 0
    one = spark.createDataFrame([(5, 1, "user", "Hm.")], none.schema)
    assert got_of(con.repair(one, none)) == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


@pytest.mark.parametrize("prime", [con._PRIME, 7])
def test_order_of_edits(monkeypatch, prime):
    """The search for the common prefix orders as strings do, also where all hashes collide."""
    monkeypatch.setattr(con, "_PRIME", prime)
    rng = random.Random(2)
    nodes = [con.Edits()]
    known = {(0, ""): nodes[0]}
    for _ in range(150):
        parent, piece = rng.choice(nodes[-20:]), rng.choice(["K", "D", "I", "R", "KK", "KI"])
        if (id(parent), piece) not in known:
            known[id(parent), piece] = con.Edits(parent, piece)
            nodes.append(known[id(parent), piece])
    for a, b in itertools.product(nodes, nodes):
        if a is not b:
            assert (a < b) == (a.pieces() < b.pieces())
