import re
from itertools import product

from conftest import OLD, SF, rows
from pyspark.sql import functions as F

from stemma import model as M
from stemma.operators import search as S
from stemma.plans.skew import blocked_join
from stemma.sources import adapter

B = M.BASE


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def test_search_title(cat):
    assert rows(S.search_title(cat, "Road"), "work") == [(B + "w2",)]
    assert rows(S.search_title(cat, "crossing zeb"), "work") == [(B + "w1",)]
    assert rows(S.search_title(cat, "zeb crossing"), "work") == []
    assert rows(S.search_title(cat, "--"), "work") == []


def test_search_label(cat):
    assert rows(S.search_label(cat, "doe", ["author"])) == [
        (B + "w1", "Doe, J."), (B + "w1", "Doe, John")]
    assert rows(S.search_label(cat, "roe r", ["author"]), "work") == [(B + "w1",), (B + "w2",)]
    assert rows(S.search_label(cat, "roa", ["container"])) == []


def test_filter_checkbox(spark, cat):
    value = f"{M.VOCAB}roads,{M.VOCAB}animals,Roads, and animals"
    choices = spark.createDataFrame([(value,)], "value string")
    uris = choices.selectExpr(f"explode({S.checkbox_uris('value')}) as u")
    assert rows(uris) == [(M.VOCAB + "animals",), (M.VOCAB + "roads",)]
    assert rows(S.filter_checkbox(cat, "primary_subject", choices)) == [(B + "w1",)]


def test_advanced_search(cat):
    both = {"search_author": "roe", "search_year-1": f"{M.VOCAB}2020,2020",
            "search_year-2": f"{OLD}vocabularies/2020,2020", "search_title": ""}
    got = rows(S.advanced_search(cat, both), "worktype", "year", "workid", "doi")
    assert got == [("Book", "2020", "w2", ""), ("Journal Article", "2020", "w1", "")]
    assert len(rows(S.advanced_search(cat, {}))) == 2  # w3 has no year
    assert rows(S.advanced_search(cat, both | {"search_title": "zebra"}), "workid") == [("w1",)]


def brute(queries, labels, last_prefix):
    out = set()
    for query, (uri, label) in product(queries, labels):
        q, t = words(query), words(label)
        full = q[:-1] if last_prefix else q
        ok = q and set(full) <= set(t)
        if ok and last_prefix:
            ok = any(x.startswith(q[-1]) for x in t)
        if ok:
            hit = {x for x in t if x in q or (last_prefix and x.startswith(q[-1]))}
            out.add((query, uri, label, round(len(hit) / len(set(t)), 9)))
    return out


def test_label_search_is_exact_with_hot_tokens(spark):
    labels = [(f"u{i}", f"the road {i % 3} of n{i % 5}" + (" the" if i % 2 else "")) for i in range(60)]
    labels += [("x1", "The"), ("x2", "!!"), ("x3", "Road, the")]
    queries = ["the", "road the", "n3 the", "missing the", "of n4 2", "ro", "the n", "", "1 of ro"]
    lab = spark.createDataFrame(labels, "uri string, label string")
    ask = spark.createDataFrame([(q,) for q in queries], "query string")
    for prefix, long_texts in product((False, True), (False, True)):
        found = S.label_search(ask, lab, prefix, long_texts=long_texts, blocks=5)
        want = brute(queries, labels, prefix)
        if long_texts:
            want = {(q, u, s) for q, u, _, s in want}
        got = {(*r[:-1], round(r[-1], 9)) for r in rows(found)}
        assert got == want
        assert len(rows(found)) == len(got)


def test_blocked_join_finds_every_pair_once(spark):
    many = spark.range(1000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 50)) as k", "id as v")
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("k7", 3), ("none", 4)], "k string, w int")
    got = rows(blocked_join(many, few, "k", ["v"], 8), "k", "v", "w")
    assert got == rows(many.join(few, "k"), "k", "v", "w")


def test_suggest_and_prior(spark, cat):
    ask = spark.createDataFrame([("roe r",), ("ro",)], "query string")
    got = rows(S.suggest(cat, ask, 35, 0.5), "query", "uri")
    assert ("roe r", B + "a2") in got and ("ro", B + "w2") in got
    assert not [u for _, u in got if u.endswith("/")]
    assert rows(S.suggest(cat, ask, 10, 0.3, True), "uri") == [(B + "w2",)]
    titles = spark.createDataFrame([("ROADS alpha",), ("zeb",)], "query string")
    assert rows(S.prior_records(cat, titles), "query", "uri") == [("ROADS alpha", B + "w2")]
    assert rows(S.prior_records(cat, titles, M.ARTICLE)) == []


def test_mentions(spark):
    texts = spark.createDataFrame(
        [(1, "By John Q. Doe of the Global Centre."), (2, "john q doe, John Q Doe!"), (3, "doe")],
        "doc int, text string")
    labels = spark.createDataFrame(
        [("a", "John Q. Doe"), ("b", "Global Centre"), ("c", "one two three four five"),
         ("f", "john q doe of the global centre"),
         ("d", "Doe"), ("e", "?")], "uri string, label string")
    assert rows(S.link_mentions(texts, labels), "doc", "uri") == [
        (1, "a"), (1, "b"), (1, "d"), (1, "f"), (2, "a"), (2, "d"), (3, "d")]
    texts = texts.unionByName(spark.createDataFrame(
        [(4, "They met John Q. Doe of the Global Centre, once.")], "doc int, text string"))
    assert (4, "f") in rows(S.link_mentions(texts, labels), "doc", "uri")


def test_document_search_against_brute_force(spark):
    docs = [(str(r.doc_id), r.text) for r in adapter.table(spark, SF, "documents").collect()]
    queries = [r.text for r in adapter.table(spark, SF, "benchmark").collect()]
    ask = spark.createDataFrame([(q,) for q in queries], "query string")
    lab = spark.createDataFrame(docs, "uri string, label string")
    got = {(q, u) for q, u, *_ in rows(S.label_search(ask, lab, long_texts=True))}
    sets = [(u, set(words(t))) for u, t in docs]
    assert got == {(q, u) for q in queries for u, t in sets if set(words(q)) <= t}


def test_best_of_labels_that_very_many_share(spark):
    """Equal to ranking every pair; but a label meets the queries with its k least entities only."""
    labels = [(f"u{i:03}", "red ring") for i in range(200)] + [("u150", "a red ring"), ("u150", "red"), ("u199", "red")]
    labels += [("u150", "red"), ("u001", "red ring"), ("u000", "blue")]
    lab = spark.createDataFrame(labels, "uri string, label string")
    ask = spark.createDataFrame([(q,) for q in ("red", "red ri", "ring re", "bl", "none")], "query string")
    every = {}
    for q, u, text, score in brute(["red", "red ri", "ring re", "bl", "none"], labels, True):
        best, least = every.get((q, u), (0, "~"))
        every[q, u] = max(best, score), min(least, text)
    want = []
    for q in {q for q, _ in every}:
        found = sorted((-score, u, text) for (p, u), (score, text) in every.items() if p == q)[:4]
        want += [(q, n, u, text, -score) for n, (score, u, text) in enumerate(found, 1)]
    hits = S.label_hits(ask, lab, True)
    owners = lab.select(F.col("label").alias("id"), "uri", "label")
    got = S.best_per_query(hits, owners, 4)
    assert sorted((*r[:4], round(r[4], 9)) for r in got.collect()) == sorted(want)
    # "red ring" met 200 entities a query before.
    kept = S.least_owners(hits, owners, 4).groupBy("id").count().agg(F.max("count")).first()[0]
    assert kept == 4
