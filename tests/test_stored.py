import random
from pathlib import Path

from conftest import rows
from pyspark.sql import functions as F

from stemma import model as M
from stemma.operators import browse, search
from stemma.sources import pages, postings

B = M.BASE


def asked(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "query string")


# ---- postings --------------------------------------------------------------

def test_index_answers_as_the_labels_do(spark, cat, tmp_path):
    labels = postings.catalog_labels(cat)
    index = postings.build(labels.filter("kind <> 'person'"), str(tmp_path / "i"), 4)
    before = {p for p in Path(tmp_path, "i").rglob("*.parquet")}
    index.add(labels.filter("kind = 'person'"), 1)
    assert before < {p for p in Path(tmp_path, "i").rglob("*.parquet")}       # nothing is built again
    typed = asked(spark, "Ro", "road j", "zebra cr", "doe", "r", "no such", "...", "Doe, J")
    assert rows(postings.suggest(index, typed, 35, 0.0)) == rows(search.suggest(cat, typed, 35, 0.0))
    works = cat.types.select("work")
    assert rows(postings.suggest(index, typed, 3, 0.3, works)) == rows(search.suggest(cat, typed, 3, 0.3, True))
    assert rows(postings.prior_records(index, typed, cat.types)) == rows(search.prior_records(cat, typed))
    assert rows(postings.search_title(index, "alpha ro")) == rows(search.search_title(cat, "alpha ro"))
    assert rows(postings.search_label(index, cat, "roe r", ["author"])) == rows(search.search_label(cat, "roe r", ["author"]))
    # A batch written again after a failure changes nothing.
    index.add(labels.filter("kind = 'person'"), 1)
    assert rows(postings.suggest(index, typed, 35, 0.0)) == rows(search.suggest(cat, typed, 35, 0.0))


def test_index_reads_buckets_and_intervals_only(spark, tmp_path):
    words = [f"{a}{b}{k}" for a in "abcdefgh" for b in "xyz" for k in range(40)]
    labels = spark.createDataFrame([(f"urn:{w}", w, "k") for w in words], "uri string, label string, kind string")
    index = postings.build(labels, str(tmp_path / "i"), 8)
    plan = index.search(asked(spark, "ax1"), True)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(token), GreaterThanOrEqual(token,ax1)" in plan
    assert "InMemoryFileIndex" in plan and str(tmp_path / "i") in plan
    terms = index.terms(asked(spark, "ax1").select(F.col("query").alias("token")), True)
    assert {r.token for r in terms.collect()} == {w for w in words if w.startswith("ax1")}
    one = index._of("postings", "token", spark.createDataFrame([("ax1",)], "token string"))
    assert len({r.bucket for r in one.collect()}) == 1 and "PartitionFilters: [isnotnull(bucket" in (
        one._jdf.queryExecution().toString())


def test_a_word_of_a_megabyte_costs_no_square(spark, tmp_path):
    long = "w" * 1_000_000
    labels = spark.createDataFrame([("urn:long", long, "k"), ("urn:w", "wide road", "k")],
                                   "uri string, label string, kind string")
    index = postings.build(labels, str(tmp_path / "i"), 2)
    typed = asked(spark, "w", "wi", "www")
    for got in (index.search(typed, True), search.label_search(typed, labels, True)):
        assert rows(got, "query", "uri") == [("w", "urn:long"), ("w", "urn:w"), ("wi", "urn:w"), ("www", "urn:long")]


def test_owners_stay_where_they_are_and_a_text_is_indexed_once(spark, tmp_path):
    labels = spark.createDataFrame([("urn:a", "old road", "k"), ("urn:a", "old road", "k"), ("urn:b", "old road", "k"),
                                    ("urn:c", "new road", "k")], "uri string, label string, kind string").repartition(3)
    index = postings.build(labels, str(tmp_path / "i"), 2)
    assert not [*Path(tmp_path, "i", "owners").rglob("bucket=*")]
    assert index._table("postings").filter("token = 'old'").count() == 1
    index.add(labels.filter("uri = 'urn:a'"), 1)
    asked_for = asked(spark, "old road", "road", "roa")
    assert rows(index.search(asked_for), "query", "uri", "label", "score") == [
        ("old road", "urn:a", "old road", 1.0), ("old road", "urn:b", "old road", 1.0),
        ("road", "urn:a", "old road", 0.5), ("road", "urn:b", "old road", 0.5), ("road", "urn:c", "new road", 0.5)]
    # Long labels are not read where nobody asks for them.
    short = index.search(asked_for).select("query", "uri", "score")
    assert short.count() == 5 and "label:string" not in short._jdf.queryExecution().toString()


# ---- pages -----------------------------------------------------------------

def test_pages_of_records(spark, cat, tmp_path):
    table = pages.build_records(cat, str(tmp_path / "p"), 3)
    for stage in (None, M.PUBLISHED, M.MODIFIED):
        for number in (1, 2, 3):
            got = table.page(number, 1, listing=stage or "all").drop("listing").collect()
            assert got == browse.records_page(cat, number, stage, 1).collect()
    assert table.page(9, 40, listing="all").count() == 0 and table.page(1, 40, listing="none").count() == 0


def test_first_and_late_pages_read_the_same_number_of_files(spark, tmp_path):
    data = spark.range(5000).selectExpr("'g' as listing", "id", "hash(id) as k").repartition(7)
    table = pages.build(data, ["listing"], [F.col("k").desc(), F.col("id")], str(tmp_path / "p"), 25)
    want = sorted(((r.k, r.id) for r in data.collect()), key=lambda r: (-r[0], r[1]))
    read = []
    for number in (1, 60, 125):
        page = table.page(number, 40, listing="g")
        assert [(r.k, r.id) for r in page.collect()] == want[40 * (number - 1):40 * number]
        read.append(len({f for f in page.inputFiles()}))
    assert max(read) <= 2


def test_pages_of_back_links(spark, cat, tmp_path):
    table = pages.build_back_links(cat, str(tmp_path / "p"), 4)
    uris = cat.links.select(F.col("target").alias("uri")).distinct()
    for offset, size in ((0, 10), (1, 1), (0, 1), (5, 2)):
        got = table.pages(uris, offset, size).select("uri", "rank", "subject", "label")
        assert rows(got) == rows(browse.back_links(cat, uris, offset, size))


# ---- mentions --------------------------------------------------------------

def test_mentions_against_every_run_of_words(spark):
    rng = random.Random(5)
    words = ["the", "of", "rome", "art", "new", "york", "road", "ä"]
    texts = [(i % 40, " ".join(rng.choices(words, weights=[9, 6, 2, 2, 2, 2, 1, 1], k=rng.randint(0, 30)))) for i in range(60)]
    texts += [(99, None), (100, ""), (101, "The, THE! the-Rome")]
    labels = [(f"urn:{i}", " ".join(rng.choices(words, k=rng.choice([1, 1, 2, 3, 6])))) for i in range(40)]
    labels += [("urn:a", "the the"), ("urn:b", "THE the"), ("urn:c", "absent"), ("urn:d", "the absent"), ("urn:e", "..."),
               ("urn:f", None)]
    want = set()
    for doc, text in texts:
        run = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        for uri, label in labels:
            w = (label or "").lower().split() if label != "..." else []
            if w and any(run[i:i + len(w)] == w for i in range(len(run))):
                want.add((doc, uri, label))
    got = search.link_mentions(spark.createDataFrame(texts, "doc long, text string").repartition(4),
                               spark.createDataFrame(labels, "uri string, label string"), blocks=3)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
