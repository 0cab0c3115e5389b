from conftest import OLD, rows
from pyspark.sql import functions as F

from stemma import model as M
from stemma.operators import analytics as A, browse as Q, resolve as E
from stemma.operators.ris import to_ris
from stemma.plans.catalog import Catalog, from_quads
from stemma.sources import exports
from stemma.sources.templates import standard_templates

B = M.BASE


def test_records(cat):
    got = {r.g: r for r in Q.records(cat).collect()}
    assert set(got) == {B + "w1/", B + "w2/", B + "w3/"}
    # A creator without label leaves the block out; title, date and stage stay.
    assert (got[B + "w1/"].user, got[B + "w1/"].modifier) == ("-", "-")
    assert got[B + "w1/"].title.startswith("Doe, J.")
    # The latest of two moments counts.
    assert got[B + "w2/"].date == "2022-03-01T10:00:00"
    assert (got[B + "w2/"].user, got[B + "w2/"].modifier) == ("u1@example.org", "u2@example.org")
    assert got[B + "w3/"].stage == M.NOT_MODIFIED


def test_records_of_incomplete_graph(spark, quads):
    from stemma.plans.catalog import from_quads
    bare = spark.createDataFrame(
        [(B + "w9", M.RDF_TYPE, M.BOOK, "uri", None, B + "w9/")], M.QUAD)
    got = rows(Q.records(from_quads(quads.unionByName(bare)), M.BOOK))
    assert (B + "w9/", "none", "-", "-", "-", "-", M.BOOK) in got


def test_unlabelled_people_give_way_to_labelled_ones(spark, quads):
    from stemma.plans.catalog import from_quads
    g = B + "w2/"
    more = spark.createDataFrame([
        (g, M.ATTRIBUTED_TO, B + "nolabel", "uri", None, g),
        (g, M.INFLUENCED_BY, B + "nolabel", "uri", None, g)], M.QUAD)
    got = Q.records(from_quads(quads.unionByName(more)), M.BOOK)
    assert rows(got, "user", "modifier") == [("u1@example.org", "u2@example.org")]


def test_pages(cat):
    first = [r.g for r in Q.records_page(cat, 1, size=2).collect()]
    second = [r.g for r in Q.records_page(cat, 2, size=2).collect()]
    assert first == [B + "w2/", B + "w3/"] and second == [B + "w1/"]
    assert [r.g for r in Q.records_page(cat, 1, M.PUBLISHED).collect()] == [B + "w1/"]


def test_counts(spark, cat):
    assert rows(Q.stage_counts(cat)) == [(3, 1, 1, 1)]
    assert rows(Q.count_records(cat)) == [(3,)]
    assert rows(Q.count_records(cat, M.ARTICLE, [M.PUBLISHED])) == [(1,)]
    got = {r["class"]: (r.n_records, r.n_published, r.n_listed, r.n_filters)
           for r in Q.explore(cat, standard_templates(spark)).collect()}
    assert got == {M.ARTICLE: (2, 1, 1, 6), M.BOOK: (1, 0, 1, 6)}


def test_class_of(spark, cat):
    uris = spark.createDataFrame([(B + "w1",), (B + "a1",)], "uri string")
    assert rows(Q.class_of(cat, uris)) == [(B + "a1", ""), (B + "w1", M.ARTICLE)]


def test_record_fields_and_view(spark, cat):
    fields = standard_templates(spark)
    got = rows(Q.record_fields(cat, fields).filter(f"g = '{B}w2/'"), "field_id", "value", "label")
    by_label = {r[0]: r[2] for r in M.standard_fields()} | {}
    assert ("book-01", "alpha roads", None) in got
    assert any(v == "Q42" and l == "Adams, D." for _, v, l in got)
    authors = [l for f, v, l in rows(Q.record_fields(cat, fields).filter(f"g = '{B}w1/'"),
                                     "field_id", "value", "label") if v == B + "a1"]
    assert sorted(authors) == ["Doe, J.", "Doe, John"] and by_label
    view = Q.record_view(cat, fields).filter(f"g = '{B}w3/'").collect()
    assert {(r.title, r.class_name, r.is_draft) for r in view} == {
        ("No author (). Draft.", "Journal article", True)}


def test_record_fields_of_several_works_in_a_graph(spark, quads):
    """Each work of a graph has the fields of its own templates; a row that two of them tell comes once."""
    g = M.BASE + "w1/"
    more = [(M.BASE + "w1", M.RDF_TYPE, M.BOOK, "uri", None, g), (M.BASE + "part", M.RDF_TYPE, M.REPORT, "uri", None, g),
            (M.BASE + "w1", M.ISBN, "978", "literal", None, g)]
    both = from_quads(quads.unionByName(spark.createDataFrame(more, M.QUAD)))
    twice = Catalog(both.types, both.links.unionByName(both.links), both.literals.unionByName(both.literals.withColumn(
        "work", F.lit(M.BASE + "part"))), both.labels.unionByName(both.labels), both.state)
    fields = standard_templates(spark)
    got = rows(Q.record_fields(twice, fields).filter(F.col("g") == g), "template", "field_id", "value", "label")
    assert len(got) == len(set(got))
    told = {(t, v) for t, _, v, _ in got}
    assert {t for t, v in told if v == "Zebra crossing"} == {"article", "book", "report"}
    assert {t for t, v in told if v == "978"} == {"book", "report"}
    assert {t for t, v in told if v == M.BASE + "j1"} == {"article"}
    view = rows(Q.record_view(twice, fields).filter(F.col("g") == g), "class_name", "title")
    assert set(view) == {("Book", "Doe, J. (2020). Zebra crossing.")}


def test_describe_and_usage(spark, quads):
    names = spark.createDataFrame([("a2",), ("roads",), ("nothing",)], "name string")
    got = rows(Q.describe(quads, names), "name", "s", "p", "o")
    assert ("a2", B + "w1", M.AUTHOR_PROPS[1], B + "a2") in got
    assert ("a2", B + "a2", M.RDFS_LABEL, "Roe, R.") in got
    # A vocabulary term is found by its last segment.
    assert ("roads", B + "w1", M.PRIMARY_SUBJECT, M.VOCAB + "roads") in got
    assert not [r for r in got if r[0] == "nothing"]
    assert rows(Q.term_usage(quads, names)) == [("a2", 2, 2), ("roads", 1, 1)]


def test_back_links(spark, cat):
    uris = spark.createDataFrame([(B + "a2",), (B + "j1",)], "uri string")
    assert rows(Q.back_links(cat, uris)) == [
        (B + "a2", 1, B + "w1", "Zebra crossing"), (B + "a2", 2, B + "w2", "alpha roads"),
        (B + "j1", 1, B + "w1", "Zebra crossing"), (B + "j1", 2, B + "w3", "Draft")]
    assert rows(Q.back_links(cat, uris, offset=1, limit=1), "uri", "rank") == [
        (B + "a2", 2), (B + "j1", 2)]


def test_facets(cat):
    got = {(r.value, r.property): r for r in Q.facet_counts(cat, ["author", "container"]).collect()}
    # Unmodified records stay out; two labels of one person count once.
    assert got[B + "j1", M.PART_OF].n_subjects == 1
    doe = got[B + "a1", M.AUTHOR_PROPS[0]]
    assert (doe.label, doe.n_subjects, doe.n_rows) == ("Doe, J.", 1, 2)
    assert rows(Q.records_by_facet(cat, "container"), "work") == [(B + "w1",)]


def test_alpha_index(cat):
    assert rows(Q.alpha_index(cat), "letter", "n_records") == [("D", 1), ("R", 1)]


def test_data_profile(cat):
    got = {(r["class"], r.property): r for r in Q.data_profile(cat).collect()}
    assert got[M.ARTICLE, M.PART_OF].n_works == 2 and got[M.ARTICLE, M.PART_OF].n_values == 1
    assert got[M.ARTICLE, M.URL].fill_rate == 0.5
    assert got[M.ARTICLE, M.PRIMARY_SUBJECT].property_name == "has Primary Subject Term"


def test_entities(cat):
    assert rows(E.people(cat)) == [
        (M.WIKIDATA + "Q42", "Adams, D."), (B + "a1", "Doe, J."), (B + "a1", "Doe, John"),
        (B + "a2", "Roe, R.")]
    assert rows(E.journals(cat)) == [(B + "j1", "Road Journal")]
    assert rows(E.books(cat)) == []
    assert len(rows(E.entities(cat))) == 6


def test_counters_and_series(cat):
    assert rows(A.counters(cat)) == [(2, 3, 2, 1, 1, 2)]
    # One year under two bases: two rows by URI, one by label.
    assert rows(A.authors_per_year(cat), "year", "year_uri", "count") == [
        ("2020", M.VOCAB + "2020", 2), ("2020", OLD + "vocabularies/2020", 1)]
    assert rows(A.authors_per_year(cat, by="label")) == [("2020", 2)]
    assert rows(A.publications_per_year(cat, by="label")) == [("2020", 2)]
    assert rows(A.language_by_year(cat)) == [("2020", "english", 2)]
    got = A.language_chart(cat, ["italian"]).collect()
    assert [(r.year, r.italian, r.other) for r in got] == [("2020", None, 2)]


def test_export(cat):
    got = {r.article_id: r for r in A.export_wide(cat).collect()}
    assert len(got) == 3
    one = got[B + "w1"]
    assert (one.author1, one.link, one.topic, one.language) == (
        "Doe, J.", "https://example.org/a", "Animals; Roads", "english")
    assert (one.type, one.volume, one.doi, one.editor1) == ("JournalArticle", "7", "-", "-")
    assert got[B + "w3"].year == "-" and got[B + "w3"].topic == ""


def test_ris(cat):
    got = dict(rows(to_ris(cat, "My base")))
    assert got[B + "w1"] == "\n".join([
        "TY - JOUR", "AU - Doe, J.", "AU - Roe, R.", "PY - 2020", "TI - Zebra crossing",
        "JO - Road Journal", "VL - 7", "LA - English", "L2 - https://example.org/a",
        "DP - My base", "ER  - "])
    assert "PB - Press" in got[B + "w2"]


def test_files(cat, tmp_path, spark):
    exports.write_csv_export(cat, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"')
    assert back.columns == A.EXPORT_COLUMNS and back.count() == 3
    exports.write_ris(cat, str(tmp_path / "ris"))
    assert spark.read.text(str(tmp_path / "ris")).filter("value = 'ER  - '").count() == 3
    exports.write_citations(A.export_wide(cat), str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).count() == 6
    exports.write_chart_json(A.publications_per_year(cat, by="label"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["count"] == 2


def test_labels_hold_in_the_graph_that_states_them(spark, quads):
    from stemma.plans.catalog import from_quads
    g, w, k = B + "w1/", B + "w1", B + "k1"
    more = spark.createDataFrame([
        (w, M.KEYWORDS, k, "uri", None, g), (k, M.RDFS_LABEL, "Streets", "literal", None, g),
        (B + "w2", M.KEYWORDS, k, "uri", None, B + "w2/"),
        (k, M.RDFS_LABEL, "streets", "literal", None, B + "w2/"),
        (k, M.RDFS_LABEL, "elsewhere", "literal", None, B + "w3/"),
        (k, M.RDFS_LABEL, "in the vocabulary", "literal", None, M.VOCAB_GRAPH)], M.QUAD)
    named = from_quads(quads.unionByName(more))
    words = Q.record_fields(named, standard_templates(spark)).filter("field_id = 'keywords'")
    assert rows(words, "g", "value", "label") == [(g, k, "Streets"), (B + "w2/", k, "streets")]
    shown = Q.record_view(named, standard_templates(spark)).filter("field = 'Keywords'")
    assert rows(shown, "g", "label") == [(g, "Streets"), (B + "w2/", "streets")]
    assert rows(Q.facet_counts(named, ["keyword"]), "value", "n_subjects", "n_rows") == [(k, 2, 2)]


def test_quads_come_back(cat, quads):
    # Own literals lose their datatype; which graph states what stays.
    kept = ("s", "p", "o", "o_kind", "g")
    assert rows(cat.quads().distinct(), *kept) == rows(quads.distinct(), *kept)


def test_untyped_graphs_count(spark, quads):
    from stemma.plans.catalog import from_quads
    g = B + "w8/"
    bare = spark.createDataFrame([(g, M.STATUS, M.MODIFIED, "literal", None, g)], M.QUAD)
    more = from_quads(quads.unionByName(bare))
    assert rows(Q.stage_counts(more)) == [(4, 1, 2, 1)]
    assert rows(Q.stage_counts(more, M.ARTICLE)) == [(2, 1, 0, 1)]
    assert rows(Q.count_records(more)) == [(4,)]
    assert rows(Q.count_records(more, M.ARTICLE)) == [(2,)]


def test_pages_join_the_listing(cat):
    whole = Q.records(cat).orderBy("g").collect()
    parts = [r for n in (1, 2, 3, 4) for r in Q.records_page(cat, n, size=1).collect()]
    assert sorted(parts) == sorted(whole)
