from conftest import rows

from stemma import model as M
from stemma.operators import lifecycle as L, transform as T, validate as V
from stemma.sources.templates import standard_templates

B = M.BASE
NOW = "2024-01-01T00:00:00"


def content(spark, name, title="New title"):
    g = f"{B}{name}/"
    return spark.createDataFrame([
        (B + name, M.RDF_TYPE, M.BOOK, "uri", None, g),
        (B + name, M.DCT_TITLE, title, "literal", None, g)], M.QUAD)


def of_graph(quads, name):
    return {(q.s, q.p, q.o) for q in quads.filter(f"g = '{B}{name}/'").collect()}


def test_load_is_idempotent(quads):
    assert rows(L.load_graph(quads, quads)) == rows(quads.distinct())
    moved = L.load_graph(quads, quads.limit(1), B + "other/")
    assert moved.count() == quads.distinct().count() + 1


def test_clear(spark, quads):
    graphs = spark.createDataFrame([(B + "w1/",), (B + "missing/",)], "g string")
    left = L.delete_records(quads, graphs)
    assert left.filter(f"g = '{B}w1/'").count() == 0
    assert left.count() == quads.filter(f"g <> '{B}w1/'").count()


def test_first_stage_adds_creator(spark, quads):
    got = of_graph(L.upsert_records(quads, content(spark, "w5"), M.NOT_MODIFIED, "me@x.org", NOW), "w5")
    assert (B + "w5/", M.ATTRIBUTED_TO, B + "me-at-x-dot-org") in got
    assert (B + "w5/", M.STATUS, M.NOT_MODIFIED) in got


def test_publish_keeps_creator_and_replaces_content(spark, quads):
    once = L.upsert_records(quads, content(spark, "w3"), M.PUBLISHED, "me@x.org", NOW)
    got = of_graph(once, "w3")
    assert (B + "w3/", M.ATTRIBUTED_TO, B + "u1") in got
    assert (B + "u1", M.RDFS_LABEL, "u1@example.org") in got
    assert (B + "w3/", M.INFLUENCED_BY, B + "me-at-x-dot-org") in got
    assert [o for _, p, o in got if p == M.DCT_TITLE] == ["New title"]
    assert [o for _, p, o in got if p == M.STATUS] == [M.PUBLISHED]
    twice = L.upsert_records(once, content(spark, "w3"), M.PUBLISHED, "me@x.org", NOW)
    assert rows(twice) == rows(once)
    assert of_graph(once, "w2") == of_graph(quads, "w2")


def test_creators(spark, quads):
    assert rows(L.record_creators(quads)) == [
        (B + "w2/", B + "u1", "u1@example.org"), (B + "w3/", B + "u1", "u1@example.org")]


def test_label_update_needs_both_places(spark):
    def pair(name, label, citation):
        return [(f"{B}{name}/", M.RDFS_LABEL, label, "literal", None, f"{B}{name}/"),
                (f"{B}{name}", M.REFERENCED_BY, citation, "literal", None, f"{B}{name}/")]

    broken = "A; ; ; (2020). T."
    quads = spark.createDataFrame(pair("x", broken, broken) + pair("y", broken, "Other"), M.QUAD)
    fixes = V.repair_labels(quads.filter("s = g").selectExpr("g", "o as label")).select("g", "repaired")
    got = rows(V.apply_label_update(quads, fixes), "s", "o")
    assert got == [(B + "x", "A (2020). T."), (B + "x/", "A (2020). T."), (B + "y", "Other"),
                   (B + "y/", broken)]


def submit(spark, **kw):
    row = {"record_id": "r1", "template": "article", "stage": M.NOT_MODIFIED, "user": "me@x.org"} | kw
    return spark.createDataFrame(
        [(row["record_id"], row["template"], row["stage"], row["user"], row["fields"])],
        "record_id string, template string, stage string, user string, fields map<string,string>")


def test_form(spark):
    ids = {r[3]: r[2] for r in M.standard_fields() if r[0] == "article"}
    fields = standard_templates(spark).selectExpr(
        "*", f"if(property = '{M.PUBLICATION_DATE}', map('{M.VOCAB}2020', '2020'), null) as values")
    sub = submit(spark, fields={
        ids["Citation"]: "A cited\nwork", ids["Title"]: "", ids["Publication year"]: M.VOCAB + "2020",
        f"{ids['Author 1']}-Q1": ' "Q1",Doe%2C+J ', f"{ids['Author 1']}-77": "77,Place%20X",
        f"{ids['Journal']}-h": "http://e/j,J", "keywords-1": "k,W"})
    quads = T.form_to_quads(sub, fields, generated_at=NOW)
    got = {(q.s, q.p, q.o) for q in quads.collect()}
    w = B + "r1"
    assert (w, M.REFERENCED_BY, "A citedwork") in got
    assert (w + "/", M.RDFS_LABEL, "A cited\nwork") in got and (w, M.RDFS_LABEL, "A cited\nwork") in got
    assert not [o for _, p, o in got if p == M.DCT_TITLE]
    assert (w, M.AUTHOR_PROPS[0], M.WIKIDATA + "Q1") in got
    assert (M.WIKIDATA + "Q1", M.RDFS_LABEL, "Doe,+J") in got
    assert (w, M.AUTHOR_PROPS[0], M.GEONAMES + "77") in got
    assert (w, M.PART_OF, "http://e/j") in got
    assert (w, M.PUBLICATION_DATE, M.VOCAB + "2020") in got
    assert not [o for _, p, o in got if p == M.KEYWORDS]
    assert (w + "/", M.ATTRIBUTED_TO, B + "me-at-x-dot-org") in got


def test_form_text_areas_and_untitled(spark):
    fields = spark.createDataFrame([
        ("t", "urn:C", "f-1", "Text", "urn:text", "Textarea", "Literal", False, False, 1, None)],
        M.TEMPLATE_FIELD)
    sub = submit(spark, template="t", stage=M.MODIFIED, fields={
        "f-1": "about Rome", "f-1-Q220": "Q220,Rome", "keywords-k": "k1,Word"})
    creators = spark.createDataFrame([(B + "r1/", B + "c", "c@x")],
                                     "g string, creator string, creator_label string")
    got = {(q.s, q.p, q.o) for q in T.form_to_quads(sub, fields, creators, NOW).collect()}
    w = B + "r1"
    assert (w, "urn:text", "about Rome") in got
    assert (w, M.KEYWORDS, M.WIKIDATA + "Q220") in got and (w, M.KEYWORDS, B + "k1") in got
    assert (w + "/", M.RDFS_LABEL, "no title") in got
    assert (w + "/", M.ATTRIBUTED_TO, B + "c") in got
    assert (w + "/", M.INFLUENCED_BY, B + "me-at-x-dot-org") in got
