import json

from conftest import rows
from pyspark.sql import functions as F

from stemma import model as M
from stemma.operators.browse import browse_filters
from stemma.sources import nquads, templates

B = M.BASE
ODD = 'a "quoted" \\n back\\slash\nnew line\ttab é مجلة'


def test_nquads_round_trip(spark, quads, tmp_path):
    odd = spark.createDataFrame([
        (B + "x", "urn:p", ODD, "literal", None, B + "x/"),
        (B + "x", "urn:p", ODD, "literal", M.XSD_STRING, B + "x/")], M.QUAD)
    everything = quads.unionByName(odd)
    nquads.write_nquads(everything, str(tmp_path / "dump"))
    assert rows(nquads.read_nquads(spark, str(tmp_path / "dump"))) == rows(everything)


def test_other_lines_are_left_out(spark):
    lines = spark.createDataFrame([("# comment",), ("<a> <b> <c> <d> .",), ("<a> <b> 'c' .",)],
                                  "value string")
    assert rows(nquads.parse_nquads(lines)) == [("a", "b", "c", "uri", None, "d")]
    assert rows(nquads.rejected_lines(lines)) == [("<a> <b> 'c' .",)]


def test_terms_of_real_exports(spark):
    long = 'x' * 50_000 + '\\n\\"' * 5_000
    lines = spark.createDataFrame([
        ('<a> <b> "c"@en <d> . # note',), ('_:x <b> _:y.1 <d> .',), ('<a> <b> "c"^^<t> .',),
        ('<a><b>"\\u00e9\\uD83D\\uDE00 \\U0001F600 \\\\u0041"<d>.',),
        (f'<l> <b> "{long}" <d> .',)], "value string")
    got = rows(nquads.parse_nquads(lines))
    assert [r for r in got if r[0] != "l"] == sorted([
        ("_:x", "b", "_:y.1", "uri", None, "d"), ("a", "b", "c", "literal", "@en", "d"),
        ("a", "b", "c", "literal", "t", None),
        ("a", "b", "é\U0001F600 \U0001F600 \\u0041", "literal", None, "d")],
        key=lambda r: tuple((v is None, str(v)) for v in r))
    assert [r[2] for r in got if r[0] == "l"] == ["x" * 50_000 + '\n"' * 5_000]
    assert rows(nquads.rejected_lines(lines)) == []
    again = nquads.parse_nquads(nquads.nquads_lines(nquads.parse_nquads(lines).filter("g is not null")))
    assert rows(again) == [r for r in got if r[5]]


def test_read_records_names_graph_by_file(spark, tmp_path):
    (tmp_path / "12-3.nq").write_text('<urn:s> <urn:p> "v" <urn:old> .\n')
    got = rows(nquads.read_records(spark, str(tmp_path)))
    assert got == [("urn:s", "urn:p", "v", "literal", None, B + "12-3/")]


def test_templates_and_vocabularies(spark, tmp_path):
    fields = [
        {"id": "1", "label": "Title", "type": "Textbox", "value": "Literal", "property": "urn:t",
         "browse": "False", "disambiguate": "True", "class": "col-md-10"},
        {"id": "2", "label": "Year", "type": "Dropdown", "value": "URI", "property": "urn:y",
         "browse": "True", "disambiguate": "False", "values": {B + "v/2020": "2020"}},
        {"id": "3", "label": "Note", "type": "Textarea", "value": "Literal", "property": "urn:n",
         "disambiguate": "False"}]
    (tmp_path / "template-note.json").write_text(json.dumps(fields))
    listed = [{"name": "Note", "short_name": "note", "type": "urn:Note",
               "template": "some/folder/template-note.json"},
              {"name": "Gone", "short_name": "gone", "type": "urn:G", "template": "x.json",
               "status": "deleted"}]
    (tmp_path / "list.json").write_text(json.dumps(listed))
    got = templates.read_templates(spark, str(tmp_path / "list.json"), str(tmp_path / "template-*.json"))
    assert rows(got, "template", "field_id", "browse", "disambiguate", "position") == [
        ("note", "1", False, True, 1), ("note", "2", True, False, 2), ("note", "3", False, False, 3)]
    assert rows(browse_filters(got), "property") == [("urn:t",), ("urn:y",)]
    assert rows(templates.vocabulary_quads(got)) == [
        (B + "v/2020", M.RDFS_LABEL, "2020", "literal", None, M.VOCAB_GRAPH)]


def test_standard_templates(spark):
    got = {r.template: r["count"] for r in
           templates.standard_templates(spark).groupBy("template").count().collect()}
    assert got == {"article": 23, "book": 33, "book_chapter": 34, "doctoral_thesis": 11,
                   "journal_issue": 11, "report": 22}


def test_noncharacters_in_literals_come_back(spark, tmp_path):
    from stemma.sources import nquads
    texts = ["a﷐b", "﷑", "x﷒y﷒", "\\ufdd0", "\\\\uFDD1 \\", 'quote " and ﷑"', "﷒0 ﷒1", "plain"]
    quads = spark.createDataFrame([(f"urn:{i}", "urn:p", t, "literal", None, "urn:g﷐/") for i, t in enumerate(texts)],
                                  "s string, p string, o string, o_kind string, o_type string, g string")
    nquads.write_nquads(quads, str(tmp_path / "dump"))
    got = sorted((r.s, r.o, r.g) for r in nquads.read_nquads(spark, str(tmp_path / "dump")).collect())
    assert got == [(f"urn:{i}", t, "urn:g﷐/") for i, t in enumerate(texts)]
    lines = spark.createDataFrame([('<urn:s> <urn:p> "\\uFDD1 \\ufdd2 \\u0041" <urn:g> .',)], "value string")
    assert nquads.parse_nquads(lines).first().o == "﷑ ﷒ A"


def test_dump_is_compressed_and_small_files(spark, quads, tmp_path, monkeypatch):
    monkeypatch.setattr(nquads, "LINES_PER_FILE", 5)
    nquads.write_nquads(quads.coalesce(1), str(tmp_path / "dump"))
    parts = sorted((tmp_path / "dump").glob("part-*"))
    assert len(parts) == -(-quads.count() // 5) and all(p.name.endswith(".gz") for p in parts)
    assert rows(nquads.read_nquads(spark, str(tmp_path / "dump"))) == rows(quads)


def test_names_of_compressed_records(spark, tmp_path):
    import gzip
    (tmp_path / "r1.nq.gz").write_bytes(gzip.compress(b'<urn:s> <urn:p> "o" .\n'))
    (tmp_path / "r2.nq").write_text('<urn:s> <urn:p> "o" .\n')
    assert {r.g for r in nquads.read_records(spark, str(tmp_path)).collect()} == {M.BASE + "r1/", M.BASE + "r2/"}


def test_plain_lines_are_cut_and_not_matched(spark):
    told = ['<a> <b> <c> <d> .', '<a> <b> "c" <d> .', '<a> <b> ""^^<t> <d> .', '<a> <b> "c"@en <d> .', '<a> <b> <c> .',
            '<a> <b> "c"^^<t> .', '<a> <b> "x > y" <d> .', '<a> <b> "x"y" <d> .', '<a> <b> "< z > <y" <d> .', '_:a <b> _:c <d> .',
            '<a b> <"> <c <> <d﷐> .', '<a> <b> "﷑﷒" <d> .', '<a> <b> "c\\n\\u0041" <d> .', '<\\u0041> <b> <c> <d> .',
            '<a> <b> "c" <d> . # x', '<a> <b>  <c> <d> .', '<a> <b> "c" <d>', '<a> <b> "c" "d" <e> .', '<a> <b> "c"^^<t> "d" .',
            '<a> <b> <c> <d> <e> .', '<> <> <> <> .', '> <b> <c> <d> .', '<a> x<b> <c> <d> .', '<a> <b> x"c" <d> .',
            '<a> <b> "c"^^<t> x<d> .', '<a> <b> "c"^^ <d> .', '> > > > .', '>>>>', '', ' .', '<a> <b> " <c> <d> .']
    lines = spark.createDataFrame([(i, line) for i, line in enumerate(told)] + [(99, None)], "i int, value string")
    got = nquads.parse_nquads(lines, keep=["i"])
    # A blank at the end says nothing, but such a line is matched as a whole.
    want = nquads.parse_nquads(lines.selectExpr("i", "value || ' ' as value"), keep=["i"])
    assert rows(got) == rows(want) and got.count() == 16
    named = lines.withColumn("graph", F.lit("urn:g"))
    assert rows(nquads.parse_nquads(named, "graph", ["i"])) == rows(want.withColumn("g", F.lit("urn:g")).select(*got.columns))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(replace(") == 1 and "CASE WHEN isnull(plain" in plan
