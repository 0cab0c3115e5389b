from stemma import model as M
from stemma.functions import terms, text as X


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").selectExpr(f"{fn('x')} as y", "i").orderBy("i").collect()]


def test_cell(spark):
    assert apply(spark, X.cell, [" a ", "", "  ", "nan", "NaN", None, "a\n"]) == [
        "a", None, None, None, None, None, "a"]


def test_norm_year(spark):
    got = apply(spark, X.norm_year, ["2016.0", "(2016)", " 2016 ", None, "n.d.", "2016.9", "7"])
    assert got == ["2016", "2016", "2016", None, None, "2016", None]


def test_norm_doi(spark):
    values = ["https://doi.org/10.1/A", "http://dx.doi.org/10.1/A", "doi: 10.1/A", "DOI:10.1/A",
              "http://doi.org/10.1/A", "https://dx.doi.org/10.1/A", "not found", "x", None]
    assert apply(spark, X.norm_doi, values) == ["10.1/a"] * 6 + [None] * 3
    strict = apply(spark, lambda x: X.norm_doi(x, True), values)
    assert strict[:4] == ["10.1/a"] * 4
    assert strict[4:6] == ["http://.org/10.1/a", "https://dx..org/10.1/a"]


def test_norm_link_title_number(spark):
    assert apply(spark, X.norm_link, [" http://a ", "Not Found", "-", None]) == [
        "http://a", None, None, None]
    assert apply(spark, X.norm_title, [' A "b" ', "x", None]) == ["A b", None, None]
    assert apply(spark, X.norm_number, ["(12)", "7", None]) == ["12", "7", None]
    assert apply(spark, lambda x: X.norm_number(x, True), ["(12)", "7"]) == ["12", None]


def test_split_themes(spark):
    informal = "Informal education including youth work, media & community work"
    values = ["['a', 'b']", "ab", f"['Formal education', '{informal}']", "[]", None]
    got = apply(spark, X.split_themes, values)
    assert got == [["a", "b"], ["ab"], ["Formal education", informal], None, None]
    strict = apply(spark, lambda x: X.split_themes(x, True), [informal])
    assert strict == [["Informal education including youth work", "media & community work"]]


def test_repair_label(spark):
    assert apply(spark, X.repair_label, ["A; ; ; (2020)", "A; ; ; B", "A; B"]) == [
        "A (2020)", "A B", "A; B"]


def test_names_and_ids(spark):
    assert apply(spark, X.readable_name, [M.CHAPTER, "http://x/a#partOf", "http://x/hasURLValue"]
                 ) == ["Book Chapter", "part Of", "has URL Value"]
    assert apply(spark, X.to_id, ["Main Theme"]) == ["main_theme"]
    assert apply(spark, X.is_number, ["12", "1a", ""]) == [True, False, False]
    assert apply(spark, X.encode_user, ["a.b@c.d"]) == ["a-dot-b-at-c-dot-d"]
    assert apply(spark, lambda x: X.decode_user(X.encode_user(x)), ["a.b@c.d"]) == ["a.b@c.d"]
    assert apply(spark, X.tokens, ["Éa-b  12, ß", "--"]) == [["éa", "b", "12", "ß"], []]
    assert apply(spark, X.name_key, ["Lima, M.J.M", "Lima, M.J.M."]) == ["limamjm"] * 2
    got = apply(spark, X.parse_moment, ["2022-07-28T11:57:40.881500", "-"])
    assert str(got[0]) == "2022-07-28 11:57:40" and got[1] is None


def test_terms(spark):
    V = M.VOCAB
    assert apply(spark, terms.vocab_uri, [
        "Theoretical & conceptual publications", "Higher education research",
        M.SUBJECTS[3], M.SUBJECTS[4], M.SUBJECTS[7], "Simplified Chinese"]) == [
        V + "theoretical-and-conceptual-publications", V + "higher-education-research",
        V + "informal-education-including-youth-work-media-and-community-work",
        V + "international-volunteering-study-visits-and-educational-partnerships",
        V + "teacher-education-and-training-of-trainers", V + "simplified-chinese"]
    assert apply(spark, terms.work_class, [
        "Article", "Doctoral thesis", "Book chapter", "Book", "Journal Issue", "Report",
        "Grey Literature", "poster", None, "Chapter in book"]) == [
        M.ARTICLE, M.THESIS, M.CHAPTER, M.BOOK, M.JOURNAL_ISSUE, M.REPORT, M.WORK, M.WORK, M.WORK, M.WORK]
    assert apply(spark, terms.template_of, [M.WORK, M.BOOK, "x"]) == ["report", "book", None]
    assert apply(spark, terms.uri_base, ["Q1", "123", "http://x", "abc"]) == [
        M.WIKIDATA, M.GEONAMES, "", M.BASE]
    assert apply(spark, terms.short_uri, [M.WIKIDATA + "Q1", M.GEONAMES + "1", M.BASE + "a"]) == [
        "Q1", "1", M.BASE + "a"]
    assert apply(spark, terms.display_class, [M.ARTICLE, M.CHAPTER, M.BOOK, M.WORK]) == [
        "Journal article", "Book chapter", "Book", "Document"]


def test_minted_uris_do_not_depend_on_partitions(spark):
    df = spark.range(200).selectExpr("'people' as kind", "concat('n', id) as label")
    expr = f"{terms.minted_uri('kind', 'label')} as uri"
    a = {r.uri for r in df.repartition(1).selectExpr(expr).collect()}
    b = {r.uri for r in df.repartition(7).selectExpr(expr).collect()}
    assert a == b and len(a) == 200
