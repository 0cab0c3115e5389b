import pytest
from conftest import rows

from stemma import model as M
from stemma.operators import resolve as E, transform as T, validate as V
from stemma.plans.catalog import from_quads
from stemma.sources.batch import read_authority, read_batch, tidy_headers

COLUMNS = ["id", *M.BATCH_COLUMNS]


def batch_of(spark, *records):
    schema = ", ".join(f"`{c}` string" for c in COLUMNS)
    return spark.createDataFrame(
        [tuple(r.get(c) for c in COLUMNS) for r in records], schema)


ARTICLE = {"id": "1", "publication type": "Article", "title": ' On "roads" ', "author_1": " Doe, J. ",
           "author_2": "Roe, R.", "journal": "Road Journal", "volume": "12", "issue": "3",
           "pages": "(1-9)", "year": "2016.0", "lang": "English", "doi": "doi:10.1/X",
           "main_theme": "['Formal education', 'Higher education research']", "link": "Not found"}
RECORDS = [
    ARTICLE,
    {"id": "2", "publication type": "Article", "title": "Issue only", "author_1": "Doe, J.",
     "journal": "J", "issue": "4", "year": "(2017)"},
    {"id": "3", "publication type": "Article", "title": "Many",
     **{f"author_{k}": f"A{k}" for k in range(1, 7)}, "year": "2018", "volume": "7"},
    {"id": "4", "publication type": "Book", "title": "Edited", "editor_1": "E1", "editor_2": "E2",
     "publisher": "Press", "year": "2019"},
    {"id": "5", "publication type": "Book chapter", "title": "Part", "author_1": "Doe, J.",
     "booktitle": "Whole", "publisher": "Press", "pages": "5", "year": "2019"},
    {"id": "6", "publication type": "Journal Issue", "title": "Special", "author_1": "Ignored",
     "journal": "J", "year": "2020"},
    {"id": "7", "publication type": "Report", "title": "Plain", "year": "n.d.", "author_1": "  "},
    {"id": "8", "publication type": "Report", "title": None},
]


@pytest.fixture(scope="module")
def batch(spark):
    return batch_of(spark, *RECORDS).cache()


@pytest.fixture(scope="module")
def result(spark, batch):
    known = spark.createDataFrame(
        [("people", "urn:doe2", "Doe, J."), ("people", "urn:doe1", "Doe, J."),
         ("books", "urn:j", "J")], "kind string, uri string, label string")
    matches = E.match_entities(E.batch_names(batch), known).cache()
    quads = T.rows_to_quads(batch, matches, "me@example.org", "2024-01-01T00:00:00", "id")
    return matches, [tuple(r) for r in quads.collect()]


def test_citations(batch):
    got = dict(rows(T.clean_rows(batch, "id"), "work", "citation"))
    got = {k.rsplit("/", 1)[-1]: v for k, v in got.items()}
    assert got == {
        "1": "Doe, J.; Roe, R. (2016). On roads. Road Journal, 12(3), 1-9",
        "2": "Doe, J. (2017). Issue only. J, 4",
        "3": "A1; A2; A3; A4; A5; A6 (2018). Many., 7",
        "4": "E1; E2 (eds) (2019). Edited. In E1; E2 (eds),  Press",
        "5": "Doe, J. (2019). Part.Whole. Press, 5",
        "6": "Ignored (2020). Special. J",
        "7": "No author (). Plain.",
    }


def test_matches(result):
    matches, _ = result
    got = {(r.kind, r.label): (r.uri, r.status) for r in matches.collect()}
    assert got["people", "Doe, J."] == ("urn:doe1", "MATCH")
    assert got["journals", "J"] == (None, "NEW")
    assert ("people", "") not in got


def test_quads(result):
    _, quads = result
    assert len(quads) == len(set(quads))

    def objects(i, p):
        return sorted(q[2] for q in quads if q[0] == M.BASE + i and q[1] == p)

    assert objects("1", M.AUTHOR_PROPS[0]) == ["urn:doe1"]
    assert objects("1", M.PRIMARY_SUBJECT) == [
        M.VOCAB + "formal-education", M.VOCAB + "higher-education-research"]
    assert objects("1", M.URL) == [] and objects("1", M.DOI) == ["10.1/x"]
    assert objects("3", M.OTHER_AUTHORS) == [M.ET_AL] and objects("3", M.VOLUME) == ["7"]
    assert objects("4", M.EDITOR_PROPS[1]) != [] and objects("4", M.AUTHOR_PROPS[0]) == []
    assert objects("5", M.EDITOR_PROPS[0]) == [] and objects("5", M.PART_OF) != []
    assert objects("6", M.AUTHOR_PROPS[0]) == [] and objects("6", M.DCT_PUBLISHER) == []
    assert objects("7", M.PUBLICATION_DATE) == []
    assert objects("8", M.RDF_TYPE) == []
    language = [q for q in quads if q[0] == M.VOCAB + "english"]
    assert [q[2] for q in language] == ["english"]
    assert (M.BASE + "1/", M.STATUS, "published", "literal", None, M.BASE + "1/") in quads


def test_rows_without_id_keep_their_uri(batch):
    a = rows(T.clean_rows(batch.drop("id")), "work")
    b = rows(T.clean_rows(batch.drop("id").repartition(3)), "work")
    assert a == b and len(set(a)) == 7


def test_strict_single_character_volume(batch):
    strict = T.clean_rows(batch, "id", strict_reference=True)
    assert dict(rows(strict, "work", "volume"))[M.BASE + "3"] is None


def test_batch_round_trip_finds_existing(spark, batch, result):
    quads = spark.createDataFrame(result[1], M.QUAD)
    left = V.drop_existing(batch, V.duplicate_keys(from_quads(quads)))
    assert {r.id for r in left.collect()} == {"4", "6", "7", "8"}


def test_check_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "Title int, author_11 int, `Unnamed: 3` int, Year int")
    assert rows(V.check_columns(df), "column") == [("author_11",)]


def test_check_vocabulary(spark):
    df = spark.createDataFrame(
        [("formal education",), ("Formal Education",), ("Non-formal education",), (" ",), (None,),
         ("other",), ("other",)], "main_theme string")
    vocab = V.vocabulary(df, M.SUBJECTS)
    got = rows(V.check_vocabulary(df, "main_theme", vocab, lower=True))
    assert got == [("main_theme", "other", 2)]
    dashed = V.check_vocabulary(df, "main_theme", vocab, lower=True, dashes_to_spaces=True)
    assert rows(dashed) == [("main_theme", "other", 2)]
    exact = V.check_vocabulary(df, "main_theme", vocab)
    assert len(rows(exact)) == 3


def test_unique_values_and_variants(spark):
    df = spark.createDataFrame([(" a", "b"), ("a ", None)], "x string, y string")
    assert [r.value for r in V.unique_values(df, ["x", "y"]).collect()] == ["a", "b"]
    names = spark.createDataFrame(
        [("Lima, M.J.M",), ("Lima, M.J.M.",), ("Lima, M.J.M.",), ("-",), ("Costa & Rodrigues",),
         ("Solo",), (None,)], "name string")
    got = {r.label: (r.n_rows, r.n_variants, r.is_placeholder, r.has_two_names)
           for r in V.name_variants(names).collect()}
    assert got == {"Lima, M.J.M": (1, 2, False, False), "Lima, M.J.M.": (2, 2, False, False),
                   "-": (1, 1, True, False), "Costa & Rodrigues": (1, 1, False, True)}


def test_read_batch(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text('Title,Publication Type,Unnamed: 2\n"A ""x""\nb",Article,1\n', encoding="utf-8")
    df = read_batch(spark, str(path), multi_line=True)
    assert df.columns == ["title", "publication type"]
    assert df.first().title == 'A "x"\nb'
    assert tidy_headers(df).columns == df.columns


def test_read_authority(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text('Books,Theses,"note\nover ""two"" lines"\nPrasa Łódź,Uni A,\nمجلة,,\n,,\n'
                    "Prasa Łódź,Uni B,\n", encoding="utf-8")
    got = rows(read_authority(spark, str(path), ["books", "theses"]))
    assert got == [("books", "Prasa Łódź"), ("books", "مجلة"), ("theses", "Uni A"),
                   ("theses", "Uni B")]
