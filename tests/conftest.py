import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stemma import model as M  # noqa: E402

SF = "/root/testdata/sf0.001"
OLD = "https://example.org/old/"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def record_quads():
    """Three small records, a vocabulary graph and an untyped graph.

    w1: article, published, two subjects, two links, author with two labels,
        creator without label. w2: book, modified twice, same year under the old
        base, external authority URI. w3: article, not modified.
    """
    rows = []

    def add(g, s, p, o, kind="literal", o_type=None):
        rows.append((s, p, o, kind, o_type, g))

    def uri(g, s, p, o, *labels):
        add(g, s, p, o, "uri")
        for label in labels:
            add(g, o, M.RDFS_LABEL, label, "literal", M.XSD_STRING)

    B, V = M.BASE, M.VOCAB
    w, g = B + "w1", B + "w1/"
    uri(g, w, M.RDF_TYPE, M.ARTICLE)
    add(g, w, M.DCT_TITLE, "Zebra crossing")
    add(g, w, M.RDFS_LABEL, "Zebra crossing")
    add(g, w, M.REFERENCED_BY, "Doe, J. (2020). Zebra crossing.")
    add(g, g, M.RDFS_LABEL, "Doe, J. (2020). Zebra crossing.")
    uri(g, w, M.PUBLICATION_DATE, V + "2020", "2020")
    uri(g, w, M.AUTHOR_PROPS[0], B + "a1", "Doe, J.", "Doe, John")
    uri(g, w, M.AUTHOR_PROPS[1], B + "a2", "Roe, R.")
    uri(g, w, M.PART_OF, B + "j1", "Road Journal")
    uri(g, w, M.PRIMARY_SUBJECT, V + "roads", "Roads")
    uri(g, w, M.PRIMARY_SUBJECT, V + "animals", "Animals")
    uri(g, w, M.DCT_LANGUAGE, V + "english", "English")
    add(g, w, M.URL, "https://example.org/b")
    add(g, w, M.URL, "https://example.org/a")
    add(g, w, M.VOLUME, "7")
    add(g, g, M.STATUS, M.PUBLISHED, "literal", M.XSD_STRING)
    add(g, g, M.GENERATED_AT, "2022-01-01T10:00:00", "literal", M.XSD_DATETIME)
    uri(g, g, M.ATTRIBUTED_TO, B + "nolabel")

    w, g = B + "w2", B + "w2/"
    uri(g, w, M.RDF_TYPE, M.BOOK)
    add(g, w, M.DCT_TITLE, "alpha roads")
    add(g, w, M.RDFS_LABEL, "alpha roads")
    add(g, w, M.REFERENCED_BY, "Roe, R. (2020). alpha roads.")
    add(g, g, M.RDFS_LABEL, "Roe, R. (2020). alpha roads.")
    uri(g, w, M.PUBLICATION_DATE, OLD + "vocabularies/2020", "2020")
    uri(g, w, M.AUTHOR_PROPS[0], B + "a2", "Roe, R.")
    uri(g, w, M.EDITOR_PROPS[0], M.WIKIDATA + "Q42", "Adams, D.")
    uri(g, w, M.DCT_PUBLISHER, B + "p1", "Press")
    uri(g, w, M.DCT_LANGUAGE, OLD + "vocabularies/english", "english")
    add(g, g, M.STATUS, M.MODIFIED, "literal", M.XSD_STRING)
    add(g, g, M.GENERATED_AT, "2022-02-01T10:00:00", "literal", M.XSD_DATETIME)
    add(g, g, M.GENERATED_AT, "2022-03-01T10:00:00", "literal", M.XSD_DATETIME)
    uri(g, g, M.ATTRIBUTED_TO, B + "u1", "u1@example.org")
    uri(g, g, M.INFLUENCED_BY, B + "u2", "u2@example.org")

    w, g = B + "w3", B + "w3/"
    uri(g, w, M.RDF_TYPE, M.ARTICLE)
    add(g, w, M.DCT_TITLE, "Draft")
    add(g, w, M.RDFS_LABEL, "Draft")
    add(g, w, M.REFERENCED_BY, "No author (). Draft.")
    add(g, g, M.RDFS_LABEL, "No author (). Draft.")
    uri(g, w, M.PART_OF, B + "j1", "Road Journal")
    add(g, g, M.STATUS, M.NOT_MODIFIED, "literal", M.XSD_STRING)
    add(g, g, M.GENERATED_AT, "2022-01-05T10:00:00", "literal", M.XSD_DATETIME)
    uri(g, g, M.ATTRIBUTED_TO, B + "u1", "u1@example.org")

    add(V, V + "2020", M.RDFS_LABEL, "2020")
    return rows


@pytest.fixture(scope="session")
def quads(spark):
    return spark.createDataFrame(record_quads(), M.QUAD).cache()


@pytest.fixture(scope="session")
def cat(quads):
    from stemma.plans.catalog import Catalog, from_quads
    from stemma.sources.store import TABLES
    built = from_quads(quads)
    return Catalog(*[getattr(built, name).cache() for name in TABLES])


def rows(df, *columns):
    df = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in df.collect()),
                  key=lambda r: tuple((v is None, str(v)) for v in r))
