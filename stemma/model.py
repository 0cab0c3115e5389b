"""Vocabulary terms, schemas and fixed values of the catalogue data model."""

from __future__ import annotations

from pyspark.sql import types as T

BASE = "https://example.org/catalog/"
VOCAB = BASE + "vocabularies/"
VOCAB_GRAPH = VOCAB

# Public ontology terms.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
XSD_STRING = "http://www.w3.org/2001/XMLSchema#string"
XSD_DATETIME = "http://www.w3.org/2001/XMLSchema#dateTime"
FABIO = "http://purl.org/spar/fabio/"
DCT_TITLE = "http://purl.org/dc/terms/title"
DCT_LANGUAGE = "http://purl.org/dc/terms/language"
DCT_PUBLISHER = "http://purl.org/dc/terms/publisher"
PRISM = "http://prismstandard.org/namespaces/basic/2.0/"
PUBLICATION_DATE = PRISM + "publicationDate"
DOI = PRISM + "doi"
VOLUME = PRISM + "volume"
ISSUE = PRISM + "issueIdentifier"
PAGES = PRISM + "pageRange"
ISBN = PRISM + "isbn"
REFERENCED_BY = "http://purl.org/spar/biro/isReferencedBy"
PART_OF = "http://purl.org/vocab/frbr/core#partOf"
URL = FABIO + "hasURL"
PRIMARY_SUBJECT = FABIO + "hasPrimarySubjectTerm"
SUBJECT = FABIO + "hasSubjectTerm"
KEYWORDS = "https://schema.org/keywords"
ATTRIBUTED_TO = "http://www.w3.org/ns/prov#wasAttributedTo"
INFLUENCED_BY = "http://www.w3.org/ns/prov#wasInfluencedBy"
GENERATED_AT = "http://www.w3.org/ns/prov#generatedAtTime"
STATUS = "http://dbpedia.org/ontology/currentStatus"
WIKIDATA = "http://www.wikidata.org/entity/"
GEONAMES = "https://sws.geonames.org/"

NOT_MODIFIED, MODIFIED, PUBLISHED = "not modified", "modified", "published"
STAGES = [NOT_MODIFIED, MODIFIED, PUBLISHED]

ARTICLE = FABIO + "JournalArticle"
THESIS = FABIO + "DoctoralThesis"
CHAPTER = FABIO + "BookChapter"
BOOK = FABIO + "Book"
JOURNAL_ISSUE = FABIO + "JournalIssue"
REPORT = FABIO + "ReportDocument"
WORK = FABIO + "Work"

# Author and editor slots are predicates named by ordinal.
ORDINALS = ["first", "second", "third", "fourth", "fifth",
            "sixth", "seventh", "eighth", "ninth", "tenth"]
AUTHOR_PROPS = [f"{BASE}{o}Author" for o in ORDINALS]
EDITOR_PROPS = [f"{BASE}{o}Editor" for o in ORDINALS]
OTHER_AUTHORS = BASE + "otherAuthors"
OTHER_EDITORS = BASE + "otherEditors"
ET_AL = BASE + "et-al"

# Headers accepted in a tabular batch.
BATCH_COLUMNS = (
    ["reference (apa)", "publication type", "title"]
    + [f"author_{k}" for k in range(1, 11)]
    + ["journal", "volume", "issue", "pages", "year", "main_theme",
       "secondary_theme", "lang", "link", "doi", "booktitle", "publisher"]
    + [f"editor_{k}" for k in range(1, 11)]
)

# Controlled vocabularies of a batch.
PUBLICATION_TYPES = ["Article", "Journal Issue", "Report", "Book chapter",
                     "Book", "Doctoral Thesis", "Doctoral thesis",
                     "Grey Literature"]
LANGUAGES = ["Polish", "Spanish", "Portuguese", "Italian", "Dutch", "German",
             "French", "English", "Finnish", "Slovak", "Simplified Chinese"]
SUBJECTS = [
    "Theoretical & conceptual publications",
    "Formal education",
    "Higher education research",
    "Informal education including youth work, media & community work",
    "International volunteering, study visits & educational partnerships",
    "Non-formal education",
    "Policy related research",
    "Teacher education & training of trainers",
]
# Fixed values: (text looked for in the lower-cased label, vocabulary id).
SUBJECT_IDS = [
    ("theoretical & conceptual publications",
     "theoretical-and-conceptual-publications"),
    ("higher education", "higher-education-research"),
    ("informal education including youth work, media & community work",
     "informal-education-including-youth-work-media-and-community-work"),
    ("international volunteering, study visits & educational partnerships",
     "international-volunteering-study-visits-and-educational-partnerships"),
    ("teacher education & training of trainers",
     "teacher-education-and-training-of-trainers"),
]
# Text looked for in the publication type, first hit wins.
CLASS_CASCADE = [
    ("article", ARTICLE), ("thesis", THESIS), ("book chapter", CHAPTER),
    ("book", BOOK), ("issue", JOURNAL_ISSUE), ("report", REPORT),
    ("grey literature", WORK),
]
# A hit on the first text counts only without the second.
CLASS_GUARDS = {"book": "chapter"}
# Language series of the yearly chart.
CHART_LANGUAGES = ["english", "italian", "spanish", "portuguese",
                   "german", "french", "polish", "dutch"]
# Text looked for in the class, name shown on a record page.
DISPLAY_CLASSES = [
    ("Article", "Journal article"), ("Issue", "Journal issue"),
    ("Chapter", "Book chapter"), ("Book", "Book"),
    ("Doctoral", "Doctoral thesis"), ("Report", "Report"),
]
DEFAULT_DISPLAY_CLASS = "Document"
# Reference-manager type per template.
RIS_TYPES = {"article": "JOUR", "book_chapter": "CHAP", "book": "BOOK",
             "doctoral_thesis": "THES", "example_template": "JOUR",
             "journal_issue": "SER", "report": "RPRT"}
# Class described by each template.
TEMPLATE_CLASSES = {"article": ARTICLE, "journal_issue": JOURNAL_ISSUE,
                    "book": BOOK, "book_chapter": CHAPTER,
                    "doctoral_thesis": THESIS, "report": REPORT}

PAGE_SIZE = 40
BACK_LINK_PAGE = 10
DAILY_LIMIT = 150

# What a property links to; drives the `role` column of the links table.
ROLES = {
    **{p: "author" for p in AUTHOR_PROPS},
    **{p: "editor" for p in EDITOR_PROPS},
    OTHER_AUTHORS: "others",
    OTHER_EDITORS: "others",
    PUBLICATION_DATE: "year",
    DCT_LANGUAGE: "language",
    DCT_PUBLISHER: "publisher",
    PART_OF: "container",
    PRIMARY_SUBJECT: "primary_subject",
    SUBJECT: "subject",
    KEYWORDS: "keyword",
}
# Authors and editors are one kind of labelled entity.
LABEL_KINDS = {"author": "person", "editor": "person"}
# Kinds of labels that values of a record have.
VALUE_KINDS = ["person", "others", "year", "language", "publisher", "container",
               "primary_subject", "subject", "keyword", "other"]

QUAD = T.StructType([
    T.StructField("s", T.StringType()),
    T.StructField("p", T.StringType()),
    T.StructField("o", T.StringType()),
    T.StructField("o_kind", T.StringType()),
    T.StructField("o_type", T.StringType()),
    T.StructField("g", T.StringType()),
])
QUAD_COLUMNS = QUAD.fieldNames()

TEMPLATE_FIELD = T.StructType([
    T.StructField("template", T.StringType()),
    T.StructField("class", T.StringType()),
    T.StructField("field_id", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("property", T.StringType()),
    T.StructField("field_type", T.StringType()),
    T.StructField("value_kind", T.StringType()),
    T.StructField("browse", T.BooleanType()),
    T.StructField("disambiguate", T.BooleanType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("status", T.StringType()),
])


def standard_fields() -> list[tuple]:
    """Field lists of the six standard templates as TEMPLATE_FIELD rows."""
    def people(word, props, others, browse=False):
        rows = [(f"{word} {k}", p, "Textbox", "URI", browse, False)
                for k, p in enumerate(props, 1)]
        extra = (f"Omit other {word.lower()}s", others, "Checkbox", "URI",
                 False, False)
        return rows[:1] + [extra] + rows[1:]

    def text(label, prop, main=False):
        return (label, prop, "Textbox", "Literal", False, main)

    def term(label, prop, kind="Textbox", browse=True):
        return (label, prop, kind, "URI", browse, False)

    def tail(browse=True, isbn=False):
        rows = [term("Publication year", PUBLICATION_DATE, "Dropdown", browse),
                term("Primary subject", PRIMARY_SUBJECT, "Checkbox", browse),
                term("Secondary subject", SUBJECT, "Checkbox", browse),
                term("Language", DCT_LANGUAGE, "Dropdown", browse),
                text("Link", URL), text("DOI", DOI)]
        return rows + ([text("ISBN", ISBN)] if isbn else [])

    citation, title = text("Citation", REFERENCED_BY, True), text("Title", DCT_TITLE)
    authors = people("Author", AUTHOR_PROPS, OTHER_AUTHORS)
    editors = people("Editor", EDITOR_PROPS, OTHER_EDITORS)
    publisher, pages = term("Publisher", DCT_PUBLISHER), text("Pages", PAGES)
    lists = {
        "article": [citation, title, *authors, term("Journal", PART_OF),
                    text("Volume", VOLUME), text("Issue", ISSUE), pages, *tail()],
        "journal_issue": [citation, title, text("Volume", VOLUME),
                          text("Issue number", ISSUE),
                          term("Journal", PART_OF, browse=False),
                          *tail(browse=False)],
        "book": [title, citation, *authors, *editors, publisher, pages,
                 *tail(isbn=True)],
        "book_chapter": [citation, title, *authors, *editors,
                         term("Book title", PART_OF), publisher, pages,
                         *tail(isbn=True)],
        "doctoral_thesis": [citation, title,
                            *people("Author", AUTHOR_PROPS[:1], OTHER_AUTHORS, True)[:1],
                            publisher, pages, *tail()],
        "report": [citation, title, *authors, publisher, pages,
                   *tail(isbn=True)],
    }
    return [
        (name, TEMPLATE_CLASSES[name], f"{name}-{i:02d}", *field, i, None)
        for name, fields in lists.items() for i, field in enumerate(fields, 1)
    ]
