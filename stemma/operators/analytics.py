"""Counters, yearly series and the wide export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stemma import model as M
from stemma.functions.terms import choose
from stemma.plans.catalog import Catalog, one_label
from stemma.plans.durable import written


def counters(cat: Catalog, approximate: bool = False) -> DataFrame:
    """One row with authors, publications, languages, publishers, journals, topics.

    Facts are reduced to distinct (counter, thing) pairs in one aggregation and
    then counted. `approximate` trades the pair shuffle for sketches.
    """
    things = _things(cat)
    if approximate:
        counted = things.groupBy("counter").agg(F.approx_count_distinct("x").alias("n"))
    else:
        counted = things.distinct().groupBy("counter").agg(F.count("*").alias("n"))
    return _one_row(counted)


COUNTERS = ["n_authors", "n_publications", "n_languages", "n_publishers", "n_journals", "n_topics"]


def _things(cat: Catalog) -> DataFrame:
    """(counter, x) of all that the counters count, repeated ones too."""
    by_role = {"author": "n_authors", "language": "n_languages", "publisher": "n_publishers",
               "primary_subject": "n_topics", "subject": "n_topics"}
    types = cat.as_stated("types")
    things = cat.stated_links_of(*by_role).selectExpr(
        f"{choose('role', by_role)} as counter", "target as x")
    articles = types.filter(F.col("class") == M.ARTICLE).select("work")
    return things.unionByName(
        types.select(F.lit("n_publications").alias("counter"), F.col("work").alias("x"))
    ).unionByName(
        cat.stated_links_of("container").join(articles, "work", "left_semi")
        .select(F.lit("n_journals").alias("counter"), F.col("target").alias("x")))


def _one_row(counted: DataFrame) -> DataFrame:
    return counted.agg(*[
        F.expr(f"coalesce(sum(n) filter (where counter = '{n}'), 0)").alias(n) for n in COUNTERS])


SKETCH_BITS = 14       # sketches of 2^14 registers: a standard error of 0.8 %, 16 KB at most


def counter_sketches(cat: Catalog) -> DataFrame:
    """(counter, sketch): mergeable sketches of what each counter counts in one load.

    Six rows of at most 2^SKETCH_BITS bytes, whatever the load; kept beside it, they answer for any set of loads.
    """
    return _things(cat).groupBy("counter").agg(F.hll_sketch_agg("x", F.lit(SKETCH_BITS)).alias("sketch"))


def sketched_counters(sketches: DataFrame) -> DataFrame:
    """The counters of the union of loads, from their sketches alone; as `counters`, about."""
    return _one_row(sketches.groupBy("counter").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n")))


def _year_labels(counts: DataFrame, cat: Catalog, by: str) -> DataFrame:
    labels = one_label(cat.labels_of("year")).select(
        F.col("uri").alias("year_uri"), F.col("label").alias("year"))
    return counts.join(labels, "year_uri")


def per_year(cat: Catalog, roles: list[str] | None = None, by: str = "uri") -> DataFrame:
    """Distinct targets of `roles` (works when None) per publication year.

    Counted per year URI before the label join. With `by='label'` years that
    exist under several URIs are one group.
    """
    years = cat.links_of("year").select("work", F.col("target").alias("year_uri"))
    if roles is None:
        pairs = years.select("year_uri", F.col("work").alias("x"))
    else:
        pairs = cat.links_of(*roles).select("work", F.col("target").alias("x")).join(
            years, "work").select("year_uri", "x")
    if by == "label":
        named = _year_labels(pairs.distinct(), cat, by)
        return named.groupBy("year").agg(F.countDistinct("x").alias("count")).orderBy("year")
    counts = pairs.groupBy("year_uri").agg(F.countDistinct("x").alias("count"))
    return _year_labels(counts, cat, by).select("year", "year_uri", "count").orderBy(
        "year", "year_uri")


def authors_per_year(cat: Catalog, by: str = "uri") -> DataFrame:
    return per_year(cat, ["author"], by)


def publications_per_year(cat: Catalog, by: str = "uri") -> DataFrame:
    return per_year(cat, None, by)


def topics_per_year(cat: Catalog, by: str = "uri") -> DataFrame:
    return per_year(cat, ["primary_subject", "subject"], by)


def publishers_per_year(cat: Catalog, by: str = "uri") -> DataFrame:
    return per_year(cat, ["publisher"], by)


def language_by_year(cat: Catalog) -> DataFrame:
    """(year, language, count) of works, every language of every year.

    Counts of one language or year under several URIs add up.
    """
    years = cat.links_of("year").select("work", F.col("target").alias("year_uri"))
    langs = cat.links_of("language").select("work", F.col("target").alias("lang_uri"))
    counts = (
        langs.join(years, "work").groupBy("year_uri", "lang_uri")
        .agg(F.countDistinct("work").alias("n"))
    )
    lang_labels = one_label(cat.labels_of("language")).select(
        F.col("uri").alias("lang_uri"), F.lower("label").alias("lang"))
    named = _year_labels(counts.join(lang_labels, "lang_uri"), cat, "uri")
    return (named.groupBy("year", F.col("lang").alias("language"))
            .agg(F.sum("n").alias("count")).orderBy("year", "language"))


def language_chart(cat: Catalog, languages: list[str] | None = None) -> DataFrame:
    """One row per year: a column per wanted series, and `other` for all further languages."""
    languages = languages or M.CHART_LANGUAGES
    series = F.when(F.col("language").isin(*languages), F.col("language")).otherwise("other")
    return (language_by_year(cat).withColumn("series", series).groupBy("year")
            .pivot("series", [*languages, "other"]).agg(F.sum("count")).orderBy("year"))


# Columns of the wide export, in file order.
EXPORT_COLUMNS = (
    ["article_id", "type", "citation", "title"]
    + [f"author{k}" for k in range(1, 11)] + [f"editor{k}" for k in range(1, 11)]
    + ["journal_or_booktitle", "volume", "issue", "pages", "year", "publisher",
       "language", "link", "doi", "topic"]
)


def labelled_links(cat: Catalog, *roles: str) -> DataFrame:
    """(work, property, label) of links, the least label per target.

    Labels are written first: Spark splits a partition of hot targets, such as a year that a seventh of all
    works share, only where the other side of the join comes straight from a shuffle, not from an aggregation.
    """
    kinds = sorted({M.LABEL_KINDS.get(r, r) for r in roles})
    labels = written(one_label(cat.labels_of(*kinds)).withColumnRenamed("uri", "target"), "link-labels")
    return cat.links_of(*roles).select("work", "property", "target").join(
        labels, "target").select("work", "property", "label")


def work_properties(cat: Catalog) -> DataFrame:
    """Everything about works in long form: (work, property, label)."""
    links = labelled_links(cat, "author", "editor", "year", "language", "publisher",
                           "container", "primary_subject")
    texts = cat.literals.select("work", "property", F.col("value").alias("label"))
    types = cat.types.select("work", F.lit(M.RDF_TYPE).alias("property"),
                             F.col("class").alias("label"))
    return links.unionByName(texts).unionByName(types)


def property_value(prop: str, name: str) -> Column:
    """Least value of a property inside a group of `work_properties`."""
    return F.expr(f"min(label) filter (where property = '{prop}')").alias(name)


def export_wide(cat: Catalog) -> DataFrame:
    """One row per cited work with the 34 export columns.

    A single aggregation of the long form by work replaces one outer join per
    column; missing values are '-', topics are the distinct primary subjects.
    """
    topics = (f"array_join(array_sort(collect_set(label) filter "
              f"(where property = '{M.PRIMARY_SUBJECT}')), '; ')")
    columns = {
        "type": M.RDF_TYPE, "citation": M.REFERENCED_BY, "title": M.DCT_TITLE,
        **{f"author{k}": p for k, p in enumerate(M.AUTHOR_PROPS, 1)},
        **{f"editor{k}": p for k, p in enumerate(M.EDITOR_PROPS, 1)},
        "journal_or_booktitle": M.PART_OF, "volume": M.VOLUME, "issue": M.ISSUE,
        "pages": M.PAGES, "year": M.PUBLICATION_DATE, "publisher": M.DCT_PUBLISHER,
        "language": M.DCT_LANGUAGE, "link": M.URL, "doi": M.DOI,
    }
    wide = (
        work_properties(cat).groupBy(F.col("work").alias("article_id"))
        .agg(*[property_value(p, c) for c, p in columns.items()],
             F.expr(topics).alias("topic"))
        .filter("citation is not null and type is not null")
    )
    shown = {"type": f"replace(type, '{M.FABIO}')", "language": "lower(coalesce(language, '-'))",
             "article_id": "article_id", "citation": "citation", "topic": "topic"}
    return wide.selectExpr(*[
        f"{shown.get(c, f"coalesce({c}, '-')")} as {c}" for c in EXPORT_COLUMNS])
