"""Entities of the catalogue, and names matched to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stemma import model as M
from stemma.functions import terms, text as X
from stemma.plans.catalog import Catalog


def _named(targets: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct targets with their labels: distinct first, then the join."""
    return (targets.select(F.col("target").alias("uri")).distinct()
            .join(labels.distinct(), "uri"))


def people(cat: Catalog) -> DataFrame:
    """Authors and editors of any slot as (uri, label)."""
    return _named(cat.links_of("author", "editor"), cat.labels_of("person"))


def _containers_of(cat: Catalog, work_class: str) -> DataFrame:
    works = cat.types.filter(F.col("class") == work_class).select("work")
    return _named(cat.links_of("container").join(works, "work", "left_semi"),
                  cat.labels_of("container"))


def journals(cat: Catalog) -> DataFrame:
    return _containers_of(cat, M.ARTICLE)


def books(cat: Catalog) -> DataFrame:
    return _containers_of(cat, M.CHAPTER)


def publishers(cat: Catalog) -> DataFrame:
    return _named(cat.links_of("publisher"), cat.labels_of("publisher"))


def entities(cat: Catalog) -> DataFrame:
    """All four kinds as (kind, uri, label).

    Kind follows from the role, for containers from the class of the work.
    """
    plain = (
        cat.links_of("author", "editor", "publisher")
        .select(F.when(F.col("role") == "publisher", F.lit("publishers"))
                .otherwise(F.lit("people")).alias("kind"),
                F.col("target").alias("uri")).distinct()
    )
    held = (
        cat.links_of("container").select("work", "target")
        .join(cat.types.filter(F.col("class").isin(M.ARTICLE, M.CHAPTER)), "work")
        .select(F.when(F.col("class") == M.ARTICLE, F.lit("journals"))
                .otherwise(F.lit("books")).alias("kind"),
                F.col("target").alias("uri")).distinct()
    )
    def found(rows, *kinds):
        return rows.join(cat.labels_of(*kinds).distinct(), "uri")

    both = found(plain, "person", "publisher").unionByName(found(held, "container"))
    return both.select("kind", "uri", "label").distinct()


def batch_names(batch: DataFrame) -> DataFrame:
    """Trimmed names of a batch as distinct (kind, label)."""
    columns = [("people", f"{w}_{k}") for w in ("author", "editor") for k in range(1, 11)]
    columns += [("journals", "journal"), ("publishers", "publisher"), ("books", "booktitle")]
    slots = [f"named_struct('kind', '{kind}', 'label', {X.cell(c)})" for kind, c in columns]
    return (batch.selectExpr(f"inline(array({', '.join(slots)}))")
            .filter("label is not null").distinct())


def match_entities(names: DataFrame, known: DataFrame) -> DataFrame:
    """Names with the URI of the equally spelled entity of their kind.

    Returns (kind, label, uri, status); several entities of one label give the
    least URI. Both sides are distinct, so no key is hot.
    """
    by_label = known.groupBy("kind", "label").agg(F.min("uri").alias("uri"))
    return names.distinct().join(by_label, ["kind", "label"], "left").withColumn(
        "status", F.when(F.col("uri").isNull(), F.lit("NEW")).otherwise(F.lit("MATCH")))


def mint_uris(matched: DataFrame, base: str = M.BASE) -> DataFrame:
    """New names with the URI they get."""
    return matched.filter("status = 'NEW'").selectExpr(
        "kind", "label", f"{terms.minted_uri('kind', 'label', base)} as uri")
