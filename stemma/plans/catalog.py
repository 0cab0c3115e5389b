"""The catalogue as five typed tables, and the way to and from quads.

All tables but labels that hold everywhere carry `g`, the record's graph. Writing them bucketed by `g` (see
`stemma.sources.store`) makes every per-record join and aggregation local.

The tables are sets of facts, yet a row may repeat (two source lines can state
the same author). Operators count distinct things or take minima, so they need
no `distinct` pass over the facts first.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stemma import model as M


@dataclass
class Catalog:
    """Typed tables.

    types     work, g, class
    links     work, g, role, property, ordinal, target
    literals  work, g, property, value
    labels    uri, label, kind      kind: person, year, …, work, graph, user
    state     g, status, generated_at, creator, modifier   (text, NULL = absent)

    Labels with a further column `g` hold in the graph that states them; without it they hold
    in every graph.

    `stated` may have rows of `types`, `links` and `literals` that no pass made distinct, `labels` (uri, label, g)
    of all records without kinds, and labels of records themselves (`own`), for operators that need no more.
    """

    types: DataFrame
    links: DataFrame
    literals: DataFrame
    labels: DataFrame
    state: DataFrame
    stated: dict[str, DataFrame] | None = None

    def as_stated(self, name: str) -> DataFrame:
        """A table whose rows may repeat, without a pass that makes them distinct where there is such a one."""
        return self.stated[name] if self.stated else getattr(self, name)

    def stated_links_of(self, *roles: str) -> DataFrame:
        """`links_of` whose rows may repeat, as in `as_stated`."""
        return self.stated["links"].filter(F.col("role").isin(*roles)) if self.stated else self.links_of(*roles)

    def link_labels(self, *kinds: str) -> DataFrame:
        """(uri, label, g) that are enough to label links in their graph; `kinds` are those of their roles."""
        return self.stated["labels"] if self.stated else self._labels(kinds).select("uri", "label", "g")

    def links_of(self, *roles: str) -> DataFrame:
        return self.links.filter(F.col("role").isin(*roles))

    def _labels(self, kinds) -> DataFrame:
        return self.labels.filter(F.col("kind").isin(*kinds)) if kinds else self.labels

    def labels_of(self, *kinds: str) -> DataFrame:
        """(uri, label) of the named kinds or of all, whichever graph states them."""
        rows = self._labels(kinds)
        pairs = rows.select("uri", "label")
        return pairs.distinct() if "g" in rows.columns else pairs

    def labelled(self, *kinds: str) -> DataFrame:
        """The URIs (uri) that have a label of the named kinds, as often as they have one."""
        if self.stated and set(kinds) <= {"graph", "work"}:
            return self.stated["own"].filter(F.col("kind").isin(*kinds)).select("uri")
        return self._labels(kinds).select("uri")

    def with_labels(self, rows: DataFrame, key: str, *kinds: str) -> DataFrame:
        """`rows` (with g and the URI column `key`) joined with the labels of their graph.

        Where labels carry graphs, a value that all records share is no hot key here.
        """
        labels = self._labels(kinds)
        on = [key, "g"] if "g" in labels.columns else [key]
        return rows.join(labels.withColumnRenamed("uri", key).select(*on, "label"), on)

    def literal(self, prop: str) -> DataFrame:
        return self.literals.filter(F.col("property") == prop)

    def quads(self) -> DataFrame:
        """Every fact as (s, p, o, o_kind, o_type, g), each once."""
        return to_quads(self)


class FacetCatalog(Catalog):
    """A catalogue whose tables are unions of facets, each built when asked for.

    `links`, `literals` and `labels` map a role, property or kind to a function
    that gives its rows. An operator on two roles builds and reads just those.
    `quads` gives the rows of `to_quads` in fewer passes, where the source knows how.
    """

    def __init__(self, types, state, links, literals, labels, quads=None):
        self._quads = quads
        self._parts = {"types": {"": types}, "state": {"": state}, "links": links,
                       "literals": literals, "labels": labels}
        self._built: dict[tuple, DataFrame] = {}
        self.stated = None

    def _part(self, name: str, key: str) -> DataFrame:
        if (name, key) not in self._built:
            self._built[name, key] = self._parts[name][key]()
        return self._built[name, key]

    def _rows(self, name: str, keys=None) -> DataFrame:
        known = self._parts[name]
        wanted = [k for k in (known if keys is None else keys) if k in known]
        if not wanted:
            return self._part(name, next(iter(known))).filter(F.lit(False))
        return reduce(DataFrame.unionByName, [self._part(name, k) for k in wanted])

    types = property(lambda self: self._rows("types"))
    state = property(lambda self: self._rows("state"))
    links = property(lambda self: self._rows("links"))
    literals = property(lambda self: self._rows("literals"))
    labels = property(lambda self: self._rows("labels"))

    def links_of(self, *roles: str) -> DataFrame:
        return self._rows("links", roles)

    def _labels(self, kinds) -> DataFrame:
        return self._rows("labels", kinds or None)

    def literal(self, prop: str) -> DataFrame:
        return self._rows("literals", [prop])

    def quads(self) -> DataFrame:
        return self._quads() if self._quads else to_quads(self)


def label_kind(role: Column) -> Column:
    """Kind of the entities a role links to."""
    return F.when(role.isin("author", "editor"), F.lit("person")).otherwise(role)


def one_label(labels: DataFrame) -> DataFrame:
    """Deterministic label per URI: the least one."""
    return labels.groupBy("uri").agg(F.min("label").alias("label"))


def _quad(df, s, p, o, kind, o_type, g) -> DataFrame:
    def c(v):
        return v if isinstance(v, Column) else F.col(v)
    return df.select(c(s).alias("s"), c(p).alias("p"), c(o).alias("o"),
                     F.lit(kind).alias("o_kind"),
                     F.lit(o_type).cast("string").alias("o_type"),
                     c(g).alias("g")).filter(F.col("o").isNotNull())


def to_quads(cat: Catalog) -> DataFrame:
    per_graph = "g" in cat.labels.columns
    mentioned = (
        cat.links.select("g", "target", label_kind(F.col("role")).alias("kind"))
        .join(cat.labels.withColumnRenamed("uri", "target"),
              ["target", "kind", "g"] if per_graph else ["target", "kind"])
    )
    people = cat.state.select("g", F.explode(F.array("creator", "modifier")).alias("uri"))
    users = cat.with_labels(people.filter("uri is not null"), "uri", "user")
    works = cat.labels_of("work").withColumn("g", F.concat("uri", F.lit("/")))
    graphs = cat.labels_of("graph").withColumn("g", F.col("uri"))
    name = F.lit(M.RDFS_LABEL)
    st = cat.state
    parts = [
        _quad(cat.types, "work", F.lit(M.RDF_TYPE), "class", "uri", None, "g"),
        _quad(cat.links, "work", "property", "target", "uri", None, "g"),
        _quad(cat.literals, "work", "property", "value", "literal", None, "g"),
        _quad(mentioned, "target", name, "label", "literal", M.XSD_STRING, "g"),
        _quad(users, "uri", name, "label", "literal", M.XSD_STRING, "g"),
        _quad(works, "uri", name, "label", "literal", None, "g"),
        _quad(graphs, "uri", name, "label", "literal", None, "g"),
        _quad(st, "g", F.lit(M.STATUS), "status", "literal", M.XSD_STRING, "g"),
        _quad(st, "g", F.lit(M.GENERATED_AT), "generated_at", "literal",
              M.XSD_DATETIME, "g"),
        _quad(st, "g", F.lit(M.ATTRIBUTED_TO), "creator", "uri", None, "g"),
        _quad(st, "g", F.lit(M.INFLUENCED_BY), "modifier", "uri", None, "g"),
    ]
    if per_graph:
        vocabulary = cat.labels.filter("kind = 'vocabulary'")
        parts.append(_quad(vocabulary, "uri", name, "label", "literal", None, "g"))
    return reduce(DataFrame.unionByName, parts).distinct()


def role_of(prop: Column) -> Column:
    roles = F.create_map(*[F.lit(v) for kv in M.ROLES.items() for v in kv])
    return F.coalesce(F.element_at(roles, prop), F.lit("other"))


def ordinal_of(prop: Column) -> Column:
    slots = F.create_map(*[
        F.lit(v) for props in (M.AUTHOR_PROPS, M.EDITOR_PROPS)
        for i, p in enumerate(props, 1) for v in (p, i)])
    return F.element_at(slots, prop)


def from_quads(quads: DataFrame) -> Catalog:
    """Typed tables of any quad set.

    Subjects are split by shape: `g` itself carries provenance, its entity
    (the same URI without the closing slash) carries the record. Labels keep the
    graph that states them. Every graph but the vocabulary has a state, typed or not.
    """
    s, p, o, g = (F.col(c) for c in ("s", "p", "o", "g"))
    entity = F.regexp_replace(g, "/$", "")
    body = quads.filter(g != M.VOCAB_GRAPH)
    stated = {"types": body.filter(p == M.RDF_TYPE).select(s.alias("work"), "g", o.alias("class"))}
    types = stated["types"].distinct()
    facts = body.filter((s == entity) & (~p.isin(M.RDF_TYPE, M.RDFS_LABEL)))
    stated["links"] = facts.filter(F.col("o_kind") == "uri").select(
        s.alias("work"), "g", role_of(p).alias("role"), p.alias("property"),
        ordinal_of(p).alias("ordinal"), o.alias("target"))
    links = stated["links"].distinct()
    stated["literals"] = facts.filter(F.col("o_kind") == "literal").select(
        s.alias("work"), "g", p.alias("property"), o.alias("value"))
    literals = stated["literals"].distinct()

    named = quads.filter((p == M.RDFS_LABEL) & (F.col("o_kind") == "literal"))
    stated["labels"] = named.filter(g != M.VOCAB_GRAPH).select(s.alias("uri"), o.alias("label"), "g")
    pairs = named.select(s.alias("uri"), o.alias("label"), "g").distinct()
    kinds = (
        links.select(F.col("target").alias("uri"),
                     label_kind(F.col("role")).alias("kind"))
        .unionByName(body.filter(p.isin(M.ATTRIBUTED_TO, M.INFLUENCED_BY))
                     .select(o.alias("uri"), F.lit("user").alias("kind")))
        .distinct()
    )
    stated["own"] = named.filter(s.isin(g, entity)).select(
        s.alias("uri"), o.alias("label"),
        F.when(s == g, F.lit("graph")).otherwise(F.lit("work")).alias("kind"), "g")
    own = stated["own"].distinct()
    vocab = named.filter(g == M.VOCAB_GRAPH).select(
        s.alias("uri"), o.alias("label"), F.lit("vocabulary").alias("kind"), "g").distinct()
    labels = pairs.join(kinds, "uri").unionByName(own).unionByName(vocab)

    told = {"status": M.STATUS, "generated_at": M.GENERATED_AT,
            "creator": M.ATTRIBUTED_TO, "modifier": M.INFLUENCED_BY}
    values = body.filter((s == g) & p.isin(*told.values())).groupBy("g").agg(
        *[F.collect_set(F.when(p == prop, o)).alias(name) for name, prop in told.items()])
    state = body.select("g").distinct().join(values, "g", "left")
    for name in told:
        state = state.withColumn(name, F.explode_outer(name))
    return Catalog(types, links, literals, labels, state, stated)
