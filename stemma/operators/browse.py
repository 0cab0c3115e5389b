"""Listings, counts, facets, record and term pages over a catalogue.

Where the original question names one key, the key is a table here and one
result covers all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F, Window as W

from stemma import model as M
from stemma.functions import terms, text as X
from stemma.plans.catalog import Catalog, one_label
from stemma.plans.durable import written


def latest_state(cat: Catalog) -> DataFrame:
    """State rows carrying the latest moment of their graph.

    A grouped maximum joined back: it combines before the shuffle, so a graph
    with very many versions does not end up in one window.
    """
    last = cat.state.groupBy("g").agg(F.max("generated_at").alias("last"))
    rows = cat.state.join(last, "g")
    return rows.filter(F.col("last").isNull() | (F.col("generated_at") == F.col("last"))
                       ).drop("last")


def records(cat: Catalog, work_class: str | None = None,
            single_state: bool = False, graphs: DataFrame | None = None) -> DataFrame:
    """Distinct (g, title, user, modifier, date, stage, class) of typed subjects.

    User and modifier labels form an optional block: a modifier shows only
    beside a labelled user. Missing parts show as '-', a missing title as
    'none'. `single_state` says that graphs have one version, which saves the
    latest-moment pass. `graphs` restricts the listing.
    """
    def chosen(df):
        return df if graphs is None else df.join(graphs, "g", "left_semi")

    types = cat.types if work_class is None else cat.types.filter(F.col("class") == work_class)
    state = chosen(cat.state if single_state else latest_state(cat))
    titles = chosen(cat.labels_of("graph").select(F.col("uri").alias("g"),
                                                  F.col("label").alias("title")))

    def labelled(who, name):
        pairs = state.select("g", F.col(who).alias("uri")).filter("uri is not null")
        pairs = pairs if single_state else pairs.distinct()
        return cat.with_labels(pairs, "uri", "user").select("g", F.col("label").alias(name))

    # The optional block as a whole first, then its outer join; all by graph.
    people = labelled("creator", "user").join(labelled("modifier", "changed_by"), "g", "left")
    rows = (
        chosen(types.filter(F.col("g") != M.VOCAB_GRAPH).select("g", "class"))
        .join(state.select("g", "status", "generated_at"), "g", "left")
        .join(titles, "g", "left").join(people, "g", "left")
    )

    def shown(x, name, alone="-"):
        whole = "title is not null and generated_at is not null and status is not null"
        return f"coalesce(if({whole}, {x}, null), '{alone}') as {name}"

    return rows.selectExpr(
        "g", shown("title", "title", "none"), shown("user", "user"),
        shown("changed_by", "modifier"),
        shown("generated_at", "date"), shown("status", "stage"), "class").distinct()


def records_page(cat: Catalog, page: int = 1, stage: str | None = None,
                 size: int = M.PAGE_SIZE, single_state: bool = False) -> DataFrame:
    """One page of the listing, newest first.

    Graphs are cut from (date, g) pairs with a top-n; every pair has a row at least, so
    the page lies in the first `size * page` of them, and only those graphs are
    completed. Missing dates come last.
    """
    state = cat.state if single_state else latest_state(cat)
    titled = cat.labels_of("graph").select(F.col("uri").alias("g"), F.lit(True).alias("titled"))
    whole = "titled and generated_at is not null and status is not null"
    keys = (cat.types.filter(F.col("g") != M.VOCAB_GRAPH).select("g")
            .join(state.select("g", "status", "generated_at"), "g", "left")
            .join(titled.distinct(), "g", "left")
            .selectExpr("g", f"if({whole}, generated_at, null) as moment",
                        f"lower(if({whole}, status, '-')) as stage"))
    if stage is not None:
        keys = keys.filter(F.col("stage") == stage)
    first = (keys.select("g", "moment").distinct()
             .orderBy(F.col("moment").desc_nulls_last(), "g").limit(size * page))
    first = written(first.select("g").distinct(), "page")
    rows = records(cat, single_state=single_state, graphs=first)
    if stage is not None:
        rows = rows.filter(F.lower("stage") == stage)
    moment = F.when(F.col("date") != "-", F.col("date"))
    return (rows.orderBy(moment.desc_nulls_last(), "g", "class", "title", "user", "modifier")
            .offset(size * (page - 1)).limit(size))


def stage_counts(cat: Catalog, work_class: str | None = None) -> DataFrame:
    """One row: graphs in all three stages, and in each; typed or not, or of one class."""
    state = cat.state
    if work_class is not None:
        typed = cat.types.filter(F.col("class") == work_class).select("g")
        state = state.join(typed, "g", "left_semi")
    per_stage = state.filter(
        F.col("status").isin(*M.STAGES) & (F.col("g") != M.VOCAB_GRAPH)
    ).groupBy("status").agg(F.countDistinct("g").alias("n"))

    return per_stage.agg(
        F.expr("coalesce(sum(n), 0)").alias("n_all"),
        *[F.expr(f"coalesce(sum(n) filter (where status = '{stage}'), 0)").alias(name)
          for stage, name in ((M.NOT_MODIFIED, "n_not_modified"), (M.MODIFIED, "n_modified"),
                              (M.PUBLISHED, "n_published"))])


def _in_status(df: DataFrame, cat: Catalog, statuses: list[str]) -> DataFrame:
    keep = cat.state.filter(F.lower("status").isin(*statuses)).select("g")
    return df.join(keep, "g", "left_semi")


def count_records(cat: Catalog, work_class: str | None = None,
                  statuses: list[str] | None = None) -> DataFrame:
    """Number of graphs, typed or not, or of one class."""
    rows = (cat.state if work_class is None
            else cat.types.filter(F.col("class") == work_class))
    rows = rows.filter(F.col("g") != M.VOCAB_GRAPH)
    if statuses is not None:
        rows = _in_status(rows, cat, statuses)
    return rows.agg(F.countDistinct("g").alias("n_records"))


def explore(cat: Catalog, fields: DataFrame | None = None) -> DataFrame:
    """Per class: all records, published records, listed records.

    One grouped query instead of a query per template; `fields` adds the number
    of browse filters of the class's template.
    """
    state = cat.state.select("g", "status")
    out = (
        cat.types.filter(F.col("g") != M.VOCAB_GRAPH).join(state, "g", "left")
        .groupBy("class", "g")
        .agg(F.max(F.lower("status") == M.PUBLISHED).alias("published"),
             F.max(F.col("status") != M.NOT_MODIFIED).alias("listed"))
        .groupBy("class")
        .agg(F.count("*").alias("n_records"),
             F.count_if("published").alias("n_published"),
             F.count_if("listed").alias("n_listed"))
    )
    if fields is None:
        return out
    filters = browse_filters(fields).groupBy("class").agg(F.count("*").alias("n_filters"))
    return out.join(filters, "class", "left").withColumn(
        "n_filters", F.coalesce("n_filters", F.lit(0)))


def class_of(cat: Catalog, uris: DataFrame) -> DataFrame:
    """Class of each URI, '' when it has none, the least of several."""
    wanted = uris.select("uri").distinct()
    known = cat.types.groupBy(F.col("work").alias("uri")).agg(F.min("class").alias("class"))
    return wanted.join(known, "uri", "left").select(
        "uri", F.coalesce("class", F.lit("")).alias("class"))


def _labelled_links(cat: Catalog, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links, as `links` chooses them, with their labels.

    Where labels hold everywhere, those of people and those of the rest are written on their own: the
    values that many records share are few then, and Spark can send them to the links.
    """
    if "g" in cat.labels.columns:
        return links(cat.as_stated("links")).join(
            cat.link_labels(*M.VALUE_KINDS).withColumnRenamed("uri", "target"), ["target", "g"])

    def named(rows, *kinds):
        return links(rows).join(written(cat.labels_of(*kinds).distinct(), "labels").withColumnRenamed(
            "uri", "target"), "target")

    people = sorted(M.LABEL_KINDS)
    others = [role for role in M.VALUE_KINDS if role not in M.LABEL_KINDS.values()]
    return named(cat.links_of(*people), *sorted(set(M.LABEL_KINDS.values()))).unionByName(
        named(cat.links_of(*others), *others))


def _template_rows(cat: Catalog, fields: DataFrame, graphs: DataFrame | None) -> DataFrame:
    """(g, template, field_id, value, label, class, status) of `record_fields`, as often as stated.

    All that tells a record is dealt out by its graph once; there its state and the templates of its
    works are seen by all of its facts. Class and status are the least of the graph.
    """
    def chosen(df):
        return df if graphs is None else df.join(graphs.select("g").distinct(), "g", "left_semi")

    def part(df, name, value, label="null", prop="null", work="null"):
        return df.selectExpr("g", f"if(concat({work}, '/') = g, null, {work}) as other", f"'{name}' as part",
                             f"cast({prop} as string) as property", f"{value} as value",
                             f"cast({label} as string) as label")

    shape = fields.selectExpr("template", "field_id", "property", "value_kind = 'Literal' as is_text").unionByName(
        fields.selectExpr("template", "'keywords' as field_id", f"'{M.KEYWORDS}' as property", "false as is_text")
    ).filter("is_text is not null").distinct()
    # Fields of templates are few; dealt by property, most links would meet in a few tasks.
    shape = F.broadcast(shape)

    def used(df, texts):
        known = shape.filter("is_text" if texts else "not is_text").select("property")
        return chosen(df).filter("g is not null and work is not null").join(
            F.broadcast(known), "property", "left_semi")

    linked = _labelled_links(cat, lambda rows: used(rows, False).select("work", "g", "property", "target"))
    parts = [
        part(chosen(cat.state).filter("status is not null"), "state", "status"),
        part(chosen(cat.labelled("graph").withColumnRenamed("uri", "g")), "label", "cast(null as string)"),
        part(chosen(cat.as_stated("types")).filter("work is not null"), "type", "class", work="work"),
        part(used(cat.as_stated("literals"), True), "text", "value", prop="property", work="work"),
        part(linked, "link", "target", "label", "property", "work"),
    ]
    every = (W.unboundedPreceding, W.unboundedFollowing)
    # In the order of works, so that one sort serves both windows.
    graph = W.partitionBy("g").orderBy("other").rowsBetween(*every)
    work = W.partitionBy("g", "other").rowsBetween(*every)

    def of(name, x):
        return F.when(F.col("part") == name, F.expr(x))

    seen = (
        reduce(DataFrame.unionByName, parts).filter("g is not null")
        .select("*", F.min(of("state", "value")).over(graph).alias("status"),
                F.max(of("label", "true")).over(graph).alias("titled"),
                F.min(of("type", "value")).over(graph).alias("class"))
        .withColumn("templates", F.collect_set(of("type", terms.template_of("value"))).over(work))
        .filter("part in ('text', 'link') and status is not null and titled")
    )
    return (
        seen.withColumn("is_text", F.col("part") == "text").join(shape, ["property", "is_text"])
        .filter("array_contains(templates, template)")
        .select("g", "template", "field_id",
                F.expr(f"if(is_text, value, {terms.short_uri('value')})").alias("value"), "label", "class", "status")
    )


def record_fields(cat: Catalog, fields: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """Records rebuilt by template: (g, template, field_id, value, label).

    Distinct values per field in long form, so that no record has to fit in one
    array. URIs come with the label that the record's graph states, external ones
    shortened; a record needs a title and a status. Keywords come with every template.
    """
    return _template_rows(cat, fields, graphs).select(
        "g", "template", "field_id", "value", "label").distinct()


def record_view(cat: Catalog, fields: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """Record pages in long form: field labels, title, draft mark, class name."""
    rows = _template_rows(cat, fields, graphs)
    shape = fields.select("template", "field_id", F.col("label").alias("field"), "disambiguate",
                          "position")
    shape = shape.unionByName(fields.selectExpr(
        "template", "'keywords' as field_id", "'Keywords' as field", "false as disambiguate",
        "cast(null as int) as position").distinct())
    # Rows of a graph lie together already.
    first = F.min_by("value", F.when(F.col("disambiguate"), F.struct("position", "value"))).over(
        W.partitionBy("g"))
    return (
        rows.join(F.broadcast(shape), ["template", "field_id"]).withColumn("title", first)
        .selectExpr("g", "coalesce(title, 'No title') as title",
                    f"{terms.display_class('class')} as class_name",
                    "contains(status, 'modified') as is_draft",
                    "field", "value", "coalesce(label, value) as label")
        .distinct()
    )


def describe(quads: DataFrame, names: DataFrame, base: str = M.BASE) -> DataFrame:
    """Triples around each name as distinct (name, s, p, o, o_kind).

    If base+name is an object somewhere, its triples on either side. Otherwise
    those of the catalogue objects whose last segment is the name.
    """
    wanted = names.select("name").distinct()
    exact = wanted.select("name", F.concat(F.lit(base), F.col("name")).alias("uri"))
    objects = quads.filter(F.col("o_kind") == "uri").select(F.col("o").alias("uri")).distinct()
    found = exact.join(objects, "uri", "left_semi")
    ending = (
        objects.filter(F.col("uri").startswith(base))
        .selectExpr("*", f"{X.last_segment('uri')} as name")
        .join(exact.join(objects, "uri", "left_anti").select("name"), "name", "left_semi")
    )
    subjects = found.select("name", "uri").unionByName(ending.select("name", "uri"))
    triples = quads.select("s", "p", "o", "o_kind")
    as_subject = triples.join(subjects, F.col("s") == F.col("uri"))
    as_object = triples.filter("o_kind = 'uri'").join(subjects, F.col("o") == F.col("uri"))
    out = ["name", "s", "p", "o", "o_kind"]
    return as_subject.select(*out).unionByName(as_object.select(*out)).distinct()


def term_usage(quads: DataFrame, names: DataFrame, base: str = M.BASE) -> DataFrame:
    """Per name: described rows pointing at it, and their distinct subjects."""
    used = describe(quads, names, base).filter(
        (F.col("o_kind") == "uri") & F.contains("o", "name"))
    return used.groupBy("name").agg(F.count("*").alias("n_rows"),
                                    F.countDistinct("s").alias("n_subjects"))


def link_pairs(cat: Catalog, uris: DataFrame | None = None) -> DataFrame:
    """Distinct (uri, subject, label) of works that link to a URI, of all or of those named."""
    named = cat.labels_of("work").withColumnRenamed("uri", "subject")
    pairs = cat.links.select(F.col("target").alias("uri"), F.col("work").alias("subject")).filter(
        ~F.col("subject").endswith("/"))
    if uris is not None:
        pairs = pairs.join(uris.select("uri").distinct(), "uri", "left_semi")
    # The join deals out by subject; there equal pairs meet too.
    return pairs.join(named, "subject").distinct().select("uri", "subject", "label")


def back_links(cat: Catalog, uris: DataFrame, offset: int = 0,
               limit: int = M.BACK_LINK_PAGE) -> DataFrame:
    """A page of (uri, subject, label) linking to each URI, by subject.

    Pairs are made distinct before ranking, and Spark keeps only the first
    `offset + limit` of a key per task before it shuffles by URI.
    """
    pairs = link_pairs(cat, uris)
    order = W.partitionBy("uri").orderBy("subject", "label")
    return (pairs.withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= offset + limit).filter(F.col("rank") > offset)
            .select("uri", "rank", "subject", "label"))


def _labelled_in_graphs(links: DataFrame, labels: DataFrame, shown: DataFrame) -> DataFrame:
    """Each link of a shown graph that has labels there, once, with the least of them and their number `n`.

    Links, labels and shown graphs are dealt out by graph once, and met there.
    """
    own = "coalesce(concat(work, '/') = g, false)"
    parts = [
        links.selectExpr("g", "'link' as part", "target", "role", "property", f"{own} as own",
                         f"if({own}, null, work) as text"),
        labels.selectExpr("g", "'label' as part", "uri as target", "null as role", "null as property",
                          "false as own", "label as text"),
        shown.selectExpr("g", "'shown' as part", "null as target", "null as role", "null as property",
                         "false as own", "null as text"),
    ]
    once = reduce(DataFrame.unionByName, parts).filter("g is not null").repartition("g").distinct()
    every = (W.unboundedPreceding, W.unboundedFollowing)
    # In the order of targets, so that one sort serves both windows.
    graph = W.partitionBy("g").orderBy("target").rowsBetween(*every)
    value = W.partitionBy("g", "target").rowsBetween(*every)
    is_label = F.col("part") == "label"
    return (
        once.withColumn("shown", F.max(F.col("part") == "shown").over(graph))
        .select("*", F.min(F.when(is_label, F.col("text"))).over(value).alias("label"),
                F.count(F.when(is_label, F.col("text"))).over(value).alias("n"),
                F.max(is_label).over(value).alias("labelled"))
        .filter("part = 'link' and shown and labelled and target is not null")
        .selectExpr("g", "role", "property", "target", "if(own, left(g, length(g) - 1), text) as work", "label", "n")
    )


def facet_counts(cat: Catalog, roles: list[str], work_class: str | None = None) -> DataFrame:
    """Per (role, value): label, distinct subjects, and subject-label rows.

    Works at the first stage stay out. Labels that hold everywhere join after the
    counting, one row per value. Labels told per graph join by value and graph, and a
    subject counts with the labels of its own graph only.
    """
    per_graph = "g" in cat.labels.columns
    links = cat.as_stated("links").filter(F.col("role").isin(*roles)) if per_graph else cat.links_of(*roles)
    links = links.select("role", "property", "target", "work", "g")
    if work_class is not None:
        typed = cat.types.filter(F.col("class") == work_class).select("work")
        links = links.join(typed, "work", "left_semi")
    shown = cat.state.filter(F.col("status") != M.NOT_MODIFIED).select("g")
    kinds = sorted({M.LABEL_KINDS.get(r, r) for r in roles})
    order = ["property", F.col("n_subjects").desc(), F.lower("label"), "value"]
    if per_graph:
        return (_labelled_in_graphs(links, cat.link_labels(*kinds), shown)
                .groupBy("role", "property", "target", "work")
                .agg(F.min("label").alias("label"), F.sum("n").alias("n"))
                .groupBy("role", "property", F.col("target").alias("value"))
                .agg(F.min("label").alias("label"), F.count("*").alias("n_subjects"),
                     F.sum("n").alias("n_rows")).orderBy(*order))
    links = links.join(shown, "g", "left_semi")
    # One exchange serves the distinct graphs of a pair and their count.
    pairs = links.repartition("role", "property", "target", "work")
    counts = (
        pairs.groupBy("role", "property", "target", "work").agg(F.countDistinct("g").alias("n"))
        .groupBy("role", "property", F.col("target").alias("value"))
        .agg(F.count("*").alias("n_subjects"), F.sum("n").alias("n_triples"))
    )
    labels = cat.labels_of(*kinds).distinct().groupBy(F.col("uri").alias("value")).agg(
        F.min("label").alias("label"), F.count("*").alias("n_labels"))
    return counts.join(labels, "value").select(
        "role", "property", "value", "label", "n_subjects",
        (F.col("n_triples") * F.col("n_labels")).alias("n_rows"),
    ).orderBy(*order)


def records_by_facet(cat: Catalog, role: str, values: DataFrame | None = None,
                     work_class: str | None = None) -> DataFrame:
    """(value, work, label) of shown works per facet value; label the least."""
    links = cat.links_of(role).select("work", "g", F.col("target").alias("value"))
    if values is not None:
        links = links.join(values.select("value").distinct(), "value", "left_semi")
    if work_class is not None:
        typed = cat.types.filter(F.col("class") == work_class).select("work")
        links = links.join(typed, "work", "left_semi")
    shown = cat.state.filter(F.col("status") != M.NOT_MODIFIED).select("g")
    named = one_label(cat.labels_of("work")).withColumnRenamed("uri", "work")
    return (links.join(shown, "g", "left_semi").select("value", "work").distinct()
            .join(named, "work").select("value", "work", "label"))


def alpha_listing(cat: Catalog, work_class: str | None = None) -> DataFrame:
    """Shown records with the upper-case first letter of their title."""
    types = cat.types if work_class is None else cat.types.filter(F.col("class") == work_class)
    shown = cat.state.filter(F.coalesce(F.col("status"), F.lit("-")) != M.NOT_MODIFIED)
    titles = cat.labels_of("graph").select(F.col("uri").alias("g"), F.col("label").alias("title"))
    return (types.select("g", "class").join(shown.select("g"), "g", "left_semi")
            .join(titles, "g")
            .select("class", F.upper(F.substring("title", 1, 1)).alias("letter"), "g", "title")
            .distinct())


def alpha_index(cat: Catalog, work_class: str | None = None) -> DataFrame:
    """Letters of the listing with their record counts, sorted."""
    return (alpha_listing(cat, work_class).groupBy("class", "letter")
            .agg(F.countDistinct("g").alias("n_records")).orderBy("class", "letter"))


def browse_filters(fields: DataFrame) -> DataFrame:
    return fields.filter("browse or disambiguate").select(
        "template", "class", "property", "label", "field_type", "value_kind", "position")


def data_profile(cat: Catalog) -> DataFrame:
    """Per (class, property): works, distinct objects, fill rate, readable names.

    Facts are dealt out once, by work. There one row of each work and property is marked, so that works are
    counted by marks and only distinct values are dealt out again. The class totals join as a handful of rows.
    """
    facts = cat.links.select("work", "property", F.col("target").alias("value")).unionByName(
        cat.literals.select("work", "property", "value"))
    typed = facts.join(cat.types.select("work", "class"), "work")
    any_first = W.partitionBy("work", "class", "property").orderBy("property")
    values = typed.withColumn("nth", F.row_number().over(any_first)).groupBy("class", "property", "value").agg(
        F.count_if(F.col("nth") == 1).alias("n_works"))
    used = values.groupBy("class", "property").agg(
        F.sum("n_works").alias("n_works"), F.count("value").alias("n_values"))
    totals = cat.types.groupBy("class").agg(F.countDistinct("work").alias("n_class"))
    return used.join(totals, "class").selectExpr(
        "class", "property", f"{X.readable_name('class')} as class_name",
        f"{X.readable_name('property')} as property_name", "n_works", "n_values",
        "n_works / n_class as fill_rate")
