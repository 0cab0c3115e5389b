"""Every operator as a query over the analytics tables.

Each entry takes (spark, sf_dir) and runs over whole tables. Sample inputs such
as misspelt names or broken labels are expressions over those tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from stemma import model as M
from stemma.functions import terms, text as X
from stemma.operators import (analytics as A, browse as Q, lifecycle as L, resolve as E,
                              search as S, series, transform as T, validate as V)
from stemma.operators.ris import to_ris
from stemma.plans.catalog import Catalog, from_quads
from stemma.plans.durable import new_path, written
from stemma.sources import adapter, batch as batches, buckets, exports, nquads, pages, postings, templates
from stemma.streaming import imports, quota

CREATOR = "curator@example.org"
MOMENT = "2024-01-01T00:00:00"
CHART_NATIONS = [f"nation_{i}" for i in range(8)]
FACETS = ["author", "year", "language", "publisher", "container", "primary_subject", "subject"]
QUOTA = 5

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def on_catalog(name: str, op: Callable[..., DataFrame], *args, **kwargs) -> None:
    """Register an operator that needs the catalogue and constants only."""
    REGISTRY[name] = lambda spark, sf: op(adapter.catalog(spark, sf), *args, **kwargs)


# ---- counters, series, exports -------------------------------------------

on_catalog("counters", A.counters)
on_catalog("authors_per_year", A.authors_per_year)
on_catalog("publications_per_year", A.publications_per_year)
on_catalog("topics_per_year", A.topics_per_year)
on_catalog("publishers_per_year", A.publishers_per_year)
on_catalog("language_by_year", A.language_by_year)
on_catalog("language_chart", A.language_chart, CHART_NATIONS)
on_catalog("authors_per_year_label", A.authors_per_year, by="label")
on_catalog("export_wide", A.export_wide)
on_catalog("ris_export", to_ris)


@query
def sketched_counters(spark, sf):
    """Counters of three loads of the records from their stored sketches, against the exact ones.

    The sketches' standard error is 0.8 %; `close` says that all six are within 4 %.
    """
    cat = adapter.catalog(spark, sf)
    quads = written(cat.quads(), "loads")
    loads = [A.counter_sketches(from_quads(quads.filter(F.pmod(F.xxhash64("g"), F.lit(3)) == k))) for k in range(3)]
    stored = written(reduce(DataFrame.unionByName, loads), "sketches")
    both = A.counters(cat).withColumn("exact", F.lit(True)).unionByName(
        A.sketched_counters(stored).withColumn("exact", F.lit(False)))
    both = both.agg(*[F.max(F.when(F.col("exact"), F.col(c))).alias(c) for c in A.COUNTERS],
                    *[F.max(F.when(~F.col("exact"), F.col(c))).alias(f"about_{c}") for c in A.COUNTERS])
    close = " and ".join(f"abs(about_{c} - {c}) <= 0.04 * {c}" for c in A.COUNTERS)
    return both.selectExpr(*A.COUNTERS, f"{close} as close")


@query
def delta_series(spark, sf):
    """Yearly series after articles were replaced and reports deleted, from the changed records alone."""
    cat = adapter.catalog(spark, sf)
    quads = cat.quads()
    state = written(series.references(cat), "series")
    store = buckets.create(quads, new_path(spark, "buckets"), 64, once=True)
    new = _new_articles(cat, (M.PUBLICATION_DATE, f"'{M.VOCAB}1999'", "uri", None))
    after = buckets.upsert_records(store, new, M.PUBLISHED, CREATOR, MOMENT)
    state = written(series.apply_changes(state, series.changes(store.graphs(new), after.graphs(new))), "series")
    gone = _graphs(spark, sf, "o_orderpriority = '5-LOW'")
    none = after.graphs(gone).filter(F.lit(False))
    state = series.apply_changes(state, series.changes(after.graphs(gone), none))
    return series.counts(state)


@query
def csv_export(spark, sf):
    path = new_path(spark, "csv")
    exports.write_csv_export(adapter.catalog(spark, sf), path)
    return exports.csv_lines(spark, path)


@query
def citations_txt(spark, sf):
    return exports.citation_blocks(A.export_wide(adapter.catalog(spark, sf)))


@query
def chart_json(spark, sf):
    path = new_path(spark, "chart")
    exports.write_chart_json(A.publications_per_year(adapter.catalog(spark, sf)), path)
    return spark.read.text(path).select(F.col("value").alias("point"))


# ---- listings, facets, record pages --------------------------------------

on_catalog("records", Q.records)
on_catalog("records_page", Q.records_page, page=2)
on_catalog("records_page_published", Q.records_page, page=3, stage=M.PUBLISHED)
on_catalog("stage_counts", Q.stage_counts)
on_catalog("count_records", Q.count_records, statuses=[M.PUBLISHED])
on_catalog("facet_counts", Q.facet_counts, FACETS)
on_catalog("facet_counts_articles", Q.facet_counts, ["container", "year"], M.ARTICLE)
on_catalog("records_by_facet", Q.records_by_facet, "container")
on_catalog("alpha_index", Q.alpha_index)
on_catalog("alpha_listing", Q.alpha_listing)
on_catalog("data_profile", Q.data_profile)


@query
def explore(spark, sf):
    return Q.explore(adapter.catalog(spark, sf), templates.standard_templates(spark))


@query
def class_of(spark, sf):
    uris = adapter.table(spark, sf, "orders").select(
        F.expr(adapter.work_uri()).alias("uri")).unionByName(
        adapter.table(spark, sf, "supplier").select(
            F.expr(adapter.person_uri("s_suppkey")).alias("uri")))
    return Q.class_of(adapter.catalog(spark, sf), uris)


@query
def record_fields(spark, sf):
    return Q.record_fields(adapter.catalog(spark, sf), templates.standard_templates(spark))


@query
def record_view(spark, sf):
    return Q.record_view(adapter.catalog(spark, sf), templates.standard_templates(spark))


def _term_names(spark, sf):
    """All language terms (found by their last segment) and all people."""
    return adapter.table(spark, sf, "nation").select(F.lower("n_name").alias("name")).unionByName(
        adapter.table(spark, sf, "supplier").select(
            F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name")))


@query
def describe(spark, sf):
    quads = written(adapter.catalog(spark, sf).quads(), "describe")
    return Q.describe(quads, _term_names(spark, sf))


@query
def term_usage(spark, sf):
    quads = written(adapter.catalog(spark, sf).quads(), "usage")
    return Q.term_usage(quads, _term_names(spark, sf))


@query
def back_links(spark, sf):
    cat = adapter.catalog(spark, sf)
    return Q.back_links(cat, cat.labels_of("person"), offset=10)


@query
def stored_records_page(spark, sf):
    table = pages.build_records(adapter.catalog(spark, sf), new_path(spark, "pages"), 16)
    return table.page(2, listing="all").drop("listing")


@query
def stored_records_page_published(spark, sf):
    table = pages.build_records(adapter.catalog(spark, sf), new_path(spark, "pages"), 16)
    return table.page(3, listing=M.PUBLISHED).drop("listing")


@query
def stored_back_links(spark, sf):
    cat = adapter.catalog(spark, sf)
    table = pages.build_back_links(cat, new_path(spark, "pages"), 16)
    return table.pages(cat.labels_of("person"), 10, M.BACK_LINK_PAGE).select("uri", "rank", "subject", "label")


# ---- search --------------------------------------------------------------

on_catalog("search_title", S.search_title, "Red wid")
on_catalog("search_label", S.search_label, "000000012 Supplier", ["author"])
on_catalog("advanced_search", S.advanced_search, {
    "search_title": "re", "search_author": "supplier", "search_journal": "",
    "search_year-1": f"{M.VOCAB}1997,1997", "search_year-2": f"{M.VOCAB}1999,1999",
    "search_language-1": f"{M.VOCAB}nation_3,{M.VOCAB}nation_4,Nations 3, 4",
})


@query
def filter_checkbox(spark, sf):
    """One box that stands for the first two years of the catalogue."""
    years = adapter.table(spark, sf, "orders").agg(F.min(F.year("o_orderdate")).alias("y"))
    choices = years.select(F.concat(
        F.lit(M.VOCAB), F.col("y"), F.lit("," + M.VOCAB), F.col("y") + 1,
        F.lit(",From "), F.col("y"), F.lit(", and on")).alias("value"))
    return S.filter_checkbox(adapter.catalog(spark, sf), "year", choices)


def _typed_text(spark, sf):
    """Text as typed so far: unfinished title words and person names."""
    titles = adapter.table(spark, sf, "part").select(F.concat(
        F.substring_index("p_name", " ", 1), F.lit(" "),
        F.substring(F.substring_index("p_name", " ", -1), 1, 2)).alias("query"))
    people = adapter.table(spark, sf, "supplier").select(
        F.expr("substr(s_name, 1, length(s_name) - 1)").alias("query"))
    words = adapter.table(spark, sf, "part").select(
        F.substring("p_name", 1, 3).alias("query"))
    return titles.unionByName(people).unionByName(words).distinct()


@query
def suggest_topk(spark, sf):
    return S.suggest(adapter.catalog(spark, sf), _typed_text(spark, sf))


@query
def suggest_works(spark, sf):
    return S.suggest(adapter.catalog(spark, sf), _typed_text(spark, sf), 10, 0.3, True)


@query
def prior_records(spark, sf):
    titles = adapter.table(spark, sf, "part").select(F.col("p_name").alias("query"))
    return S.prior_records(adapter.catalog(spark, sf), titles, M.ARTICLE)


def _index(spark, cat) -> postings.Postings:
    """All labels stored as postings in two batches, people in the second."""
    labels = postings.catalog_labels(cat)
    index = postings.build(labels.filter("kind <> 'person'"), new_path(spark, "postings"), 16)
    index.add(labels.filter("kind = 'person'"), 1)
    return index


@query
def stored_suggest_topk(spark, sf):
    return postings.suggest(_index(spark, adapter.catalog(spark, sf)), _typed_text(spark, sf))


@query
def stored_prior_records(spark, sf):
    cat = adapter.catalog(spark, sf)
    titles = adapter.table(spark, sf, "part").select(F.col("p_name").alias("query"))
    return postings.prior_records(_index(spark, cat), titles, cat.types, M.ARTICLE)


@query
def stored_search_title(spark, sf):
    return postings.search_title(_index(spark, adapter.catalog(spark, sf)), "red wid")


@query
def stored_search_label(spark, sf):
    cat = adapter.catalog(spark, sf)
    return postings.search_label(_index(spark, cat), cat, "Supplier#000000012", ["author"])


@query
def stored_label_search(spark, sf):
    """Benchmark passages and site names looked up in a stored index of all documents."""
    docs = adapter.table(spark, sf, "documents").selectExpr(
        "cast(doc_id as string) as uri", "text as label", "'document' as kind").filter("label is not null")
    index = postings.build(docs, new_path(spark, "postings"), 16)
    asked = adapter.table(spark, sf, "benchmark").select(F.col("text").alias("query")).unionByName(
        _site_names(spark, sf).select(F.col("label").alias("query")))
    return index.search(asked).select("query", "uri", "score")


def _site_names(spark, sf):
    return adapter.table(spark, sf, "pages").select(F.regexp_extract(
        "url", r"//(?:[a-z]+\.)?([a-z]+)\.example\.", 1).alias("label")).filter(
        "label <> ''").distinct()


@query
def label_search_batch(spark, sf):
    """Benchmark passages and site names looked up in all documents."""
    docs = adapter.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("uri"), F.col("text").alias("label"))
    asked = adapter.table(spark, sf, "benchmark").select(F.col("text").alias("query")).unionByName(
        _site_names(spark, sf).select(F.col("label").alias("query")))
    return S.label_search(asked, docs, long_texts=True)


@query
def mention_links(spark, sf):
    """Titles and people named inside citations."""
    cat = adapter.catalog(spark, sf)
    texts = cat.literal(M.REFERENCED_BY).select(F.col("work").alias("doc"),
                                                F.col("value").alias("text"))
    return S.link_mentions(texts, cat.labels_of("container", "user"))


@query
def mention_links_documents(spark, sf):
    docs = adapter.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    sites = _site_names(spark, sf).select(
        F.concat(F.lit(M.BASE + "site-"), F.col("label")).alias("uri"), "label")
    return S.link_mentions(docs, sites)


# ---- validation and cleaning ---------------------------------------------

@query
def vocab_violations(spark, sf):
    rows = adapter.batch(spark, sf)
    years = adapter.table(spark, sf, "orders").select(
        F.expr(adapter.YEAR).alias("label")).distinct()
    segments = adapter.table(spark, sf, "customer").select(
        F.replace("c_mktsegment", F.lit("U"), F.lit("-")).alias("label")).distinct()
    return (V.check_vocabulary(rows, "lang", V.vocabulary(rows, M.LANGUAGES))
            .unionByName(V.check_vocabulary(rows, "publication type",
                                            V.vocabulary(rows, M.PUBLICATION_TYPES), lower=True))
            .unionByName(V.check_vocabulary(rows, "year", years))
            .unionByName(V.check_vocabulary(rows, "publisher", segments, True, True)))


PEOPLE = [f"{w}_{k}" for w in ("author", "editor") for k in range(1, 11)]


@query
def unique_values(spark, sf):
    return V.unique_values(adapter.batch(spark, sf), PEOPLE)


@query
def name_variants(spark, sf):
    lines = adapter.table(spark, sf, "lineitem").join(
        adapter.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    name = (F.when(F.col("l_quantity") == 1, F.lit(" - "))
            .when(F.col("l_linenumber") == 7, F.concat("s_name", F.lit(" & Co")))
            .when(F.col("l_linestatus") == "O", F.replace("s_name", F.lit("#"), F.lit(". ")))
            .otherwise(F.col("s_name")))
    return V.name_variants(lines.select(name.alias("name")))


@query
def similar_names(spark, sf):
    """Names of documents, their first two words, and the same with a letter less or a title."""
    docs = adapter.table(spark, sf, "documents").selectExpr(
        "doc_id", "regexp_extract(lower(text), '^([a-z]{4,20} [a-z]{4,20}) ', 1) as name").filter("name <> ''")
    spelled = docs.selectExpr("case doc_id % 4 when 1 then substr(name, 2) when 2 then 'Dr. ' || name "
                              "else name end as name").unionByName(docs.select("name"))
    return V.similar_names(spelled, percent=75)


@query
def drop_existing(spark, sf):
    rows = adapter.batch(spark, sf).withColumn(
        "title", F.regexp_replace("title", " [0-9]+$", ""))
    known = V.duplicate_keys(adapter.catalog(spark, sf))
    return V.drop_existing(rows, known).select("id", "author_1", "title", "year")


def _untidy_labels(spark, sf):
    return adapter.table(spark, sf, "lineitem").join(
        adapter.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.expr(adapter.person_uri("l_suppkey")).alias("uri"),
        F.concat("s_name", F.when(F.col("l_linenumber") % 2 == 0, F.lit("; ; ;  ;"))
                 .otherwise(F.lit("; ")), F.lit("B"), F.col("l_linenumber").cast("string"))
        .alias("label")).distinct()


@query
def broken_labels(spark, sf):
    return V.find_broken_labels(_untidy_labels(spark, sf))


@query
def repair_labels(spark, sf):
    return V.repair_labels(_untidy_labels(spark, sf))


@query
def label_update(spark, sf):
    """Published records carry a broken citation on graph and entity, modified
    ones on the graph only; just the former may change."""
    quads = written(adapter.catalog(spark, sf).quads(), "quads")
    stage = adapter.table(spark, sf, "orders").select(
        F.expr(adapter.graph_uri()).alias("g"), "o_orderstatus")
    on_graph = (F.col("p") == M.RDFS_LABEL) & (F.col("s") == F.col("g"))
    on_work = F.col("p") == M.REFERENCED_BY
    hurt = ((on_graph & F.col("o_orderstatus").isin("F", "O"))
            | (on_work & (F.col("o_orderstatus") == "F")))
    # Only labels and citations meet the stages; all other quads stay where they are.
    told = quads.filter(on_graph | on_work).join(stage, "g").withColumn(
        "o", F.when(hurt, F.replace("o", F.lit(". "), F.lit("; ; "))).otherwise(F.col("o")))
    told = written(told.select(*M.QUAD_COLUMNS), "labels")
    broken = quads.filter(~(on_graph | on_work)).select(*M.QUAD_COLUMNS).unionByName(told)
    labels = broken.filter(on_graph).select("g", F.col("o").alias("label"))
    fixes = V.repair_labels(labels).select("g", "repaired")
    return V.apply_label_update(broken, fixes).filter(on_graph | on_work).select("s", "p", "o", "g")


@query
def norm_year(spark, sf):
    return adapter.batch(spark, sf).selectExpr(
        "year as raw", f"{X.norm_year('year')} as year").distinct()


@query
def norm_doi(spark, sf):
    """Cells as they are, and every third one behind each of two other addresses."""
    cells = adapter.batch(spark, sf).selectExpr("id", f"""case cast(substr(id, 2) as bigint) % 3
        when 0 then 'http://doi.org/' || {X.norm_doi('doi')} when 1 then 'https://dx.doi.org/' || {X.norm_doi('doi')}
        else doi end as doi""")
    return cells.selectExpr(
        "id", f"{X.norm_doi('doi')} as doi", f"{X.norm_doi('doi', True)} as as_written")


@query
def norm_link(spark, sf):
    return adapter.batch(spark, sf).selectExpr("id", f"{X.norm_link('link')} as link")


@query
def norm_title(spark, sf):
    return adapter.batch(spark, sf).selectExpr("id", f"{X.norm_title('title')} as title")


@query
def norm_pages(spark, sf):
    return adapter.batch(spark, sf).selectExpr(
        "id", *[f"{X.norm_number(c)} as {c}" for c in ("volume", "issue", "pages")],
        f"{X.norm_number('issue', True)} as issue_as_written")


@query
def split_themes(spark, sf):
    themes = ", ".join(X.split_themes(c) for c in ("main_theme", "secondary_theme"))
    return adapter.batch(spark, sf).selectExpr("id", f"explode(concat({themes})) as theme")


# ---- entities ------------------------------------------------------------

on_catalog("people", E.people)
on_catalog("journals", E.journals)
on_catalog("publishers", E.publishers)
on_catalog("books", E.books)
on_catalog("entities", E.entities)


def _matched(spark, sf, batch=None):
    names = E.batch_names(adapter.batch(spark, sf) if batch is None else batch)
    return E.match_entities(names, E.entities(adapter.catalog(spark, sf)))


@query
def match_entities(spark, sf):
    return _matched(spark, sf)


@query
def mint_uris(spark, sf):
    return E.mint_uris(_matched(spark, sf))


@query
def vocab_uri(spark, sf):
    nations = adapter.table(spark, sf, "nation").select("n_name")
    labels = nations.select(F.col("n_name").alias("label")).unionByName(
        nations.select(F.concat(F.lit("Higher Education in "), F.col("n_name")).alias("label"))
    ).unionByName(adapter.table(spark, sf, "part").select(
        F.concat_ws(" ", "p_brand", "p_name").alias("label")).distinct())
    return labels.selectExpr("label", f"{terms.vocab_uri('label')} as uri")


@query
def work_class(spark, sf):
    return adapter.batch(spark, sf).selectExpr(
        "`publication type` as kind", f"{terms.work_class('`publication type`')} as class"
    ).groupBy("kind", "class").agg(F.count("*").alias("n_rows"))


@query
def class_to_template(spark, sf):
    template = terms.template_of(terms.work_class("`publication type`"))
    return adapter.batch(spark, sf).groupBy(F.expr(template).alias("template")).agg(
        F.count("*").alias("n_rows"))


def _identifiers(spark, sf):
    key = F.col("c_custkey").cast("string")
    customers = adapter.table(spark, sf, "customer")
    parts = [customers.select(F.concat(F.lit("Q"), key).alias("value")),
             customers.select(key.alias("value")),
             customers.select(F.concat(F.lit("c"), key).alias("value")),
             adapter.table(spark, sf, "pages").select(F.col("url").alias("value"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def uri_base(spark, sf):
    return _identifiers(spark, sf).selectExpr(
        "value", f"concat({terms.uri_base('value')}, value) as uri")


@query
def short_uri(spark, sf):
    return _identifiers(spark, sf).selectExpr(
        f"concat({terms.uri_base('value')}, value) as uri").selectExpr(
        "uri", f"{terms.short_uri('uri')} as short")


@query
def user_codec(spark, sf):
    users = adapter.table(spark, sf, "customer").selectExpr(
        "replace(lower(c_name), '#', '.') || '@example.org' as user")
    return users.selectExpr(
        "user", f"{X.encode_user('user')} as encoded",
        f"{X.decode_user(X.encode_user('user'))} as decoded")


# ---- rows to quads -------------------------------------------------------

def _rows(spark, sf):
    return T.clean_rows(adapter.batch(spark, sf), "id")


def _stored_batch(spark, sf):
    """The spreadsheet as a file, as it would arrive; it is read twice."""
    return written(adapter.batch(spark, sf), "batch")


def _resolved(spark, sf):
    batch = _stored_batch(spark, sf)
    return T.resolve_slots(T.name_slots(T.clean_rows(batch, "id")), _matched(spark, sf, batch))


@query
def rows_to_quads(spark, sf):
    batch = _stored_batch(spark, sf)
    return T.rows_to_quads(batch, _matched(spark, sf, batch), CREATOR, MOMENT, "id")


for _name, _op in (("row_authors", T.row_authors), ("row_editors", T.row_editors),
                   ("container", T.row_container), ("row_publisher", T.row_publisher)):
    REGISTRY[_name] = lambda spark, sf, op=_op: op(_resolved(spark, sf)).distinct()
for _name, _op in (("et_al", T.row_et_al), ("row_subjects", T.row_subjects),
                   ("row_language", T.row_language), ("row_scalars", T.row_scalars)):
    REGISTRY[_name] = lambda spark, sf, op=_op: op(_rows(spark, sf)).distinct()


@query
def row_provenance(spark, sf):
    return T.row_provenance(_rows(spark, sf), CREATOR, MOMENT).distinct()


@query
def citation(spark, sf):
    return _rows(spark, sf).select("work", "citation")


@query
def form_quads(spark, sf):
    """Orders handed in as forms; stored creators are kept on later stages."""
    years = ", ".join(f"'{M.VOCAB}{y}', '{y}'" for y in range(1990, 2011))
    fields = templates.standard_templates(spark).selectExpr(
        "*", f"if(property = '{M.PUBLICATION_DATE}', map({years}), null) as values")
    cat = adapter.catalog(spark, sf)
    orders = adapter.table(spark, sf, "orders").join(
        adapter.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    template = terms.template_of(terms.choose(adapter.PRIORITY, adapter.CLASS_BY_PRIORITY))
    year_field = terms.choose("template", {
        row[0]: row[2] for row in M.standard_fields() if row[4] == M.PUBLICATION_DATE})
    submissions = orders.selectExpr(
        "*", f"{template} as template", "concat('Q', o_custkey) as author_id").selectExpr(
        "concat('o', o_orderkey) as record_id", "template",
        f"{terms.choose('o_orderstatus', adapter.STAGE_BY_STATUS)} as stage",
        "concat('u', o_custkey, '@example.org') as user",
        f"""map(
            concat(template, if(template = 'book', '-02', '-01')), concat('Cited ', o_orderkey),
            concat(template, if(template = 'book', '-01', '-02')),
              concat('Title\\n', o_orderkey),
            concat(template, '-03-', author_id),
              concat(' ', author_id, ',', replace(c_name, '#', '%23')),
            {year_field}, concat('{M.VOCAB}', year(o_orderdate)),
            'keywords-k1', concat(o_orderkey, ',Place%20', o_orderkey)) as fields""")
    creators = cat.state.select("g", "creator").join(
        cat.labels_of("user").select(F.col("uri").alias("creator"),
                                     F.col("label").alias("creator_label")), "creator")
    return T.form_to_quads(submissions, fields, creators, MOMENT)


# ---- life cycle ----------------------------------------------------------

def _graphs(spark, sf, condition):
    return adapter.table(spark, sf, "orders").filter(condition).select(
        F.expr(adapter.graph_uri()).alias("g"))


@query
def load_graph(spark, sf):
    """All quads loaded again together with one new label per graph."""
    quads = written(adapter.catalog(spark, sf).quads(), "load")
    new = quads.filter(F.col("p") == M.RDF_TYPE).withColumn("p", F.lit(M.RDFS_LABEL)).withColumn(
        "o", F.lit("again")).withColumn("o_kind", F.lit("literal"))
    return L.load_graph(L.load_graph(quads, quads), new)


@query
def clear_graphs(spark, sf):
    return L.clear_graphs(
        adapter.catalog(spark, sf).quads(), _graphs(spark, sf, "o_orderstatus = 'P'"))


@query
def delete_records(spark, sf):
    return L.delete_records(
        adapter.catalog(spark, sf).quads(), _graphs(spark, sf, "o_orderpriority = '5-LOW'"))


@query
def record_creators(spark, sf):
    return L.record_creators(adapter.catalog(spark, sf).quads())


def _new_articles(cat, *facts):
    """A class and a new title for each article, and other (p, o, o_type) expressions."""
    typed = cat.types.filter(F.col("class") == M.ARTICLE)
    told = [(M.RDF_TYPE, "class", "uri", None), (M.DCT_TITLE, "concat('New ', work)", "literal", None), *facts]
    return typed.select(F.col("work").alias("s"), "g", F.inline(F.array(*[
        F.struct(F.lit(p).alias("p"), F.expr(o).alias("o"), F.lit(kind).alias("o_kind"),
                 F.lit(o_type).cast("string").alias("o_type")) for p, o, kind, o_type in told])))


@query
def upsert_records(spark, sf):
    """Articles published again with new content; all quads afterwards."""
    cat = adapter.catalog(spark, sf)
    quads = written(cat.quads(), "upsert")
    return L.upsert_records(quads, _new_articles(cat), M.PUBLISHED, CREATOR, MOMENT)


@query
def bucket_upserts(spark, sf):
    """The same on stored buckets: all quads of the new version."""
    cat = adapter.catalog(spark, sf)
    store = buckets.create(cat.quads(), new_path(spark, "buckets"), 64, once=True)
    return buckets.upsert_records(store, _new_articles(cat), M.PUBLISHED, CREATOR, MOMENT).quads()


@query
def bucket_deletes(spark, sf):
    """Reports deleted from stored buckets, then drafts cleared."""
    store = buckets.create(adapter.catalog(spark, sf).quads(), new_path(spark, "buckets"), 64, once=True)
    store = buckets.delete_records(store, _graphs(spark, sf, "o_orderpriority = '5-LOW'"))
    return buckets.clear_graphs(store, _graphs(spark, sf, "o_orderstatus = 'P'")).quads()


@query
def import_upserts(spark, sf):
    """Records streamed into stored buckets: all, earlier versions of all, later versions of articles.

    The three come mixed, and some twice; the last version of each stays.
    """
    folder = new_path(spark, "upserts")
    cat = adapter.catalog(spark, sf)
    quads = cat.quads()
    later = _new_articles(cat)
    moments = [(quads, None), (later, "2030-01-01T00:00:00"), (quads, "1900-01-01T00:00:00"), (later, "2030-01-01T00:00:00")]
    for k, (rows, moment) in enumerate(moments):
        rows = rows.select(*M.QUAD_COLUMNS)
        if moment:
            rows = rows.filter(F.col("p") != M.GENERATED_AT).unionByName(T.quad_facts(rows.select("g").distinct(), [
                T.quad_fact("g", M.GENERATED_AT, f"'{moment}'", o_type=M.XSD_DATETIME)]))
        # Each record stands in one file as a whole.
        nquads.nquads_lines(rows.repartition(4, "g")).write.mode("append").text(f"{folder}/inbox")
    buckets.create(spark.createDataFrame([], M.QUAD), f"{folder}/store", 64)
    imports.run_upserts(spark, f"{folder}/inbox", f"{folder}/store", f"{folder}/checkpoint",
                        files_per_batch=6).awaitTermination()
    return buckets.current(spark, f"{folder}/store").quads().filter(F.col("g") != M.VOCAB_GRAPH)


@query
def nquads_lines(spark, sf):
    """The dump written, read back and shown as lines again."""
    path = new_path(spark, "lines")
    nquads.write_nquads(adapter.catalog(spark, sf).quads(), path)
    return nquads.nquads_lines(nquads.read_nquads(spark, path))


@query
def read_records(spark, sf):
    """The dump read as files of records, whose names give the graphs."""
    path = new_path(spark, "records")
    nquads.write_nquads(adapter.catalog(spark, sf).quads(), path)
    return nquads.read_records(spark, path).select(
        "s", "p", "o", "o_kind", "o_type", F.col("g").rlike(f"^{M.BASE}part-[^/]+/$").alias("by_file"))


@query
def import_stream(spark, sf):
    """The dump sent in twice through the import stream."""
    folder = new_path(spark, "import")
    lines = nquads.nquads_lines(adapter.catalog(spark, sf).quads())
    nquads.write_lines(lines.unionByName(lines), f"{folder}/inbox")
    imports.run_import(spark, f"{folder}/inbox", f"{folder}/quads",
                       f"{folder}/checkpoint").awaitTermination()
    return imports.imported(spark, f"{folder}/quads")


# ---- the catalogue out of a dump -----------------------------------------

def _dump(spark, sf) -> Catalog:
    """Quads written as N-Quads and read back, with a keyword for each record.

    Records of one customer share the keyword, and each graph has its own label for it.
    """
    words = T.quad_facts(adapter.table(spark, sf, "orders").selectExpr(
        f"{adapter.work_uri()} as work", f"{adapter.graph_uri()} as g",
        f"concat('{M.BASE}k', o_custkey) as word", "concat('Keyword ', o_orderkey) as name"), [
        T.quad_fact("work", M.KEYWORDS, "word", "uri"),
        T.quad_fact("word", M.RDFS_LABEL, "name", "literal", M.XSD_STRING)])
    path = new_path(spark, "dump")
    nquads.write_nquads(adapter.catalog(spark, sf).quads().unionByName(words), path)
    return from_quads(written(nquads.read_nquads(spark, path), "dump-quads"))


def on_dump(name: str, op: Callable[..., DataFrame], *args, **kwargs) -> None:
    REGISTRY[f"dump_{name}"] = lambda spark, sf: op(_dump(spark, sf), *args, **kwargs)


on_dump("counters", A.counters)
on_dump("export_wide", A.export_wide)
on_dump("records", Q.records)
on_dump("stage_counts", Q.stage_counts)
on_dump("facet_counts", Q.facet_counts, FACETS)
on_dump("facet_counts_keywords", Q.facet_counts, ["keyword"])


@query
def dump_record_fields(spark, sf):
    return Q.record_fields(_dump(spark, sf), templates.standard_templates(spark))


@query
def nquads_documents(spark, sf):
    """All texts as literals of a file, read back."""
    path = new_path(spark, "texts")
    nquads.write_nquads(adapter.table(spark, sf, "documents").filter("text is not null").selectExpr(
        f"concat('{M.BASE}d', doc_id) as s", f"'{M.DCT_TITLE}' as p", "text as o",
        "'literal' as o_kind", "if(lang is null, null, concat('@', lang)) as o_type",
        f"'{M.BASE}texts/' as g"), path)
    return nquads.read_nquads(spark, path).selectExpr(
        f"cast(substr(s, {len(M.BASE) + 2}) as bigint) as doc_id", "substr(o_type, 2) as lang",
        "sha2(o, 256) as text_sha256", "char_length(o) as n_chars")


@query
def scalar_keys(spark, sf):
    """Identifiers, number test, moments and upper case of order cells."""
    return adapter.table(spark, sf, "orders").selectExpr(
        "o_orderkey", f"{X.to_id('o_orderpriority')} as id", "upper(o_orderstatus) as status",
        f"{X.is_number('cast(o_custkey as string)')} as is_number",
        f"{X.is_number('o_orderpriority')} as priority_is_number",
        "date_format(" + X.parse_moment(
            "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") || '.25'")
        + ", 'yyyy-MM-dd HH:mm:ss') as moment")


# ---- files in ------------------------------------------------------------

@query
def read_batch(spark, sf):
    """The spreadsheet written with capital headers and read as a batch."""
    path = new_path(spark, "sheet")
    rows = adapter.batch(spark, sf).withColumn("Unnamed: 36", F.lit("x"))
    rows.toDF(*[c if c.startswith("Unnamed") else c.upper() for c in rows.columns]).write.csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False)
    return batches.read_batch(spark, path)


@query
def check_columns(spark, sf):
    """A sheet that has a column for each region besides accepted ones."""
    sheet = (adapter.table(spark, sf, "region").selectExpr("r_name", "'Book' as `Publication Type`")
             .groupBy("Publication Type").pivot("r_name").count())
    return V.check_columns(sheet)


@query
def missing_cells(spark, sf):
    """Blank cells and the missing-value word in several spellings, padded."""
    return adapter.table(spark, sf, "orders").selectExpr(
        "o_orderkey", "case o_custkey % 4 when 0 then ' nan ' when 1 then ' \t' when 2 then 'NaN' "
        "else concat(' ', o_orderpriority, ' ') end as raw").selectExpr(
        "o_orderkey", f"{X.cell('raw')} as value")


def _template_files(spark, sf):
    """A template file per region with a field per nation, and the list that names the files.

    Customers of a nation are the choices of its field.
    """
    folder = new_path(spark, "templates")
    choices = adapter.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.expr(
        f"map_from_entries(collect_list(struct('{M.BASE}c' || c_custkey, c_name))) as values"))
    nations = (adapter.table(spark, sf, "nation")
               .join(adapter.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
               .join(choices, F.col("n_nationkey") == F.col("c_nationkey"), "left"))
    fields = nations.selectExpr("r_name", "n_nationkey", f"""struct(
        r_name || '-' || n_nationkey as id, n_name as label, 'Dropdown' as type, 'URI' as value,
        '{M.VOCAB}' || lower(n_name) as property, if(n_nationkey % 2 = 0, 'True', 'False') as browse,
        if(n_nationkey % 3 = 0, 'True', 'False') as disambiguate, values) as field""")
    (fields.groupBy("r_name").agg(F.expr(
        "to_json(transform(sort_array(collect_list(n_nationkey)), k -> "
        "map_from_entries(collect_list(struct(n_nationkey, field)))[k])) as value"))
     .select("value").write.option("maxRecordsPerFile", 1).text(f"{folder}/fields"))
    name = F.substring_index(F.get_json_object("value", "$[0].id"), "-", 1)
    (spark.read.text(f"{folder}/fields", wholetext=True).select(
        name.alias("name"), name.alias("short_name"), F.concat(F.lit(M.BASE), F.lower(name)).alias("type"),
        F.concat(F.lit("some/folder/"), "_metadata.file_name").alias("template"))
     .write.option("maxRecordsPerFile", 1).json(f"{folder}/list"))
    return templates.read_templates(spark, f"{folder}/list", f"{folder}/fields")


@query
def read_templates(spark, sf):
    return _template_files(spark, sf).drop("status").withColumn("values", F.size("values"))


@query
def import_vocabs(spark, sf):
    return templates.vocabulary_quads(_template_files(spark, sf))


@query
def browse_filters(spark, sf):
    return Q.browse_filters(_template_files(spark, sf))


@query
def read_authority(spark, sf):
    """Publisher names and people in a two-column list with blanks and repeats."""
    path = new_path(spark, "names")
    customers = adapter.table(spark, sf, "customer").selectExpr(
        "c_mktsegment || ', Ltd' as `Publishers\n\"all\"`",
        "if(c_custkey % 2 = 0, ' ' || c_name, '') as People", "c_acctbal as note")
    customers.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False)
    return batches.read_authority(spark, path, ["publishers", "people"])


# ---- quotas --------------------------------------------------------------

@query
def daily_quota(spark, sf):
    return quota.daily_quota(adapter.table(spark, sf, "events"), QUOTA, "user_id")


@query
def request_verdicts(spark, sf):
    """Each event judged by its client's purchases and sign-ups of the day so far."""
    events = adapter.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    return quota.request_verdicts(events, 3, "user_id", "event_type in ('purchase', 'signup')", ("ts", "event_id"), 16)


@query
def daily_quota_stream(spark, sf):
    """The event file read as a stream; the last update of each client and day."""
    schema = adapter.table(spark, sf, "events").schema
    log = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
           .parquet(sf))
    out = new_path(spark, "quota")
    quota.run_quota(log, f"{out}/counts", f"{out}/checkpoint", QUOTA, "user_id").awaitTermination()
    updates = spark.read.option("basePath", f"{out}/counts").parquet(f"{out}/counts/batch=*")
    return quota.latest_counts(updates)


@query
def quota_log(spark, sf):
    """Events as request-log lines, parsed and counted."""
    lines = adapter.table(spark, sf, "events").selectExpr(
        "concat(cast(ts as string), ' --- ', user_id, ' --- ', event_type) as value")
    return quota.daily_quota(quota.parse_log(lines), QUOTA)
