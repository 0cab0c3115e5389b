"""Token search over titles and entity labels, suggestions, mention linking.

A query matches a label that contains all its tokens; where a query is being
typed its last token is a prefix. Relevance is the number of distinct label
tokens hit by the query divided by the number of distinct label tokens.

Many queries at once go through an inverted index. Each query is driven by its
rarest full token, its other tokens are checked on the candidate, so a common
word never multiplies rows unless it is all there is.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F, Window as W

from stemma import model as M
from stemma.functions import text as X
from stemma.plans.catalog import Catalog
from stemma.plans.durable import written
from stemma.plans.skew import BLOCKS, blocked_join


# ---- one query -----------------------------------------------------------

def _query_tokens(query: str) -> str:
    words = re.findall(r"[^\W_]+", query.lower())
    return "cast(array({}) as array<string>)".format(", ".join(f"'{w}'" for w in words))


def has_all_tokens(toks: str, query: str, last_prefix: bool) -> str:
    """True when every query token is a text token (the last may be a prefix)."""
    if not last_prefix:
        return f"size({query}) > 0 and size(array_except({query}, {toks})) = 0"
    full = f"slice({query}, 1, greatest(size({query}) - 1, 0))"
    return (f"size({query}) > 0 and size(array_except({full}, {toks})) = 0 "
            f"and exists({toks}, t -> startswith(t, try_element_at({query}, -1)))")


def relevance(toks: str, query: str, last_prefix: bool, total: str | None = None) -> str:
    """Share of distinct text tokens that the query hits.

    `toks` are distinct; `total` is their number where `toks` is a part of them.
    """
    hit = f"array_intersect({toks}, {query})"
    if last_prefix:
        hit = (f"filter({toks}, t -> array_contains({query}, t) "
               f"or startswith(t, try_element_at({query}, -1)))")
    return f"size({hit}) / {total or f'size({toks})'}"


def search_title(cat: Catalog, query: str) -> DataFrame:
    """(work, title) of titles with all tokens, the last one as a prefix."""
    titles = cat.literal(M.DCT_TITLE).selectExpr(
        "work", "value as title", f"{X.tokens('value')} as toks")
    hit = has_all_tokens("toks", _query_tokens(query), True)
    return titles.filter(hit).select("work", "title").distinct()


def search_label(cat: Catalog, query: str, roles: list[str],
                 min_relevance: float = 0.5) -> DataFrame:
    """(work, label) of works linking by `roles` to a label with all tokens."""
    kinds = sorted({M.LABEL_KINDS.get(r, r) for r in roles})
    q = _query_tokens(query)
    hits = cat.labels_of(*kinds).selectExpr(
        "uri", "label", f"array_distinct({X.tokens('label')}) as toks").filter(
        f"{has_all_tokens('toks', q, False)} and "
        f"{relevance('toks', q, False)} >= {min_relevance}").select("uri", "label").distinct()
    return (cat.links_of(*roles).select("work", F.col("target").alias("uri"))
            .join(hits, "uri").select("work", "label").distinct())


def checkbox_uris(value: str) -> str:
    """URIs of a submitted choice 'uri,uri,…,label'; ', ' belongs to the label."""
    parts = f"split({value}, r',(?!\\s)')"
    return f"slice({parts}, 1, greatest(size({parts}) - 1, 0))"


def filter_checkbox(cat: Catalog, role: str, choices: DataFrame) -> DataFrame:
    """Works linked by `role` to any URI of the choices (column value)."""
    uris = choices.selectExpr(f"explode({checkbox_uris('value')}) as target").distinct()
    return cat.links_of(role).join(uris, "target", "left_semi").select("work").distinct()


# Form field, kind of input, roles searched (none: the title).
SEARCH_FIELDS = {
    "search_title": ("Textbox", []),
    "search_author": ("Textbox", ["author"]),
    "search_journal": ("Textbox", ["container"]),
    "search_publisher": ("Textbox", ["publisher"]),
    "search_year": ("Checkbox", ["year"]),
    "search_subject": ("Checkbox", ["primary_subject"]),
    "search_language": ("Checkbox", ["language"]),
}


def _field(name: str) -> str:
    return next(f for f in SEARCH_FIELDS if f in name)


def advanced_search(cat: Catalog, criteria: dict[str, str]) -> DataFrame:
    """Works meeting all fields: (worktype, citation, year, workid, doi).

    Empty criteria count for nothing; ticked boxes of one field are
    alternatives. Each field is a semi join, so a work appears once per class,
    citation, year and DOI whatever matched it.
    """
    spark = cat.types.sparkSession
    ticked: dict[str, list[str]] = {}
    works = None

    def narrow(found: DataFrame):
        nonlocal works
        found = found.select("work").distinct()
        works = found if works is None else works.join(found, "work", "left_semi")

    for name, value in criteria.items():
        if not value:
            continue
        kind, roles = SEARCH_FIELDS[_field(name)]
        if kind == "Checkbox":
            ticked.setdefault(_field(name), []).append(value)
        elif roles:
            narrow(search_label(cat, value, roles))
        else:
            narrow(search_title(cat, value))
    for name, values in ticked.items():
        choices = spark.createDataFrame([(v,) for v in values], "value string")
        narrow(filter_checkbox(cat, SEARCH_FIELDS[name][1][0], choices))

    rows = cat.types.select("work", "class")
    if works is not None:
        rows = rows.join(works, "work", "left_semi")
    cited = cat.literal(M.REFERENCED_BY).select("work", F.col("value").alias("citation"))
    years = cat.links_of("year").select("work", F.col("target").alias("year_uri"))
    dois = cat.literal(M.DOI).select("work", F.col("value").alias("doi"))
    return (
        rows.join(cited, "work").join(years, "work").join(dois, "work", "left")
        .selectExpr(f"{X.camel_words(X.last_segment('class'))} as worktype", "citation",
                    f"{X.last_segment('year_uri')} as year", f"{X.last_segment('work')} as workid",
                    "coalesce(doi, '') as doi")
        .distinct().orderBy("year", "citation", "worktype", "workid")
    )


# ---- many queries --------------------------------------------------------

def label_search(queries: DataFrame, labels: DataFrame, last_prefix: bool = False,
                 min_relevance: float = 0.0, long_texts: bool = False,
                 blocks: int = BLOCKS) -> DataFrame:
    """(query, uri, label, score) of every label that has all query tokens.

    `queries` has a text column `query`, `labels` has `uri` and `label`. The
    index holds only tokens that some query can hit, each once per text, so
    texts are read and cut into tokens once and never shuffled. A query looks up
    its rarest full token and checks the others on the candidate.

    Equal labels are indexed once and meet their URIs last. With `long_texts`
    (documents, few copies) every text is its own unit and the label is left out
    of the result.
    """
    hits = label_hits(queries, labels, last_prefix, min_relevance, long_texts, blocks)
    if long_texts:
        return hits.selectExpr("query", "id.uri as uri", "score").distinct()
    return hits.selectExpr("query", "id as label", "score").join(
        labels.select("uri", "label"), "label").select(
        "query", "uri", "label", "score").distinct()


def label_hits(queries: DataFrame, labels: DataFrame, last_prefix: bool = False, min_relevance: float = 0.0,
               long_texts: bool = False, blocks: int = BLOCKS) -> DataFrame:
    """(id, query, score) of `label_search`, where `id` is the label, or what stands for a long text."""
    asked = asked_of(queries)
    toks = f"array_distinct({X.tokens('label')}) as toks"
    units = (labels.selectExpr("struct(uri, xxhash64(label) as text) as id", toks) if long_texts
             else labels.select("label").distinct().selectExpr("label as id", toks))
    # The outer form spares a filter that would cut the text into tokens again.
    words = units.selectExpr("id", "size(toks) as n_tokens", "explode_outer(toks) as token")
    wanted = full_tokens(asked, last_prefix).select("token")
    begun = None
    if last_prefix:
        begun = begun_tokens(asked, words.select("token").distinct())
        wanted = wanted.unionByName(begun.select("token"))
    postings = words.join(wanted.distinct(), "token", "left_semi").distinct()
    freq = postings.groupBy("token").agg(F.count("*").alias("n"))
    return match_postings(asked, postings, freq, begun, min_relevance, blocks)


def asked_of(queries: DataFrame) -> DataFrame:
    """(query, q) of queries that have a token."""
    return queries.select("query").distinct().selectExpr(
        "query", f"{X.tokens('query')} as q").filter("size(q) > 0")


def full_tokens(asked: DataFrame, last_prefix: bool) -> DataFrame:
    """(query, q, token) of the tokens that are not being typed."""
    usable = "slice(q, 1, size(q) - 1)" if last_prefix else "q"
    return asked.selectExpr("query", "q", f"explode(array_distinct({usable})) as token")


def begun_tokens(asked: DataFrame, tokens: DataFrame) -> DataFrame:
    """(query, q, token) of the tokens that begin with what is being typed.

    Typed prefixes and tokens meet on the prefix; a token is cut to the lengths that some
    prefix has, however long it is itself. The driver gets one number per length.
    """
    ends = asked.selectExpr("query", "q", "element_at(q, -1) as prefix")
    lengths = sorted(r.n for r in ends.selectExpr("length(prefix) as n").distinct().collect())
    cuts = ", ".join(map(str, lengths)) or "0"
    starts = tokens.selectExpr("token", f"explode(filter(array({cuts}), n -> n <= length(token))) as n").selectExpr(
        "token", "left(token, n) as prefix")
    return starts.join(ends, "prefix").select("query", "q", "token")


def match_postings(asked: DataFrame, postings: DataFrame, freq: DataFrame, begun: DataFrame | None,
                   min_relevance: float, blocks: int = BLOCKS) -> DataFrame:
    """(id, query, score) from postings (token, id, n_tokens) and frequencies (token, n) of the tokens asked for.

    `begun` has the tokens that a typed prefix may become; without it all tokens are whole.
    """
    last_prefix = begun is not None
    full = full_tokens(asked, last_prefix)
    # A token nobody has leaves its query without a result: it is the rarest.
    driver = (
        full.join(freq, "token", "left").groupBy("query", "q")
        .agg(F.expr("min_by(token, struct(coalesce(n, 0), token))").alias("token"))
    )
    if last_prefix:
        driver = driver.unionByName(begun.filter("size(q) = 1"))
    pairs = blocked_join(postings.select("token", "id"), driver, "token", ["id"], blocks)
    pairs = pairs.select("id", "query", "q").distinct()
    # Dealt out as rows, which take less than the arrays that each task would pass on.
    found = postings.repartition("id").groupBy("id").agg(F.collect_set("token").alias("toks"),
                                       F.max("n_tokens").alias("n_tokens"))
    return (
        pairs.join(found, "id")
        .filter(has_all_tokens("toks", "q", last_prefix))
        .selectExpr("id", "query", f"{relevance('toks', 'q', last_prefix, 'n_tokens')} as score")
        .filter(F.col("score") >= min_relevance)
    )


def least_owners(hits: DataFrame, owners: DataFrame, k: int) -> DataFrame:
    """(id, uri) of the k least entities of each label that is hit; each task passes on k of a label."""
    owned = owners.join(hits.select("id").distinct(), "id", "left_semi").select("id", "uri")
    order = W.partitionBy("id").orderBy("uri")      # an entity may own a label several times
    return (owned.withColumn("nth", F.dense_rank().over(order)).filter(F.col("nth") <= k)
            .select("id", "uri").distinct())


def best_per_query(hits: DataFrame, owners: DataFrame, k: int) -> DataFrame:
    """k best entities per query, score first, then URI, from hits (query, id, score) and owners (id, uri, label).

    An entity is shown once, by its best score and the least of its labels that the query hits. All
    entities of a label score alike, so only its k least can be among the best; the others of a label that
    very many share never meet the queries. Labels of the chosen entities are looked up afterwards.
    """
    hits = written(hits.select("query", "id", "score").distinct(), "hits")
    order = W.partitionBy("query").orderBy(F.col("score").desc(), "uri")
    best = (hits.join(least_owners(hits, owners, k), "id").groupBy("query", "uri").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    best = written(best, "best")
    named = (owners.join(best.select("uri").distinct(), "uri", "left_semi").join(best.select("query", "uri"), "uri")
             .join(hits.select("query", "id"), ["query", "id"]).groupBy("query", "uri").agg(F.min("label").alias("label")))
    return best.join(named, ["query", "uri"]).select("query", "rank", "uri", "label", "score")


def _best_labelled(labels: DataFrame, queries: DataFrame, k: int, *how) -> DataFrame:
    owners = labels.select(F.col("label").alias("id"), "uri", "label")
    return best_per_query(label_hits(queries, labels, *how), owners, k)


def suggest(cat: Catalog, queries: DataFrame, k: int = 35, min_relevance: float = 0.5,
            typed_only: bool = False) -> DataFrame:
    """Autocomplete for each query: any labelled entity, or works only."""
    labels = cat.labels_of().filter(~F.col("uri").endswith("/"))
    if typed_only:
        labels = labels.join(cat.types.select(F.col("work").alias("uri")), "uri", "left_semi")
    return _best_labelled(labels, queries, k, True, min_relevance)


def prior_records(cat: Catalog, titles: DataFrame, work_class: str | None = None,
                  k: int = 5) -> DataFrame:
    """Catalogued works whose label has all tokens of an incoming title."""
    types = cat.types if work_class is None else cat.types.filter(F.col("class") == work_class)
    labels = cat.labels_of("work").join(
        types.select(F.col("work").alias("uri")), "uri", "left_semi")
    return _best_labelled(labels, titles, k)


# ---- mentions in text ----------------------------------------------------

def link_mentions(texts: DataFrame, labels: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Distinct (doc, uri, label) of entity labels that occur in a text, word for word.

    `texts`: doc, text. `labels`: uri, label, of any number of words. Each text is cut once into words
    with positions, and only words of some label stay. A label is looked for where its
    rarest word stands; the other words are then looked up at their positions. So the work
    on a text grows with its words, whatever the lengths of the labels, and a
    frequent word costs nothing unless a label has no rarer one. Rows of `texts` may share a doc;
    mentions never span two of them.
    """
    named = labels.select("uri", "label").distinct().selectExpr(
        "uri", "label", f"{X.tokens('label')} as words").filter("size(words) > 0").selectExpr(
        "uri", "label", "words", "array_join(words, ' ') as key")
    places = named.select("key", "words").distinct().selectExpr(
        "key", "size(words) as n_words", "posexplode(words) as (nth, word)")
    found = texts.select("doc", F.monotonically_increasing_id().alias("text"), F.col("text").alias("t")).selectExpr(
        "doc", "text", f"posexplode({X.tokens('t')}) as (pos, word)")
    found = written(found.join(places.select("word").distinct(), "word", "left_semi"), "mentions")
    often = found.groupBy("word").agg(F.count("*").alias("n"))
    anchors = places.join(often, "word").groupBy("key", "n_words").agg(
        F.count("*").alias("n_found"), F.expr("min_by(struct(word, nth), struct(n, word, nth))").alias("rarest")).filter(
        "n_found = n_words").select("key", "n_words", "rarest.word", F.col("rarest.nth").alias("anchor"))
    starts = blocked_join(found, anchors, "word", ["text", "pos"], blocks).selectExpr(
        "doc", "text", "pos - anchor as start", "key", "n_words", "anchor").filter("start >= 0")
    others = starts.filter("n_words > 1").join(places.select("key", "nth", "word"), "key").filter("nth != anchor")
    whole = others.selectExpr("doc", "text", "start", "key", "n_words", "start + nth as pos", "word").join(
        found.select("text", "pos", "word"), ["text", "pos", "word"]).groupBy(
        "doc", "text", "start", "key", "n_words").count().filter("count = n_words - 1")
    hits = starts.filter("n_words = 1").select("doc", "key").unionByName(whole.select("doc", "key")).distinct()
    return hits.join(named, "key").select("doc", "uri", "label").distinct()
