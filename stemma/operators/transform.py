"""Batch rows and form submissions turned into catalogue quads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stemma import model as M
from stemma.functions import terms, text as X
from stemma.functions.citation import EDITED, IN_BOOK, PERIODICAL, citation
from stemma.functions.text import lit
from stemma.plans.durable import written

PEOPLE = [f"{w}_{k}" for w in ("author", "editor") for k in range(1, 11)]
NO_ISSUE = "not contains(kind, 'issue')"
ET_AL = f"author_5 is not null and {NO_ISSUE}"


def clean_rows(batch: DataFrame, id_column: str | None = None, base: str = M.BASE,
               strict_reference: bool = False) -> DataFrame:
    """Cells cleaned, missing ones NULL, plus work, g, kind, class, citation.

    Rows without a usable title are dropped. Without an id column the work is
    named by a hash of its cells, so a re-run gives the same URI.
    """
    present = {c.lower(): c for c in batch.columns}

    def get(name):
        if name not in present:
            return "cast(null as string)"
        return X.cell(f"`{present[name]}`")

    row_id = id_column or "sha2(to_json(array({})), 256)".format(
        ", ".join(get(c) for c in M.BATCH_COLUMNS))
    rows = batch.selectExpr(
        f"concat({lit(base)}, {row_id}) as work",
        f"lower(coalesce({get('publication type')}, '')) as kind",
        f"{terms.work_class(get('publication type'))} as class",
        f"{X.norm_title(get('title'))} as title",
        *[f"{get(c)} as {c}" for c in PEOPLE],
        *[f"{X.norm_number(get(n), strict_reference)} as {n}"
          for n in ("volume", "issue", "pages")],
        *[f"{get(c)} as {c}" for c in ("journal", "lang", "booktitle", "publisher")],
        f"{X.norm_year(get('year'))} as year",
        f"{X.split_themes(get('main_theme'), strict_reference)} as main_theme",
        f"{X.split_themes(get('secondary_theme'), strict_reference)} as secondary_theme",
        f"{X.norm_link(get('link'))} as link",
        f"{X.norm_doi(get('doi'), strict_reference)} as doi",
    ).filter("title is not null")
    return rows.selectExpr("*", "concat(work, '/') as g", f"{citation()} as citation")


def name_slots(rows: DataFrame) -> DataFrame:
    """Names of cleaned rows as (g, work, kind, role, ordinal, property, label).

    Journal issues have no authors; editors need a first editor and a type that
    is edited; the container is a journal or a book by type; periodicals have
    no publisher. One `inline`, no join.
    """
    def slot(kind, role, ordinal, prop, name, when):
        return (f"named_struct('kind', '{kind}', 'role', '{role}', 'ordinal', "
                f"cast({ordinal} as int), 'property', {lit(prop)}, "
                f"'label', if({when}, {name}, null))")

    edited = f"{EDITED} and editor_1 is not null"
    slots = [slot("people", "author", k, p, f"author_{k}", NO_ISSUE)
             for k, p in enumerate(M.AUTHOR_PROPS, 1)]
    slots += [slot("people", "editor", k, p, f"editor_{k}", edited)
              for k, p in enumerate(M.EDITOR_PROPS, 1)]
    slots += [slot("journals", "container", "null", M.PART_OF, "journal", PERIODICAL),
              slot("books", "container", "null", M.PART_OF, "booktitle", IN_BOOK),
              slot("publishers", "publisher", "null", M.DCT_PUBLISHER, "publisher",
                   f"not {PERIODICAL}")]
    named = rows.selectExpr("g", "work", f"inline(array({', '.join(slots)}))")
    return named.filter("label is not null")


def resolve_slots(slots: DataFrame, matches: DataFrame, base: str = M.BASE) -> DataFrame:
    """Slots with `target`: the matched URI, else the minted one.

    `matches` is unique by (kind, label); only matched names join, minting is
    an expression. They are written first: so Spark can split the partitions of names that very many
    slots hold, which it does not do beside a side that comes from another join.
    """
    hit = written(matches.filter("uri is not null").select("kind", "label", "uri"), "matches")
    return slots.join(hit, ["kind", "label"], "left").selectExpr(
        "g", "work", "kind", "role", "ordinal", "property", "label",
        f"coalesce(uri, {terms.minted_uri('kind', 'label', base)}) as target")


def quad_fact(s: str, p: str, o: str, kind: str = "literal", o_type: str | None = None) -> str:
    """Struct of one quad; s and o are expressions, p a URI or a column name."""
    prop = lit(p) if ":" in p else p
    o_type = lit(o_type) if o_type else "cast(null as string)"
    return f"named_struct('s', {s}, 'p', {prop}, 'o', {o}, 'o_kind', '{kind}', 'o_type', {o_type})"


def quad_facts(df: DataFrame, facts: list[str]) -> DataFrame:
    """Quads of each row of `df`, those with a missing end left out."""
    return _stated(df, f"array({', '.join(facts)})")


def _stated(df: DataFrame, facts: str) -> DataFrame:
    out = df.selectExpr("g", f"inline({facts})")
    return out.filter("o is not null and s is not null").select(*M.QUAD_COLUMNS)


def _name_facts() -> list[str]:
    return [quad_fact("work", "property", "target", "uri"), quad_fact("target", M.RDFS_LABEL, "label")]


def _name_quads(resolved: DataFrame) -> DataFrame:
    return quad_facts(resolved, _name_facts())


def row_authors(resolved: DataFrame) -> DataFrame:
    """Author quads: the slot's predicate and the person's label."""
    return _name_quads(resolved.filter("role = 'author'"))


def row_editors(resolved: DataFrame) -> DataFrame:
    return _name_quads(resolved.filter("role = 'editor'"))


def row_container(resolved: DataFrame) -> DataFrame:
    return _name_quads(resolved.filter("role = 'container'"))


def row_publisher(resolved: DataFrame) -> DataFrame:
    return _name_quads(resolved.filter("role = 'publisher'"))


def row_et_al(rows: DataFrame) -> DataFrame:
    """'et al.' marker of works with a fifth author."""
    return quad_facts(rows, _et_al_facts())


def _et_al_facts() -> list[str]:
    uri = f"if({ET_AL}, {lit(M.ET_AL)}, null)"
    return [quad_fact("work", M.OTHER_AUTHORS, uri, "uri"), quad_fact(uri, M.RDFS_LABEL, "'et al.'")]


def _subject_facts(base: str) -> str:
    """Array of quads: link and label of every theme of a row."""
    def themes(column, prop):
        uri = terms.vocab_uri("t", base)
        pair = f"array({quad_fact('work', prop, uri, 'uri')}, {quad_fact(uri, M.RDFS_LABEL, 't')})"
        return f"flatten(transform(coalesce({column}, cast(array() as array<string>)), t -> {pair}))"

    return (f"concat({themes('main_theme', M.PRIMARY_SUBJECT)}, "
            f"{themes('secondary_theme', M.SUBJECT)})")


def row_subjects(rows: DataFrame, base: str = M.BASE) -> DataFrame:
    """Primary and secondary subject quads, one pair per theme."""
    return _stated(rows, _subject_facts(base))


def _language_facts(base: str) -> list[str]:
    uri = terms.vocab_uri("lang", base)
    return [quad_fact("work", M.DCT_LANGUAGE, uri, "uri"), quad_fact(uri, M.RDFS_LABEL, "lower(lang)")]


def row_language(rows: DataFrame, base: str = M.BASE) -> DataFrame:
    return quad_facts(rows, _language_facts(base))


def _scalar_facts(base: str) -> list[str]:
    year = f"concat({lit(base + 'vocabularies/')}, year)"
    texts = {M.DCT_TITLE: "title", M.RDFS_LABEL: "title", M.URL: "link", M.DOI: "doi",
             M.PAGES: "pages", M.REFERENCED_BY: "citation",
             M.VOLUME: f"if({PERIODICAL}, volume, null)",
             M.ISSUE: f"if({PERIODICAL}, issue, null)"}
    return [quad_fact("work", M.RDF_TYPE, "class", "uri"),
            quad_fact("work", M.PUBLICATION_DATE, year, "uri"), quad_fact(year, M.RDFS_LABEL, "year"),
            *[quad_fact("work", p, x) for p, x in texts.items()]]


def row_scalars(rows: DataFrame, base: str = M.BASE) -> DataFrame:
    """Class, title, year, link, DOI, volume, issue, pages, citation."""
    return quad_facts(rows, _scalar_facts(base))


def moment_text(generated_at: str | None) -> str:
    """Given moment, or the time of the run, as text."""
    return (lit(generated_at) if generated_at
            else "date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")")


def _provenance_facts(creator: str, moment: str, base: str) -> list[str]:
    user = f"concat({lit(base)}, {X.encode_user(lit(creator))})"
    return [quad_fact("g", M.RDFS_LABEL, "citation"), quad_fact("g", M.ATTRIBUTED_TO, user, "uri"),
            quad_fact(user, M.RDFS_LABEL, lit(creator)),
            quad_fact("g", M.GENERATED_AT, moment, "literal", M.XSD_DATETIME),
            quad_fact("g", M.STATUS, lit(M.PUBLISHED))]


def row_provenance(rows: DataFrame, creator: str, generated_at: str | None = None,
                   base: str = M.BASE) -> DataFrame:
    return quad_facts(rows, _provenance_facts(creator, moment_text(generated_at), base))


def rows_to_quads(batch: DataFrame, matches: DataFrame, creator: str,
                  generated_at: str | None = None, id_column: str | None = None,
                  base: str = M.BASE, strict_reference: bool = False) -> DataFrame:
    """Whole mapping of a batch: one graph per row, each quad once.

    The facts that need no lookup come from one array per row; names take one
    join with the matches, whatever the number of slots. Rows and slots are dealt out by graph before
    they become quads, which are then made distinct where they lie.
    """
    rows = clean_rows(batch, id_column, base, strict_reference)
    single = (_scalar_facts(base) + _language_facts(base) + _et_al_facts()
              + _provenance_facts(creator, moment_text(generated_at), base))
    slots = resolve_slots(name_slots(rows), matches, base).select("g", "work", "property", "target", "label")
    dealt = rows.withColumn("is_slot", F.lit(False)).unionByName(
        slots.withColumn("is_slot", F.lit(True)), allowMissingColumns=True).repartition("g")
    return _stated(dealt, f"if(is_slot, array({', '.join(_name_facts())}), "
                          f"concat(array({', '.join(single)}), {_subject_facts(base)}))").distinct()


def form_to_quads(submissions: DataFrame, fields: DataFrame, creators: DataFrame | None = None,
                  generated_at: str | None = None, base: str = M.BASE) -> DataFrame:
    """Form submissions with their template's fields turned into quads.

    `submissions`: record_id, template, stage, user, fields (map of text).
    `fields`: template fields, with a column `values` (map uri→label) where a
    field is a single choice. `creators`: (g, creator, creator_label) of stored
    records, carried over when a record is modified or published.
    """
    if "values" not in fields.columns:
        fields = fields.withColumn("values", F.lit(None).cast("map<string,string>"))
    sub = submissions.selectExpr(
        "template", "stage", "user", f"concat({lit(base)}, record_id) as work",
        f"concat({lit(base)}, record_id, '/') as g", "fields")
    entries = sub.selectExpr("template", "stage", "work", "g",
                             "explode(fields) as (key, value)")
    by_id = entries.withColumnRenamed("key", "field_id")
    # A multi-value key is 'field-suffix'; the field id itself may hold dashes.
    prefixes = ("transform(filter(sequence(1, length(key)), i -> substr(key, i, 1) = '-'), "
                "i -> left(key, i - 1))")
    by_prefix = entries.selectExpr("*", f"explode({prefixes}) as field_id")
    known = fields.select("template", "field_id", "property", "field_type", "value_kind",
                          "disambiguate", "values")

    literal = by_id.join(known.filter("value_kind = 'Literal'"), ["template", "field_id"])
    single = (
        by_id.join(known.filter("value_kind <> 'Literal' and field_type <> 'Textarea'"),
                   ["template", "field_id"])
        .selectExpr("work", "g", "property", "value as id", "values[value] as name")
        .filter("name is not null")
    )
    linked = by_prefix.join(known.filter("value_kind <> 'Literal' or field_type = 'Textarea'"),
                            ["template", "field_id"]).selectExpr(
        "work", "g", f"if(field_type = 'Textarea', {lit(M.KEYWORDS)}, property) as property",
        "value")
    kept_words = by_prefix.filter(f"field_id = 'keywords' and stage = '{M.MODIFIED}'").selectExpr(
        "work", "g", f"{lit(M.KEYWORDS)} as property", "value")
    # 'id,name' with the name percent-encoded; a plus or a stray per-cent sign stands for itself.
    many = linked.unionByName(kept_words).selectExpr(
        "work", "g", "property",
        f"translate({X.strip("split(value, ',', 2)[0]")}, '\"\\'', '') as id",
        r"url_decode(regexp_replace(replace(split(value, ',', 2)[1], '+', '%2B'), "
        r"'%(?![0-9A-Fa-f]{2})', '%25')) as name")
    targets = single.unionByName(many).selectExpr(
        "work", "g", "property", f"concat({terms.uri_base('id', base)}, id) as target",
        f"{X.strip('name')} as label")
    object_quads = quad_facts(targets, [
        quad_fact("work", "property", "target", "uri"),
        quad_fact("target", M.RDFS_LABEL, "label", "literal", M.XSD_STRING)])

    flat = "if(length(value) >= 1, translate(value, '\n\r', ''), null)"
    main = "if(disambiguate, value, null)"
    literal_quads = quad_facts(literal, [
        quad_fact("work", "property", flat), quad_fact("g", "property", main),
        quad_fact("work", M.RDFS_LABEL, main), quad_fact("g", M.RDFS_LABEL, main)])

    titled = fields.filter("disambiguate").select("template").distinct()
    untitled = quad_facts(sub.join(titled, "template", "left_anti"),
                      [quad_fact("g", M.RDFS_LABEL, "'no title'")])
    classes = sub.join(fields.select("template", "class").distinct(), "template")
    user = f"concat({lit(base)}, {X.encode_user('user')})"
    new = f"stage = '{M.NOT_MODIFIED}'"
    told = quad_facts(classes, [
        quad_fact("work", M.RDF_TYPE, "class", "uri"),
        quad_fact("g", M.ATTRIBUTED_TO, f"if({new}, {user}, null)", "uri"),
        quad_fact("g", M.INFLUENCED_BY, f"if({new}, null, {user})", "uri"),
        quad_fact(user, M.RDFS_LABEL, "user"),
        quad_fact("g", M.GENERATED_AT, moment_text(generated_at), "literal", M.XSD_DATETIME),
        quad_fact("g", M.STATUS, "stage", "literal", M.XSD_STRING)])
    out = told.unionByName(literal_quads).unionByName(object_quads).unionByName(untitled)
    if creators is not None:
        later = sub.filter(f"not {new}").select("g").distinct()
        out = out.unionByName(quad_facts(creators.join(later, "g", "left_semi"), [
            quad_fact("g", M.ATTRIBUTED_TO, "creator", "uri"),
            quad_fact("creator", M.RDFS_LABEL, "creator_label")]))
    return out.distinct()
