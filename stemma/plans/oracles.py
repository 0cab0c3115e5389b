"""The same results as SQL over the base tables, for checking."""

from __future__ import annotations

from stemma import model as M

B, V = M.BASE, M.VOCAB
CREATOR, MOMENT, QUOTA = "curator@example.org", "2024-01-01T00:00:00", 5

# Works: one row per order with everything that is single-valued.
WORKS = f"""
lead_t as (
  select l_orderkey as k, min_by(p_name, l_partkey) as title
  from lineitem join part on l_partkey = p_partkey group by 1),
works as (
  select o_orderkey as k, o_custkey as ck, '{B}o' || o_orderkey as work,
    '{B}o' || o_orderkey || '/' as g,
    case left(o_orderpriority, 1) when '1' then '{M.ARTICLE}' when '2' then '{M.BOOK}'
      when '3' then '{M.CHAPTER}' when '4' then '{M.THESIS}' else '{M.REPORT}' end as class,
    case o_orderstatus when 'F' then 'published' when 'O' then 'modified'
      else 'not modified' end as status,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as moment,
    cast(year(o_orderdate) as varchar) as y, c_name, c_mktsegment as seg, n_name, title,
    c_name || ' (' || year(o_orderdate) || '). ' || coalesce(title, '-') || '.' as cit
  from orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey left join lead_t on lead_t.k = o_orderkey),
lns as (
  select distinct l_orderkey as k, l_linenumber as n, s_suppkey as sk, s_name, p_type, p_brand
  from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey)
"""
W = "with " + WORKS
ORD = "['" + "','".join(M.ORDINALS) + "']"
SLUG_BRAND = "replace(lower(p_brand), '#', '-')"
CONTAINER = f"'{B}j-' || replace(title, ' ', '-')"

# Links in long form with the label of the target.
LINKS = f"""
links as (
  select w.k, work, g, class, status, 'author' as role, '{B}' || {ORD}[n] || 'Author' as p,
    '{B}s' || sk as target, s_name as label from works w join lns on lns.k = w.k
  union select w.k, work, g, class, status, 'primary_subject', '{M.PRIMARY_SUBJECT}',
    '{V}' || lower(p_type), p_type from works w join lns on lns.k = w.k
  union select w.k, work, g, class, status, 'subject', '{M.SUBJECT}',
    '{V}' || {SLUG_BRAND}, p_brand from works w join lns on lns.k = w.k
  union select k, work, g, class, status, 'year', '{M.PUBLICATION_DATE}', '{V}' || y, y from works
  union select k, work, g, class, status, 'language', '{M.DCT_LANGUAGE}', '{V}' || lower(n_name),
    n_name from works
  union select k, work, g, class, status, 'publisher', '{M.DCT_PUBLISHER}',
    '{B}p-' || lower(seg), seg from works
  union select k, work, g, class, status, 'container', '{M.PART_OF}', {CONTAINER}, title
    from works where title is not null)
"""
WL = W + "," + LINKS

QUADS = f"""
quads as (
  select work as s, '{M.RDF_TYPE}' as p, class as o, 'uri' as o_kind,
    cast(null as varchar) as o_type, g from works
  union select work, p, target, 'uri', null, g from links
  union select target, '{M.RDFS_LABEL}', label, 'literal', '{M.XSD_STRING}', g from links
  union select work, '{M.DCT_TITLE}', title, 'literal', null, g from works where title is not null
  union select work, '{M.RDFS_LABEL}', title, 'literal', null, g from works where title is not null
  union select work, '{M.REFERENCED_BY}', cit, 'literal', null, g from works
  union select g, '{M.RDFS_LABEL}', cit, 'literal', null, g from works
  union select g, '{M.STATUS}', status, 'literal', '{M.XSD_STRING}', g from works
  union select g, '{M.GENERATED_AT}', moment, 'literal', '{M.XSD_DATETIME}', g from works
  union select g, '{M.ATTRIBUTED_TO}', '{B}c' || ck, 'uri', null, g from works
  union select '{B}c' || ck, '{M.RDFS_LABEL}', c_name, 'literal', '{M.XSD_STRING}', g from works
  union select g, '{M.INFLUENCED_BY}', '{B}c' || ck, 'uri', null, g from works
    where status = 'modified')
"""
WQ = WL + "," + QUADS

TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def toks(x: str) -> str:
    return TOKENS.format(x)


def per_year(source: str) -> str:
    return f"""{WL} select y as year, '{V}' || y as year_uri, count(distinct x) as count
      from ({source}) group by y"""


AUTHOR_COLS = ", ".join(
    f"coalesce(min(case when n = {k} then s_name end), '-') as author{k}" for k in range(1, 11))
EDITOR_COLS = ", ".join(f"'-' as editor{k}" for k in range(1, 11))
EXPORT = f"""
  select work as article_id, replace(class, '{M.FABIO}', '') as type, cit as citation,
    coalesce(title, '-') as title, {AUTHOR_COLS}, {EDITOR_COLS},
    coalesce(title, '-') as journal_or_booktitle, '-' as volume, '-' as issue, '-' as pages,
    y as year, seg as publisher, lower(n_name) as language, '-' as link, '-' as doi,
    coalesce(string_agg(distinct p_type, '; ' order by p_type), '') as topic
  from works left join lns on lns.k = works.k
  group by work, class, cit, title, y, seg, n_name
"""
CSV_COLUMNS = (["article_id", "type", "citation", "title"]
               + [f"author{k}" for k in range(1, 11)] + [f"editor{k}" for k in range(1, 11)]
               + ["journal_or_booktitle", "volume", "issue", "pages", "year", "publisher",
                  "language", "link", "doi", "topic"])
RECORDS = """
  select g, cit as title, c_name as user,
    case when status = 'modified' then c_name else '-' end as modifier,
    moment as date, status as stage, class from works
"""


def ris() -> str:
    def many(tag, expr, classes=None):
        cond = f"{expr} is not null"
        if classes:
            cond += " and class in (" + ",".join(f"'{c}'" for c in classes) + ")"
        return f"case when {cond} then '{tag} - ' || {expr} end"

    people = [many("AU", f"min(case when n = {k} then s_name end)",
                   None if k == 1 else [M.ARTICLE, M.BOOK, M.CHAPTER, M.REPORT])
              for k in range(1, 11)]
    lines = [
        f"""'TY - ' || case class when '{M.ARTICLE}' then 'JOUR' when '{M.BOOK}' then 'BOOK'
          when '{M.CHAPTER}' then 'CHAP' when '{M.THESIS}' then 'THES' else 'RPRT' end""",
        *people, "'PY - ' || y", "'TI - ' || title",
        many("J2", "title", [M.CHAPTER]), many("JO", "title", [M.ARTICLE]),
        many("PB", "seg", [M.BOOK, M.CHAPTER, M.THESIS, M.REPORT]),
        "'LA - ' || n_name", "'DP - Catalogue'", "'ER  - '"]
    return f"""{W} select work, concat_ws(chr(10), {", ".join(lines)}) as ris
      from works left join lns on lns.k = works.k group by work, class, y, title, seg, n_name"""


# Template fields as a relation, and templates by class.
FIELDS = "fields(template, field_id, property, value_kind, label, disambiguate, position) as (values " + ", ".join(
    f"('{r[0]}', '{r[2]}', '{r[4]}', '{r[6]}', '{r[3]}', {str(r[8]).lower()}, {r[9]})"
    for r in M.standard_fields()) + ")"
TEMPLATE = "case class " + " ".join(
    f"when '{c}' then '{t}'" for t, c in M.TEMPLATE_CLASSES.items()) + " end"
RECORD_FIELDS = f"""
rf as (
  select g, template, field_id, value, x.label from (
    select g, class, p, target as value, label, 'URI' as kind from links
    union all select g, class, '{M.DCT_TITLE}', title, null, 'Literal' from works
      where title is not null
    union all select g, class, '{M.REFERENCED_BY}', cit, null, 'Literal' from works) x
  join fields f on f.template = {TEMPLATE} and f.property = x.p and f.value_kind = x.kind)
"""

NAMES = f"""
names as (select lower(n_name) as name, '{V}' || lower(n_name) as uri from nation
  union all select 's' || s_suppkey, '{B}s' || s_suppkey from supplier),
about as (
  select distinct name, s, p, o, o_kind from names join quads on s = uri
  where uri in (select o from quads where o_kind = 'uri')
  union select name, s, p, o, o_kind from names join quads on o = uri and o_kind = 'uri')
"""

SITES = r"select distinct regexp_extract(url, '//(?:[a-z]+\.)?([a-z]+)\.example\.', 1) as label " \
        "from pages where regexp_extract(url, '//(?:[a-z]+\\.)?([a-z]+)\\.example\\.', 1) <> ''"

TYPED = """
  select distinct split_part(p_name, ' ', 1) || ' ' || left(split_part(p_name, ' ', -1), 2) as query
    from part
  union select left(s_name, length(s_name) - 1) from supplier
  union select left(p_name, 3) from part
"""
HIT = """len(q) > 0 and list_has_all(tk, q[1:len(q) - 1])
    and len(list_filter(tk, lambda t: starts_with(t, q[len(q)]))) > 0"""
SCORE = """len(list_filter(list_distinct(tk), lambda t: list_contains(q, t)
    or starts_with(t, q[len(q)]))) / cast(len(list_distinct(tk)) as double)"""


def suggestion(entities: str, k: int, least: float) -> str:
    return f"""{WL}, ent as ({entities}),
      txt as (select label, {toks('label')} as tk from (select distinct label from ent)),
      asked as (select query, {toks('query')} as q from ({TYPED})),
      hits as (select query, label, {SCORE} as score from asked, txt where {HIT}),
      one as (select query, uri, max(score) as score, min(label) as label
        from hits join ent using (label) where score >= {least} group by 1, 2),
      ranked as (select query, row_number() over (
        partition by query order by score desc, uri) as rank, uri, label, score from one)
      select * from ranked where rank <= {k}"""


# The spreadsheet: one row per order.
NAME = """(case when l_linenumber % 2 = 0 then '  ' else '' end || s_name ||
  case when l_linestatus = 'O' then ' Jr' else '' end)"""
SLOTS = ", ".join(
    f"min(case when l_returnflag {op} 'R' and l_linenumber = {k} then {NAME} end) as {w}_{k}"
    for w, op in (("author", "<>"), ("editor", "=")) for k in range(1, 11))
BATCH = f"""
per_order as (
  select l_orderkey as k, min_by(p_name, l_partkey) as p_title, max_by(p_name, l_partkey) as p_book,
    cast(max(l_partkey) as varchar) as n_issue, cast(min(l_partkey) as varchar) as n_volume,
    list_sort(list_distinct(list(p_type))) as types, list_sort(list_distinct(list(p_brand))) as brands,
    {SLOTS}
  from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey
  group by 1),
batch as (
  select 'o' || o_orderkey as id,
    case when left(o_orderpriority, 1) = '1' and o_orderstatus = 'P' then 'Journal Issue'
      when left(o_orderpriority, 1) = '5' and o_orderstatus = 'P' then 'Grey Literature'
      else case left(o_orderpriority, 1) when '1' then 'Article' when '2' then 'Book'
        when '3' then 'Book chapter' when '4' then 'Doctoral Thesis' else 'Report' end end as type,
    ' "' || p_title || '" ' || o_orderkey as title, types, brands,
    {", ".join(f"{w}_{k}" for w in ("author", "editor") for k in range(1, 11))},
    case when left(o_orderpriority, 1) = '1' then p_title end as journal,
    case when left(o_orderpriority, 1) = '1' then '(' || n_volume || ')' end as volume,
    case when left(o_orderpriority, 1) = '1' and o_orderstatus <> 'O' then n_issue end as issue,
    case when o_orderstatus = 'F' then '(' || o_orderkey || '-' || n_issue || ')' end as pages,
    case when o_orderstatus = 'F' then year(o_orderdate) || '.0'
      when o_orderstatus = 'O' then '(' || year(o_orderdate) || ')'
      when o_custkey % 10 = 0 then 'n.d.' else cast(year(o_orderdate) as varchar) end as year,
    case when o_orderstatus = 'P' and o_custkey % 10 = 0 then null
      else cast(year(o_orderdate) as varchar) end as clean_year,
    n_name as lang, case when o_custkey % 3 = 0 then 'Not found'
      else 'https://example.org/item/' || o_orderkey end as link,
    case o_custkey % 4 when 0 then 'https://doi.org/10.5/AB' || o_orderkey
      when 1 then 'doi: 10.5/ab' || o_orderkey when 2 then 'http://dx.doi.org/10.5/Ab' || o_orderkey
      else 'not available' end as doi,
    case when o_custkey % 4 < 3 then '10.5/ab' || o_orderkey end as clean_doi,
    case when left(o_orderpriority, 1) = '3' then p_book end as booktitle,
    left(c_mktsegment, 1) || lower(c_mktsegment[2:]) as publisher
  from orders left join per_order on per_order.k = o_orderkey
  join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)
"""
PEOPLE = [f"{w}_{k}" for w in ("author", "editor") for k in range(1, 11)]

# The cleaned rows: kind of work, trimmed names, resolved names in long form.
EDITED = "type in ('Book', 'Book chapter') and editor_1 is not null"


def trimmed(c: str) -> str:
    return f"trim({c})"


def joined(word: str, first: int) -> str:
    return "concat_ws('; ', " + ", ".join(
        f"trim({word}_{k})" for k in range(first, 11)) + ")"


EDITORS = f"""case when editor_2 is not null
    then concat_ws('; ', coalesce(trim(editor_1), ''), nullif({joined('editor', 2)}, ''))
    else coalesce(trim(editor_1), '') end"""
CITATION = f"""trim(
  case when author_1 is not null then {joined('author', 1)}
    when type in ('Book', 'Book chapter') then {EDITORS} ||
      case when editor_2 is not null then ' (eds)' else ' (ed)' end
    else 'No author' end || ' (' || coalesce(clean_year, '') || '). ' || clean_title || '.' ||
  case when type in ('Article', 'Journal Issue') then
      coalesce(' ' || journal, '') || coalesce(', ' || vol, '') ||
      case when vol is not null then coalesce('(' || issue || ')', '')
        else coalesce(', ' || issue, '') end
    else case when author_1 is null and {EDITED} then ' In ' || {EDITORS} ||
        case when editor_2 is not null then ' (eds), ' else ' (ed), ' end else '' end ||
      case when type = 'Book chapter' then coalesce(booktitle || '.', '') else '' end ||
      coalesce(' ' || publisher, '') end ||
  coalesce(', ' || pg, ''))"""
CLEAN = f"""
cleaned as (
  select *, '{B}' || id as work, '{B}' || id || '/' as g,
    case type when 'Article' then '{M.ARTICLE}' when 'Book' then '{M.BOOK}'
      when 'Book chapter' then '{M.CHAPTER}' when 'Doctoral Thesis' then '{M.THESIS}'
      when 'Journal Issue' then '{M.JOURNAL_ISSUE}' when 'Report' then '{M.REPORT}'
      else '{M.WORK}' end as class,
    trim(replace(title, '"', '')) as clean_title,
    volume[2:len(volume) - 1] as vol, pages[2:len(pages) - 1] as pg
  from batch where title is not null),
cited as (select *, {CITATION} as cit from cleaned),
people_slots as (
  {" union all ".join(
      f"select work, g, 'author' as role, '{p}' as p, trim(author_{k}) as label from cited "
      f"where type <> 'Journal Issue'"
      for k, p in enumerate(M.AUTHOR_PROPS, 1))}
  union all {" union all ".join(
      f"select work, g, 'editor', '{p}', trim(editor_{k}) from cited where {EDITED}"
      for k, p in enumerate(M.EDITOR_PROPS, 1))}),
slots as (
  select 'people' as kind, * from people_slots
  union all select 'journals', work, g, 'container', '{M.PART_OF}', journal from cited
    where type in ('Article', 'Journal Issue')
  union all select 'books', work, g, 'container', '{M.PART_OF}', booktitle from cited
    where type = 'Book chapter'
  union all select 'publishers', work, g, 'publisher', '{M.DCT_PUBLISHER}', publisher from cited
    where type not in ('Article', 'Journal Issue'))
"""
KNOWN = f"""
known as (
  select 'people' as kind, '{B}s' || s_suppkey as uri, s_name as label from supplier
    where s_suppkey in (select l_suppkey from lineitem)
  union select 'publishers', '{B}p-' || lower(seg), seg from works
  union select case class when '{M.ARTICLE}' then 'journals' else 'books' end, {CONTAINER}, title
    from works where title is not null and class in ('{M.ARTICLE}', '{M.CHAPTER}'))
"""
BATCH_NAMES = "names as (" + " union ".join(
    [f"select 'people' as kind, trim({c}) as label from batch where {c} is not null"
     for c in PEOPLE]
    + [f"select '{k}', {c} from batch where {c} is not null" for k, c in
       (("journals", "journal"), ("publishers", "publisher"), ("books", "booktitle"))]) + ")"
WB = f"{W}, {BATCH}"
WR = f"{WB}, {CLEAN}, {KNOWN}, " + f"""
resolved as (
  select slots.*, coalesce(known.uri, '{B}' || sha256(slots.kind || '#' || slots.label)) as target
  from slots left join (select kind, label, min(uri) as uri from known group by 1, 2) known
    on known.kind = slots.kind and known.label = slots.label
  where slots.label is not null)
"""


def q(s, p, o, kind="literal", o_type=None, src="cited", where="true"):
    """One select of quads; p is a constant unless it names a column."""
    prop = p if p == "p" else f"'{p}'"
    t = f"'{o_type}'" if o_type else "cast(null as varchar)"
    return (f"select {s} as s, {prop} as p, {o} as o, '{kind}' as o_kind, {t} as o_type, g "
            f"from {src} where {where} and {o} is not null")


def name_quads(role: str) -> str:
    cond = f"role = '{role}'"
    return " union ".join([q("work", "p", "target", "uri", src="resolved", where=cond),
                           q("target", M.RDFS_LABEL, "label", src="resolved", where=cond)])


def subject_quads() -> str:
    parts = []
    for column, p in (("types", M.PRIMARY_SUBJECT), ("brands", M.SUBJECT)):
        src = f"(select work, g, unnest({column}) as t from cited)"
        uri = f"'{V}' || lower(t)"
        parts += [q("work", p, uri, "uri", src=src), q(uri, M.RDFS_LABEL, "t", src=src)]
    return " union ".join(parts)


YEAR_URI, LANG_URI = f"('{V}' || clean_year)", f"('{V}' || lower(lang))"
SERIAL = "type in ('Article', 'Journal Issue')"
FIVE = "author_5 is not null and type <> 'Journal Issue'"
LINK = "link <> 'Not found'"
USER = f"'{B}curator-at-example-dot-org'"
SCALARS = " union ".join([
    q("work", M.RDF_TYPE, "class", "uri"), q("work", M.DCT_TITLE, "clean_title"),
    q("work", M.RDFS_LABEL, "clean_title"), q("work", M.PUBLICATION_DATE, YEAR_URI, "uri"),
    q(YEAR_URI, M.RDFS_LABEL, "clean_year"), q("work", M.URL, "link", where=LINK),
    q("work", M.DOI, "clean_doi"), q("work", M.PAGES, "pg"), q("work", M.REFERENCED_BY, "cit"),
    q("work", M.VOLUME, "vol", where=SERIAL), q("work", M.ISSUE, "issue", where=SERIAL)])
ET_AL = " union ".join([q("work", M.OTHER_AUTHORS, f"'{M.ET_AL}'", "uri", where=FIVE),
                        q(f"'{M.ET_AL}'", M.RDFS_LABEL, "'et al.'", where=FIVE)])
LANGUAGE = " union ".join([q("work", M.DCT_LANGUAGE, LANG_URI, "uri"),
                           q(LANG_URI, M.RDFS_LABEL, "lower(lang)")])
PROVENANCE = " union ".join([
    q("g", M.RDFS_LABEL, "cit"), q("g", M.ATTRIBUTED_TO, USER, "uri"),
    q(USER, M.RDFS_LABEL, f"'{CREATOR}'"),
    q("g", M.GENERATED_AT, f"'{MOMENT}'", o_type=M.XSD_DATETIME),
    q("g", M.STATUS, "'published'")])
ROLES = ("author", "editor", "container", "publisher")

UNTIDY = f"""untidy as (
  select distinct '{B}s' || s_suppkey as uri, s_name ||
    case when l_linenumber % 2 = 0 then '; ; ;  ;' else '; ' end || 'B' || l_linenumber as label
  from lineitem join supplier on l_suppkey = s_suppkey)"""
REPAIRED = r"regexp_replace({0}, '((;\s*)+;)', '', 'g')"

IDENT = f"""ident as (
  select 'Q' || c_custkey as value, '{M.WIKIDATA}Q' || c_custkey as uri, 'Q' || c_custkey as short
    from customer
  union all select cast(c_custkey as varchar), '{M.GEONAMES}' || c_custkey,
    cast(c_custkey as varchar) from customer
  union all select 'c' || c_custkey, '{B}c' || c_custkey, '{B}c' || c_custkey from customer
  union all select url, url, url from pages)"""

FORM_CLASS = "case left(o_orderpriority, 1) " + " ".join(
    f"when '{i}' then '{c}'" for i, c in
    (("1", M.ARTICLE), ("2", M.BOOK), ("3", M.CHAPTER), ("4", M.THESIS), ("5", M.REPORT))) + " end"
FORMS = f"""forms as (
  select '{B}o' || o_orderkey as work, '{B}o' || o_orderkey || '/' as g, {FORM_CLASS} as class,
    case o_orderstatus when 'F' then 'published' when 'O' then 'modified' else 'not modified' end
      as stage, 'u' || o_custkey || '@example.org' as who,
    '{B}u' || o_custkey || '-at-example-dot-org' as who_uri, 'Cited ' || o_orderkey as cit,
    'Title' || o_orderkey as title, '{M.WIKIDATA}Q' || o_custkey as author, c_name,
    '{V}' || year(o_orderdate) as year_uri, cast(year(o_orderdate) as varchar) as y,
    '{B}' || case when false then '' else '' end as pre, cast(o_orderkey as varchar) as word,
    '{B}c' || o_custkey as old
  from orders join customer on o_custkey = c_custkey)"""


def form_sql() -> str:
    def f(*args, **kw):
        return q(*args, src="forms", **kw)

    xs, later = M.XSD_STRING, "stage <> 'not modified'"
    word = f"('{M.GEONAMES}' || word)"
    return "with " + FORMS + " select * from (" + " union ".join([
        f("work", M.RDF_TYPE, "class", "uri"),
        f("g", M.ATTRIBUTED_TO, "who_uri", "uri", where="stage = 'not modified'"),
        f("g", M.INFLUENCED_BY, "who_uri", "uri", where=later),
        f("who_uri", M.RDFS_LABEL, "who"),
        f("g", M.GENERATED_AT, f"'{MOMENT}'", o_type=M.XSD_DATETIME),
        f("g", M.STATUS, "stage", o_type=xs),
        f("work", M.REFERENCED_BY, "cit"), f("g", M.REFERENCED_BY, "cit"),
        f("work", M.RDFS_LABEL, "cit"), f("g", M.RDFS_LABEL, "cit"),
        f("work", M.DCT_TITLE, "title"),
        f("work", M.AUTHOR_PROPS[0], "author", "uri"),
        f("author", M.RDFS_LABEL, "c_name", o_type=xs),
        f("work", M.PUBLICATION_DATE, "year_uri", "uri"),
        f("year_uri", M.RDFS_LABEL, "y", o_type=xs),
        f("work", M.KEYWORDS, word, "uri", where="stage = 'modified'"),
        f(word, M.RDFS_LABEL, "'Place ' || word", where="stage = 'modified'", o_type=xs),
        f("g", M.ATTRIBUTED_TO, "old", "uri", where=later),
        f("old", M.RDFS_LABEL, "c_name", where=later)]) + ")"


TEMPLATE_FILES = f"""files as (
  select r_name as template, '{B}' || lower(r_name) as class, r_name || '-' || n_nationkey as field_id,
    n_name as label, '{V}' || lower(n_name) as property, n_nationkey % 2 = 0 as browse,
    n_nationkey % 3 = 0 as disambiguate, cast(row_number() over (
      partition by r_name order by n_nationkey) as int) as position,
    cast((select nullif(count(*), 0) from customer where c_nationkey = n_nationkey) as int) as n_values
  from nation join region on n_regionkey = r_regionkey)"""
ESC = r"""replace(replace(o, '\', '\\'), '"', '\"')"""
NQ_LINE = f"""'<' || s || '> <' || p || '> ' || case when o_kind = 'uri' then '<' || o || '>'
  else '"' || {ESC} || '"' || case when o_type is null then '' else '^^<' || o_type || '>' end end
  || ' <' || g || '> .'"""

ORACLES: dict[str, str] = {
    "counters": f"""{W} select
        (select count(distinct l_suppkey) from lineitem) as n_authors,
        (select count(*) from orders) as n_publications,
        (select count(distinct n_name) from works) as n_languages,
        (select count(distinct seg) from works) as n_publishers,
        (select count(distinct title) from works where class = '{M.ARTICLE}') as n_journals,
        (select count(distinct p_type) + count(distinct p_brand) from lns) as n_topics""",
    "authors_per_year": per_year("select y, sk as x from works join lns using (k)"),
    "publications_per_year": per_year("select y, k as x from works"),
    "topics_per_year": per_year("""select y, p_type as x from works join lns using (k)
        union all select y, p_brand from works join lns using (k)"""),
    "publishers_per_year": per_year("select y, seg as x from works"),
    "authors_per_year_label": f"""{W} select y as year, count(distinct sk) as count
        from works join lns using (k) group by y""",
    "language_by_year": f"{W} select y as year, lower(n_name) as language, count(*) as count "
                        "from works group by all",
    "language_chart": f"{W} select y as year, " + ", ".join(
        f"nullif(count(case when lower(n_name) = 'nation_{i}' then 1 end), 0) as nation_{i}"
        for i in range(8)) + """, nullif(count(case when lower(n_name) not in (
        'nation_0', 'nation_1', 'nation_2', 'nation_3', 'nation_4', 'nation_5', 'nation_6', 'nation_7')
        then 1 end), 0) as other from works group by y""",
    "export_wide": W + EXPORT,
    "csv_export": f"""{W} select concat_ws(',', {", ".join(CSV_COLUMNS)}) as line
        from ({EXPORT})""",
    "ris_export": ris(),
    "citations_txt": f"{W} select cit || chr(10) as value from works",
    "chart_json": f"""{W} select '{{"year":"' || y || '","year_uri":"{V}' || y || '","count":'
        || count(*) || '}}' as point from works group by y""",
    "records": W + RECORDS,
    "records_page": f"{W} select * from ({RECORDS}) order by date desc, g limit 40 offset 40",
    "records_page_published": f"""{W} select * from ({RECORDS}) where stage = 'published'
        order by date desc, g limit 40 offset 80""",
    "stage_counts": f"""{W} select count(*) as n_all,
        count(case when status = 'not modified' then 1 end) as n_not_modified,
        count(case when status = 'modified' then 1 end) as n_modified,
        count(case when status = 'published' then 1 end) as n_published from works""",
    "count_records": f"{W} select count(*) as n_records from works where status = 'published'",
    "explore": f"""{W} select class, count(*) as n_records,
        count(case when status = 'published' then 1 end) as n_published,
        count(case when status <> 'not modified' then 1 end) as n_listed,
        case class when '{M.CHAPTER}' then 7 when '{M.THESIS}' then 7 else 6 end::bigint
          as n_filters from works group by class""",
    "class_of": f"""{W} select work as uri, class from works
        union all select '{B}s' || s_suppkey, '' from supplier""",
    "record_fields": f"{WL}, {FIELDS}, {RECORD_FIELDS} select distinct * from rf",
    "record_view": f"""{WL}, {FIELDS}, {RECORD_FIELDS}
        select distinct rf.g, w.cit as title,
          case class when '{M.ARTICLE}' then 'Journal article' when '{M.BOOK}' then 'Book'
            when '{M.CHAPTER}' then 'Book chapter' when '{M.THESIS}' then 'Doctoral thesis'
            else 'Report' end as class_name, status <> 'published' as is_draft,
          f.label as field, value, coalesce(rf.label, value) as label
        from rf join fields f using (template, field_id) join works w on w.g = rf.g""",
    "describe": f"{WQ}, {NAMES} select * from about",
    "term_usage": f"""{WQ}, {NAMES} select name, count(*) as n_rows,
        count(distinct s) as n_subjects from about
        where o_kind = 'uri' and contains(o, name) group by name""",
    "back_links": f"""{WL} select uri, rank, subject, label from (
        select uri, row_number() over (partition by uri order by subject) as rank, subject, label
        from (select distinct l.target as uri, l.work as subject, w.title as label
          from links l join works w on w.k = l.k where role = 'author'))
        where rank between 11 and 20""",
    "facet_counts": f"""{WL} select role, p as property, target as value, min(label) as label,
        count(distinct work) as n_subjects, count(distinct work) as n_rows
        from links where status <> 'not modified' group by 1, 2, 3""",
    "facet_counts_articles": f"""{WL} select role, p as property, target as value,
        min(label) as label, count(distinct work) as n_subjects, count(distinct work) as n_rows
        from links where status <> 'not modified' and class = '{M.ARTICLE}'
          and role in ('container', 'year') group by 1, 2, 3""",
    "records_by_facet": f"""{W} select {CONTAINER} as value, work, title as label
        from works where status <> 'not modified' and title is not null""",
    "alpha_index": f"""{W} select class, upper(left(cit, 1)) as letter, count(*) as n_records
        from works where status <> 'not modified' group by 1, 2""",
    "alpha_listing": f"""{W} select class, upper(left(cit, 1)) as letter, g, cit as title
        from works where status <> 'not modified'""",
    "data_profile": rf"""{WL}, facts as (
          select class, p, work, target as v from links
          union select class, '{M.DCT_TITLE}', work, title from works where title is not null
          union select class, '{M.REFERENCED_BY}', work, cit from works),
        camel as (select class, p as property,
          regexp_replace(regexp_replace(split_part(split_part(x, '/', -1), '#', -1),
            '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g') as property_name,
          regexp_replace(split_part(class, '/', -1), '([a-z])([A-Z])', '\1 \2', 'g') as class_name
          from (select distinct class, p, p as x from facts))
        select f.*, c.class_name, c.property_name, n_works / cast(n as double) as fill_rate from (
          select class, p as property, count(distinct work) as n_works,
            count(distinct v) as n_values from facts group by 1, 2) f
        join (select class, count(*) as n from works group by 1) t on t.class = f.class
        join camel c on c.class = f.class and c.property = f.property""",
    "search_title": f"""{W} select work, title from (select *, {toks('title')} as tk from works)
        where list_contains(tk, 'red') and
          len(list_filter(tk, lambda t: starts_with(t, 'wid'))) > 0""",
    "search_label": f"""{WL} select distinct work, label from links
        where role = 'author' and lower(label) = 'supplier#000000012'""",
    "advanced_search": rf"""{W} select
          regexp_replace(split_part(class, '/', -1), '([a-z])([A-Z])', '\1 \2', 'g') as worktype,
          cit as citation, y as year, split_part(work, '/', -1) as workid, '' as doi
        from works where y in ('1997', '1999') and n_name in ('NATION_3', 'NATION_4')
          and k in (select k from lns)
          and len(list_filter({toks('title')}, lambda t: starts_with(t, 're'))) > 0""",
    "filter_checkbox": f"""{W} select work from works
        where y::int <= (select min(y::int) + 1 from works)""",
    "suggest_topk": suggestion(f"""
        select target as uri, label from links
        union select '{B}j-' || replace(p_name, ' ', '-'), p_name from part
        union select '{V}' || {SLUG_BRAND}, p_brand from part
        union select '{V}' || lower(p_type), p_type from part
        union select '{B}s' || s_suppkey, s_name from supplier
        union select '{B}c' || c_custkey, c_name from customer
        union select '{V}' || lower(n_name), n_name from nation
        union select '{B}p-' || lower(c_mktsegment), c_mktsegment from customer
        union select work, title from works where title is not null""", 35, 0.5),
    "suggest_works": suggestion(
        "select work as uri, title as label from works where title is not null", 10, 0.3),
    "prior_records": f"""{W}, hits as (
          select distinct p.p_name as query, work as uri, title as label, len(list_intersect(
              list_distinct({toks('title')}), {toks('p.p_name')}))
            / cast(len(list_distinct({toks('title')})) as double) as score
          from (select distinct p_name from part) p join works
            on list_has_all({toks('title')}, {toks('p.p_name')})
          where class = '{M.ARTICLE}'),
        ranked as (select query, row_number() over (partition by query order by score desc, uri)
          as rank, uri, label, score from hits)
        select * from ranked where rank <= 5""",
    "label_search_batch": f"""with docs as (
          select cast(doc_id as varchar) as uri, list_distinct({toks('text')}) as tk
          from documents),
        asked as (select distinct query, list_distinct({toks('query')}) as q from (
          select text as query from benchmark union all select label from ({SITES})))
        select query, uri, len(q) / cast(len(tk) as double) as score
        from asked, docs where len(q) > 0 and list_has_all(tk, q)""",
    "mention_links": f"""{W}, ent as (
          select distinct {CONTAINER} as uri, title as label from works where title is not null
          union select '{B}j-' || replace(p_name, ' ', '-'), p_name from part
          union select '{B}c' || c_custkey, c_name from customer),
        named as (select uri, label, array_to_string({toks('label')}, ' ') as gram from ent),
        txt as (select work as doc, ' ' || array_to_string({toks('cit')}, ' ') || ' ' as t
          from works)
        select doc, uri, label from (
          select doc, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)),
            lambda i: w[i] || ' ' || w[i + 1])))) as gram
          from (select doc, string_split(trim(t), ' ') as w from txt)) join named using (gram)""",
    "mention_links_documents": f"""with sites as ({SITES}),
        txt as (select doc_id as doc, unnest(list_distinct({toks('text')})) as label
          from documents)
        select doc, '{B}site-' || label as uri, label from txt join sites using (label)""",
    "vocab_violations": f"""with {BATCH}
        select 'lang' as column, lang as value, count(*) as n_rows from batch group by 2
        union all select 'year', year, count(*) from batch
          where year not in (select cast(year(o_orderdate) as varchar) from orders) group by 2
        union all select 'publisher', publisher, count(*) from batch
          where replace(lower(publisher), '-', ' ') not in (
            select replace(lower(replace(c_mktsegment, 'U', '-')), '-', ' ') from customer)
          group by 2""",
    "unique_values": f"with {BATCH} " + " union ".join(
        f"select trim({c}) as value from batch where {c} is not null" for c in PEOPLE),
    "name_variants": r"""with spelled as (
          select trim(case when l_quantity = 1 then ' - '
              when l_linenumber = 7 then s_name || ' & Co'
              when l_linestatus = 'O' then replace(s_name, '#', '. ') else s_name end) as label,
            count(*) as n_rows
          from lineitem join supplier on l_suppkey = s_suppkey group by 1),
        keyed as (select *, regexp_replace(lower(label), '[^\p{L}\p{N}]+', '', 'g') as key
          from spelled),
        counted as (select key, label, n_rows, count(*) over (partition by key) as n_variants,
          key = '' as is_placeholder, contains(label, ' & ') as has_two_names from keyed)
        select * from counted where n_variants > 1 or is_placeholder or has_two_names""",
    "drop_existing": f"""{WB}, rows_b as (
          select *, regexp_replace(title, ' [0-9]+$', '') as t from batch)
        select id, author_1, t as title, year from rows_b b
        where not exists (select 1 from works w join lns l on l.k = w.k and l.n = 1
          where l.s_name = trim(b.author_1) and w.title = trim(replace(b.t, '"', ''))
            and w.y = b.clean_year)""",
    "broken_labels": f"with {UNTIDY} select * from untidy where contains(label, '; ;')",
    "repair_labels": f"""with {UNTIDY} select *, {REPAIRED.format('label')} as repaired
        from untidy where contains(label, '; ;')""",
    "label_update": f"""{W}, hurt as (select *, replace(cit, '. ', '; ; ') as bad from works)
        select g as s, '{M.RDFS_LABEL}' as p, case status
            when 'published' then {REPAIRED.format('bad')} when 'modified' then bad
            else cit end as o, g from hurt
        union all select work, '{M.REFERENCED_BY}', case status
            when 'published' then {REPAIRED.format('bad')} else cit end, g from hurt""",
    "norm_year": f"""with {BATCH} select distinct year as raw, clean_year as year from batch""",
    "norm_doi": f"""with {BATCH} select id, clean_doi as doi,
        case cast(substr(id, 2) as bigint) % 3 when 0 then 'http://.org/' when 1 then 'https://dx..org/' else '' end
          || clean_doi as as_written from batch""",
    "norm_link": f"""with {BATCH} select id, nullif(link, 'Not found') as link from batch""",
    "norm_title": f"""with {BATCH} select id, replace(trim(title), '"', '') as title from batch""",
    "norm_pages": f"""with {BATCH} select id, volume[2:len(volume) - 1] as volume, issue,
        pages[2:len(pages) - 1] as pages,
        case when length(issue) > 1 then issue end as issue_as_written from batch""",
    "split_themes": f"""with {BATCH} select id, unnest(list_concat(types, brands)) as theme
        from batch where types is not null""",
    "people": f"""select distinct '{B}s' || s_suppkey as uri, s_name as label
        from supplier join lineitem on l_suppkey = s_suppkey""",
    "journals": f"""{W} select distinct {CONTAINER} as uri, title as label from works
        where class = '{M.ARTICLE}' and title is not null""",
    "books": f"""{W} select distinct {CONTAINER} as uri, title as label from works
        where class = '{M.CHAPTER}' and title is not null""",
    "publishers": f"{W} select distinct '{B}p-' || lower(seg) as uri, seg as label from works",
    "entities": f"{W}, {KNOWN} select * from known",
    "match_entities": f"""{WB}, {KNOWN}, {BATCH_NAMES}
        select n.kind, n.label, min(uri) as uri,
          case when min(uri) is null then 'NEW' else 'MATCH' end as status
        from names n left join known k on k.kind = n.kind and k.label = n.label group by 1, 2""",
    "mint_uris": f"""{WB}, {KNOWN}, {BATCH_NAMES}
        select kind, label, '{B}' || sha256(kind || '#' || label) as uri from names
        where (kind, label) not in (select kind, label from known)""",
    "vocab_uri": f"""select n_name as label, '{V}' || lower(n_name) as uri from nation
        union all select 'Higher Education in ' || n_name, '{V}higher-education-research'
          from nation
        union all select distinct p_brand || ' ' || p_name,
          '{V}' || replace(lower(p_brand || ' ' || p_name), ' ', '-') from part""",
    "work_class": f"""with {BATCH} select type as kind, case type
          when 'Article' then '{M.ARTICLE}' when 'Book' then '{M.BOOK}'
          when 'Book chapter' then '{M.CHAPTER}' when 'Doctoral Thesis' then '{M.THESIS}'
          when 'Journal Issue' then '{M.JOURNAL_ISSUE}' when 'Report' then '{M.REPORT}'
          else '{M.WORK}' end as class, count(*) as n_rows from batch group by 1, 2""",
    "class_to_template": f"""with {BATCH} select case type
          when 'Article' then 'article' when 'Book' then 'book'
          when 'Book chapter' then 'book_chapter' when 'Doctoral Thesis' then 'doctoral_thesis'
          when 'Journal Issue' then 'journal_issue' else 'report' end as template,
          count(*) as n_rows from batch group by 1""",
    "uri_base": f"with {IDENT} select value, uri from ident",
    "short_uri": f"with {IDENT} select uri, short from ident",
    "user_codec": """select u as user, replace(replace(u, '@', '-at-'), '.', '-dot-') as encoded,
        u as decoded from (select replace(lower(c_name), '#', '.') || '@example.org' as u
          from customer)""",
    "rows_to_quads": f"{WR} select * from (" + " union ".join(
        [SCALARS, ET_AL, LANGUAGE, PROVENANCE, subject_quads(), *map(name_quads, ROLES)]) + ")",
    "row_authors": f"{WR} select * from ({name_quads('author')})",
    "row_editors": f"{WR} select * from ({name_quads('editor')})",
    "container": f"{WR} select * from ({name_quads('container')})",
    "row_publisher": f"{WR} select * from ({name_quads('publisher')})",
    "et_al": f"{WR} select * from ({ET_AL})",
    "row_subjects": f"{WR} select * from ({subject_quads()})",
    "row_language": f"{WR} select * from ({LANGUAGE})",
    "row_scalars": f"{WR} select * from ({SCALARS})",
    "row_provenance": f"{WR} select * from ({PROVENANCE})",
    "citation": f"{WR} select work, cit as citation from cited",
    "form_quads": form_sql(),
    "load_graph": f"""{WQ} select * from quads
        union select work, '{M.RDFS_LABEL}', 'again', 'literal', null, g from works""",
    "clear_graphs": f"""{WQ} select * from quads where g not in (
          select g from works where status = 'not modified')""",
    "delete_records": f"""{WQ} select * from quads where g not in (
          select g from works where class = '{M.REPORT}')""",
    "record_creators": f"""{W} select g, '{B}c' || ck as creator, c_name as creator_label
        from works""",
    "upsert_records": f"""{WQ}, articles as (select * from works where class = '{M.ARTICLE}')
        select * from quads where g not in (select g from articles) union """ + " union ".join([
            q("work", M.RDF_TYPE, "class", "uri", src="articles"),
            q("work", M.DCT_TITLE, "('New ' || work)", src="articles"),
            q("g", M.STATUS, "'published'", o_type=M.XSD_STRING, src="articles"),
            q("g", M.GENERATED_AT, f"'{MOMENT}'", o_type=M.XSD_DATETIME, src="articles"),
            q("g", M.INFLUENCED_BY, USER, "uri", src="articles"),
            q(USER, M.RDFS_LABEL, f"'{CREATOR}'", src="articles"),
            q("g", M.ATTRIBUTED_TO, f"('{B}c' || ck)", "uri", src="articles"),
            q(f"('{B}c' || ck)", M.RDFS_LABEL, "c_name", src="articles")]),
    "bucket_deletes": f"""{WQ} select * from quads where g not in (
          select g from works where class = '{M.REPORT}' or status = 'not modified')""",
    "import_upserts": f"""{WQ}, articles as (select * from works where class = '{M.ARTICLE}')
        select * from quads where g not in (select g from articles) and g <> '{M.VOCAB_GRAPH}' union """ + " union ".join([
            q("work", M.RDF_TYPE, "class", "uri", src="articles"),
            q("work", M.DCT_TITLE, "('New ' || work)", src="articles"),
            q("g", M.GENERATED_AT, "'2030-01-01T00:00:00'", o_type=M.XSD_DATETIME, src="articles")]),
    "nquads_lines": f"{WQ} select {NQ_LINE} as value from quads",
    "read_records": f"{WQ} select s, p, o, o_kind, o_type, true as by_file from quads",
    "import_stream": f"{WQ} select * from quads",
    "read_batch": f"""with {BATCH} select id, cast(null as varchar) as "reference (apa)",
        type as "publication type", title, {", ".join(PEOPLE)}, journal, volume, issue, pages, year,
        '[''' || array_to_string(types, ''', ''') || ''']' as main_theme,
        '[''' || array_to_string(brands, ''', ''') || ''']' as secondary_theme,
        lang, link, doi, booktitle, publisher from batch""",
    "check_columns": """select cast(row_number() over (order by r_name) as int) as position,
        r_name as column from region""",
    "missing_cells": """select o_orderkey, case when o_custkey % 4 = 3 then o_orderpriority end as value
        from orders""",
    "read_templates": f"""with {TEMPLATE_FILES} select template, class, field_id, label, property,
        'Dropdown' as field_type, 'URI' as value_kind, browse, disambiguate, position,
        n_values as values from files""",
    "import_vocabs": f"""select distinct '{B}c' || c_custkey as s, '{M.RDFS_LABEL}' as p, c_name as o,
        'literal' as o_kind, cast(null as varchar) as o_type, '{M.VOCAB_GRAPH}' as g
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "browse_filters": f"""with {TEMPLATE_FILES} select template, class, property, label,
        'Dropdown' as field_type, 'URI' as value_kind, position from files where browse or disambiguate""",
    "read_authority": """select distinct 'publishers' as kind, c_mktsegment || ', Ltd' as label
        from customer union all select 'people', c_name from customer where c_custkey % 2 = 0""",
    "request_verdicts": """select event_id, ts, user_id, event_type, day, n_requests, n_requests > 3 as blocked from (
        select *, cast(ts as date) as day, count(*) filter (where event_type in ('purchase', 'signup')) over (
          partition by user_id, cast(ts as date) order by ts, event_id rows unbounded preceding) as n_requests
        from events)""",
    "daily_quota": f"""select cast(user_id as varchar) as client, cast(ts as date) as day,
        count(*) as n_requests, count(*) > {QUOTA} as blocked from events group by 1, 2""",
}
ORACLES |= {
    "sketched_counters": f"select *, true as close from ({ORACLES['counters']})",
    "delta_series": f"""{WL}, now as (
          select work, class, y from works where class not in ('{M.ARTICLE}', '{M.REPORT}')
          union all select work, class, '1999' from works where class = '{M.ARTICLE}'),
        facts as (select 'publications' as series, '{V}' || y as year_uri, work as x from now
          union all select case role when 'author' then 'authors' when 'publisher' then 'publishers'
              when 'language' then 'languages' else 'topics' end, '{V}' || now.y, target
            from links join now using (work)
            where now.class <> '{M.ARTICLE}' and role in ('author', 'publisher', 'language', 'primary_subject', 'subject'))
        select series, year_uri, count(distinct x) as count from facts group by series, year_uri""",
    "similar_names": """with docs as (
          select doc_id, regexp_extract(lower(text), '^([a-z]{4,20} [a-z]{4,20}) ', 1) as name from documents),
        spelled as (
          select case doc_id % 4 when 1 then substr(name, 2) when 2 then 'Dr. ' || name else name end as label
            from docs where name <> ''
          union all select name from docs where name <> ''),
        labels as (select label, regexp_replace(lower(label), '[^a-z]', '', 'g') as key, count(*) as n from spelled group by 1, 2),
        keys as (select key, arg_min(label, (-n, label)) as label, sum(n)::bigint as n from labels group by key)
        select a.key as key_a, b.key as key_b, levenshtein(a.key, b.key)::int as distance, a.label as label_a, b.label as label_b,
          a.n as n_rows_a, b.n as n_rows_b
        from keys a join keys b on a.key < b.key
          and 100 * (greatest(length(a.key), length(b.key)) - levenshtein(a.key, b.key))
            >= 75 * greatest(length(a.key), length(b.key))""",
}
ORACLES |= {f"stored_{name}": ORACLES[of] for name, of in (
    ("suggest_topk", "suggest_topk"), ("prior_records", "prior_records"), ("search_title", "search_title"),
    ("search_label", "search_label"), ("label_search", "label_search_batch"), ("records_page", "records_page"),
    ("records_page_published", "records_page_published"), ("back_links", "back_links"))}
ORACLES["bucket_upserts"] = ORACLES["upsert_records"]
ORACLES["daily_quota_stream"] = ORACLES["quota_log"] = ORACLES["daily_quota"]

# The same questions to the catalogue out of a dump.
ORACLES |= {f"dump_{name}": ORACLES[name] for name in (
    "counters", "export_wide", "records", "stage_counts", "facet_counts")}
ORACLES |= {
    "dump_facet_counts_keywords": f"""{W} select 'keyword' as role, '{M.KEYWORDS}' as property,
        '{B}k' || ck as value, min('Keyword ' || k) as label, count(*) as n_subjects,
        count(*) as n_rows from works where status <> 'not modified' group by ck""",
    "dump_record_fields": f"""{WL}, {FIELDS}, {RECORD_FIELDS} select distinct * from rf
        union select g, case class when '{M.ARTICLE}' then 'article' when '{M.BOOK}' then 'book'
          when '{M.CHAPTER}' then 'book_chapter' when '{M.THESIS}' then 'doctoral_thesis'
          else 'report' end as template, 'keywords' as field_id, '{B}k' || ck as value,
          'Keyword ' || k as label from works""",
    "nquads_documents": """select doc_id, lang, sha256(text) as text_sha256, length(text) as n_chars
        from documents where text is not null""",
    "scalar_keys": """select o_orderkey, replace(lower(o_orderpriority), ' ', '_') as id,
        upper(o_orderstatus) as status, regexp_matches(cast(o_custkey as varchar), '^[0-9]+$') as is_number,
        regexp_matches(o_orderpriority, '^[0-9]+$') as priority_is_number,
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as moment from orders""",
}
