"""SQL of text queries on the same tables, for those that SQL can express."""

from __future__ import annotations

LLM_ORACLES: dict[str, str] = {}

# The letters A-Z alone change case; white space is the six ASCII characters.
_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LLM_ORACLES["op11_line_dedup"] = f"""
with lines as (
  select doc_id, i, line, translate(trim(line, {_WHITE}), {_FOLD}) as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)),
repeated as (
  select key, max(doc_id) as keep from lines where length(key) >= 40
  group by key having count(distinct doc_id) >= 5),
judged as (
  select l.*, r.key is not null and l.doc_id <> r.keep as dropped from lines l left join repeated r using (key))
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '')) as kept_sha256
from judged group by doc_id
"""

LLM_ORACLES["op13_collocations"] = f"""
with pieces as (
  select lang, row_number() over () as id, piece from (
    select coalesce(lang, 'und') as lang,
      unnest(string_split_regex(coalesce(text, ''), '[.,;:!?\\x0A-\\x0D]')) as piece from documents)),
words as (
  select lang, id, unnest(w) as w1, generate_subscripts(w, 1) as i from (
    select lang, id, list_filter(string_split_regex(translate(piece, {_FOLD}), '[ \\t]+'), lambda x: x <> '') as w
    from pieces)),
ahead as (
  select lang, w1, lead(w1, 1) over piece as w2, lead(w1, 2) over piece as w3
  from words window piece as (partition by id order by i)),
phrases as (
  select lang, 1 as k, w1 as phrase, w1, null as init, null as rest from ahead
  union all
  select lang, 2, w1 || ' ' || w2, w1, w1, w2 from ahead where w2 is not null
  union all
  select lang, 3, w1 || ' ' || w2 || ' ' || w3, w1, w1 || ' ' || w2, w2 || ' ' || w3 from ahead where w3 is not null),
f as materialized (
  select lang, k, phrase, any_value(w1) as w1, any_value(init) as init, any_value(rest) as rest, count(*) as a
  from phrases group by lang, k, phrase),
cuts as materialized (
  select lang, k, phrase, a, 1 as cut, w1 as lefts, rest as rights from f where k > 1 and a >= 10
  union all
  select lang, k, phrase, a, 2, init, substr(phrase, length(init) + 2) from f where k = 3 and a >= 10),
scored as (
  select c.*, l.a as l, r.a as r, (1000000::hugeint * c.a * c.a) // (l.a::hugeint * r.a) as score
  from cuts c join f l on l.lang = c.lang and l.phrase = c.lefts join f r on r.lang = c.lang and r.phrase = c.rights
  qualify row_number() over (partition by c.lang, c.phrase order by score, c.cut) = 1),
longer as (
  select lang, part, max(a) as a from (
    select lang, a, unnest([init, rest]) as part from f where k = 3 and a >= 10) group by lang, part),
totals as (select lang, sum(a)::bigint as n from f where k = 1 group by lang)
select s.lang, row_number() over (partition by s.lang order by s.score desc, s.a desc, s.phrase) as rank,
  s.phrase, s.a, s.l, s.r, t.n, s.score::bigint as score
from scored s join totals t using (lang) left join longer g on g.lang = s.lang and g.part = s.phrase
where g.a is null or 100 * g.a < 50 * s.a
qualify rank <= 2000
"""
