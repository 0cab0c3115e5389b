"""License scan: ordered signature rules over normalised words, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# label, pattern of the name in normalised words, identifier words, keyword or keywords of which every name has one
FAMILIES = [
    ("apache-1.1", rf"apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?1 1", "apache 1 1", "apache"),
    ("apache-2.0", rf"apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?2(?: 0)?", "apache 2 0", "apache"),
    ("apache-any", r"apache(?: software)?(?: foundation)?", "apache", "apache"),
    ("mit", r"(?:mit|expat)(?: x11)?", "mit", ("mit", "expat")),
    ("mit-0", r"mit no attribution", "mit 0", "mit"),
    ("x11", r"x11(?: consortium)?", "x11", "x11"),
    ("gpl-2.0", r"(?:gnu )?(?:general public licen[sc]e|gpl)(?: version| v)? ?2(?: 0)?", "gpl 2 0", "g"),
    ("gpl-3.0", r"(?:gnu )?(?:general public licen[sc]e|gpl)(?: version| v)? ?3(?: 0)?", "gpl 3 0", "g"),
    ("gpl-any", r"gnu (?:general public licen[sc]e|gpl)", "gpl", "gnu"),
    ("lgpl-2.1", r"(?:gnu )?(?:(?:lesser|library) general public licen[sc]e|lgpl)(?: version| v)? ?2(?: 1| 0)?", "lgpl 2 1", "l"),
    ("lgpl-3.0", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?: version| v)? ?3(?: 0)?", "lgpl 3 0", "l"),
    ("lgpl-any", r"(?:gnu )?(?:(?:lesser|library) general public licen[sc]e|lgpl)", "lgpl", "l"),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public licen[sc]e|agpl)(?: version| v)?(?: ?3(?: 0)?)?", "agpl 3 0", "a"),
    ("gfdl", r"(?:gnu )?(?:free documentation licen[sc]e|gfdl|fdl)", "gfdl 1 3", "f"),
    ("bsd-2-clause", r"(?:simplified|freebsd|2 clause|two clause)(?: bsd)?", "bsd 2 clause", ("simplified", "freebsd", "2 clause", "two clause")),
    ("bsd-3-clause", r"(?:new|modified|revised|3 clause|three clause) bsd", "bsd 3 clause", "bsd"),
    ("bsd-4-clause", r"(?:original|4 clause|four clause) bsd", "bsd 4 clause", "bsd"),
    ("bsd-0-clause", r"(?:zero clause|0 clause) bsd", "0bsd", "bsd"),
    ("bsd-any", r"(?:berkeley software distribution|bsd)(?: style)?", "bsd", "b"),
    ("isc", r"(?:isc|internet systems consortium)", "isc", ("isc", "internet systems")),
    ("mpl-1.1", r"(?:mozilla public licen[sc]e|mpl)(?: version| v)? ?1(?: 0| 1)", "mpl 1 1", "m"),
    ("mpl-2.0", r"(?:mozilla public licen[sc]e|mpl)(?: version| v)? ?2(?: 0)?", "mpl 2 0", "m"),
    ("mpl-any", r"mozilla(?: public)?", "mpl", "mozilla"),
    ("epl-1.0", r"(?:eclipse public licen[sc]e|epl)(?: version| v)? ?1(?: 0)?", "epl 1 0", "e"),
    ("epl-2.0", r"(?:eclipse public licen[sc]e|epl)(?: version| v)? ?2(?: 0)?", "epl 2 0", "e"),
    ("eupl", r"(?:european union public licen[sc]e|eupl)(?: version| v)?(?: 1 [012])?", "eupl 1 2", "eu"),
    ("cddl", r"(?:common development and distribution licen[sc]e|cddl)(?: 1 [01])?", "cddl 1 0", "d"),
    ("cpl-1.0", r"common public(?: licen[sc]e)?(?: version| v)?(?: 1 0)?", "cpl 1 0", "common"),
    ("artistic", r"artistic(?: licen[sc]e)?(?: [12] 0)?", "artistic 2 0", "artistic"),
    ("zlib", r"zlib(?: libpng)?", "zlib", "zlib"),
    ("boost-1.0", r"(?:boost software licen[sc]e|bsl)(?: version| v)?(?: 1 0)?", "bsl 1 0", "b"),
    ("unlicense", r"(?:the )?unlicen[sc]e", "unlicense", "unlicen"),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to)", "wtfpl", "w"),
    ("cc0-1.0", r"(?:cc0|cc zero|creative commons zero)(?: 1 0)?", "cc0 1 0", "c"),
    ("cc-by", r"(?:cc|creative commons) (?:by|attribution)(?: [1234] [05])?(?: international)?", "cc by 4 0", "c"),
    ("cc-by-sa", r"(?:cc|creative commons) (?:by sa|attribution share ?alike)(?: [1234] [05])?(?: international)?", "cc by sa 4 0", "c"),
    ("cc-by-nc", r"(?:cc|creative commons) (?:by nc|attribution non ?commercial)(?: [1234] [05])?(?: international)?", "cc by nc 4 0", "c"),
    ("cc-by-nd", r"(?:cc|creative commons) (?:by nd|attribution no ?deriv\w*)(?: [1234] [05])?(?: international)?", "cc by nd 4 0", "c"),
    ("cc-by-nc-sa", r"(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)(?: [1234] [05])?(?: international)?", "cc by nc sa 4 0", "c"),
    ("cc-by-nc-nd", r"(?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv\w*)(?: [1234] [05])?(?: international)?", "cc by nc nd 4 0", "c"),
    ("odbl", r"(?:open database licen[sc]e|odbl)(?: 1 0)?", "odbl 1 0", ("odbl", "open database")),
    ("odc-by", r"open data commons(?: attribution)?", "odc by 1 0", "open data"),
    ("ofl-1.1", r"(?:sil )?(?:open font licen[sc]e|ofl)(?: 1 [01])?", "ofl 1 1", "f"),
    ("python-2.0", r"(?:python software foundation|psf)(?: licen[sc]e)?(?: version| v)?(?: 2(?: 0)?)?", "python 2 0", "p"),
    ("openssl", r"openssl", "openssl", "openssl"),
    ("ncsa", r"(?:university of illinois|ncsa)(?: open source)?", "ncsa", "n"),
    ("postgresql", r"postgresql", "postgresql", "postgresql"),
    ("ms-pl", r"microsoft public", "ms pl", "microsoft"),
    ("ms-rl", r"microsoft reciprocal", "ms rl", "microsoft"),
    ("afl-3.0", r"academic free(?: licen[sc]e)?(?: 3 0)?", "afl 3 0", "academic"),
    ("osl-3.0", r"open software licen[sc]e(?: 3 0)?", "osl 3 0", "open software"),
    ("upl-1.0", r"universal permissive", "upl 1 0", "universal"),
    ("blue-oak", r"blue oak model", "blueoak 1 0 0", "blue"),
    ("elastic-2.0", r"elastic", "elastic 2 0", "elastic"),
    ("sspl-1.0", r"(?:server side public licen[sc]e|sspl)", "sspl 1 0", "s"),
    ("busl-1.1", r"business source", "busl 1 1", "business"),
]
# priority, pattern round a name {n} or an identifier {i}, keyword that the frame needs
FRAMES = [
    (10, r"spdx licen[sc]e identifier {i}", "spdx"),
    (9, r"dual licen[sc]ed under (?:the )?{n}(?: licen[sc]e)?", "dual licen"),
    (8, r"(?:released|licen[sc]ed|distributed|published|available|provided|covered) (?:under|by) (?:the )?"
        r"(?:terms (?:and conditions )?of (?:the )?)?{n}(?: public)?(?: licen[sc]e)?", "e"),
    (7, r"(?:see|read|subject to|governed by|according to|in accordance with) (?:the )?{n}(?: public)? licen[sc]e", "licen"),
    (6, r"{n}(?: public)? licen[sc]e(?: version [0-9]+(?: [0-9]+)?)?", "licen"),
    (4, r"{n} licen[sc]ed", "licen"),
]
_UNDER = (r"(?:released|licen[sc]ed|distributed|published|available|provided|covered) (?:under|by) (?:the )?"
          r"(?:terms (?:and conditions )?of (?:the )?)?")
# label, priority, whole pattern, keyword
NOTICES = [
    ("gpl-any", 8, _UNDER + r"gpl", "gpl"),
    ("gpl-any", 8, _UNDER + r"general public licen[sc]e", "general public"),
    ("gpl-any", 6, r"gpl(?: public)? licen[sc]e", "gpl"),
    ("gpl-any", 4, r"gpl(?: licen[sc]ed| compatible)", "gpl"),
    ("gpl-2.0", 8, r"(?:gnu )?gplv2", "gplv2"),
    ("gpl-3.0", 8, r"(?:gnu )?gplv3", "gplv3"),
    ("lgpl-2.1", 8, r"(?:gnu )?lgplv2(?: 1)?", "lgplv2"),
    ("lgpl-3.0", 8, r"(?:gnu )?lgplv3", "lgplv3"),
    ("agpl-3.0", 8, r"(?:gnu )?agplv3", "agplv3"),
    ("gpl-any", 7, r"(?:either version [123](?: 0)? of the licen[sc]e or at your option|gpl [123](?: 0)? or) any later version",
     "any later version"),
    ("mit", 9, r"permission is hereby granted free of charge to any person obtaining a copy", "permission"),
    ("isc", 8, r"permission to use copy modify and or distribute this software for any purpose", "permission"),
    ("bsd-any", 8, r"redistribution and use in source and binary forms", "redistribution"),
    ("unlicense", 8, r"free and unencumbered software released into the public domain", "unencumbered"),
    ("public-domain", 6, r"(?:dedicated to|placed in|released into|in) the public domain", "public domain"),
    ("proprietary", 5, r"all rights reserved", "all rights"),
    ("proprietary", 6, r"(?:confidential and proprietary|proprietary and confidential)", "proprietary"),
    ("proprietary", 6, r"unauthori[sz]ed (?:copying|use|reproduction|distribution)", "unauthori"),
    ("copyright-notice", 3, r"copyright (?:c )?(?:19|20)[0-9]{2}", "copyright"),
    ("no-warranty", 2, r"(?:as is without|without any|there is no) warrant(?:y|ies)", "warrant"),
    ("unnamed", 1, r"this (?:work|software|program|file|document) is licen[sc]ed", "licen"),
    ("unnamed", 1, r"licen[sc]ed (?:to|under) [a-z]", "licen"),
]


def rules() -> list[tuple[str, int, str, str, tuple[str, ...]]]:
    """(label, priority, pattern, keyword, further keywords) of all signature rules, first ones first.

    Every match holds the keyword and one of the further ones. An identifier is its own keyword.
    """
    out = []
    for p, frame, word in FRAMES:
        for label, name, ident, key in FAMILIES:
            keys = ident if "{i}" in frame else key
            out.append((label, p, frame.replace("{n}", name).replace("{i}", ident), word,
                        (keys,) if isinstance(keys, str) else keys))
    out += [(label, p, pattern, word, (word,)) for label, p, pattern, word in NOTICES]
    return sorted(out, key=lambda r: -r[1])


GATE = (r"licen[sc]|spdx|gpl|copyright|public|rights|warrant|redistribution|proprietary|unauthori|permission"
        r"|unencumbered|released|distributed|published|available|provided|covered")
_MATCH = "struct<start:int,end:int,priority:int,label:string>"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found() -> str:
    """SQL: all matches in `norm` of the rules whose keywords occur, with their places in characters."""
    table = ", ".join(f"named_struct('label', {_quoted(label)}, 'priority', {p}, 'pattern', "
                      f"{_quoted('(?<= )(?:' + pattern + ')(?= )')}, 'one', {_quoted(a)}, 'two', array({', '.join(map(_quoted, b))}))"
                      for label, p, pattern, a, b in rules())
    return f"""flatten(transform(
      filter(array({table}), r -> contains(norm, r.one) and exists(r.two, k -> contains(norm, k)) and norm rlike r.pattern),
      r -> aggregate(
        arrays_zip(split(norm, r.pattern, -1), regexp_extract_all(norm, r.pattern, 0)),
        named_struct('at', 0, 'found', cast(array() as array<{_MATCH}>)),
        (acc, x) -> named_struct(
          'at', acc.at + char_length(x['0']) + coalesce(char_length(x['1']), 0),
          'found', if(x['1'] is null, acc.found, concat(acc.found, array(named_struct(
            'start', acc.at + char_length(x['0']), 'end', acc.at + char_length(x['0']) + char_length(x['1']),
            'priority', r.priority, 'label', r.label))))),
        acc -> acc.found)))"""


# longest first from each start; of equal intervals the higher priority, then the smaller label
_SORTED = """array_sort(found, (a, b) -> case
  when a.start != b.start then a.start - b.start when a.end != b.end then b.end - a.end
  when a.priority != b.priority then b.priority - a.priority
  when a.label < b.label then -1 when a.label > b.label then 1 else 0 end)"""
_KEPT = f"""aggregate({_SORTED},
  named_struct('top', -1, 'kept', cast(array() as array<{_MATCH}>)),
  (acc, x) -> if(x.end <= acc.top, acc, named_struct('top', x.end, 'kept', concat(acc.kept, array(x)))),
  acc -> acc.kept)"""


def scan_licenses(docs: DataFrame) -> DataFrame:
    """License statements of every text, one row per row of `docs`.

    Columns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. A-Z is
    lower-cased; words are runs of digits, letters and all characters beyond ASCII. Base
    phrases are counted where their words stand in a row; first_word and last_word are the
    smallest and largest word numbers at which one starts, null without any. Labels join
    those of the base phrases with those of the signature rules that stay. score is the
    highest priority that stays, in tenths; a base phrase counts 0.6 at least. Null text is
    empty. Rows are judged alone, so doc_id may be null or repeated; other columns are
    ignored; an empty table gives an empty result.

    Method: a keyword test gates a text before it is normalised, and each of several hundred
    rules has keywords of its own that gate its pattern. A match inside the interval of
    another match is dropped; of equal intervals the one with the higher priority stays.
    All of it is one projection of SQL functions: no shuffle, no Python.
    """
    phrase = "(?<= )(?:" + "|".join(BASE) + ")(?= )"
    words = f"regexp_extract_all(low, {_quoted(WORD)}, 0)"
    base = ", ".join(f"if(contains(norm, ' {p} '), array({_quoted(label)}), array())" for p, label in BASE.items())
    steps = [
        ("n_words", f"cast(regexp_count(low, {_quoted(WORD)}) as long)"),
        ("norm", f"if(low rlike {_quoted(GATE)}, concat(' ', array_join({words}, ' '), ' '), '')"),
        ("n_base", f"cast(if(norm = '', 0, regexp_count(norm, {_quoted(phrase)})) as long)"),
        ("gaps", f"if(n_base = 0, array(), split(norm, {_quoted(phrase)}, -1))"),
        ("last", f"if(n_base = 0, '', element_at(regexp_extract_all(norm, {_quoted(phrase)}, 0), -1))"),
        ("first_word", "if(n_base = 0, null, cast(length(regexp_replace(gaps[0], '[^ ]', '')) - 1 as long))"),
        ("last_word", "if(n_base = 0, null, n_words - (length(regexp_replace(element_at(gaps, -1), '[^ ]', '')) - 1)"
                      " - cast(length(regexp_replace(last, '[^ ]', '')) + 1 as long))"),
        ("found", f"if(norm = '', cast(array() as array<{_MATCH}>), {_found()})"),
        ("kept", f"if(size(found) = 0, found, {_KEPT})"),
        ("base", f"if(n_base = 0, cast(array() as array<string>), concat({base}))"),
        ("base_labels", "array_join(array_sort(array_distinct(base)), ',')"),
        ("labels", "array_join(array_sort(array_distinct(concat(base, kept.label))), ',')"),
        ("score", "greatest(if(n_base > 0, 0.6D, 0D), coalesce(array_max(kept.priority), 0) / 10D)"),
    ]
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("low"))
    for name, sql in steps:
        out = out.withColumn(name, F.expr(sql))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
