"""Cleaning of spreadsheet cells, labels and identifiers, as SQL expressions.

Every function takes a SQL expression (often a column name) and returns one, for
`expr`, `selectExpr` or `spark.sql`. They use built-in functions only, so the
work stays inside generated code.
"""

from __future__ import annotations

import re

from stemma import model as M

# Characters removed at both ends of a cell.
BLANKS = r"' \t\n\r\u000b\u000c'"


def lit(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip(x: str) -> str:
    return f"btrim({x}, {BLANKS})"


def cell(x: str) -> str:
    """Trimmed cell value; blanks and the text 'nan' are missing."""
    t = strip(x)
    return f"if(lower({t}) in ('', 'nan'), null, {t})"


def drop_parens(x: str) -> str:
    return f"translate({x}, '()', '')"


def norm_year(x: str) -> str:
    """Year as digits: parentheses dropped, decimals cut, NULL when unparsable."""
    whole = f"regexp_extract({strip(drop_parens(x))}, r'^([0-9]+)(\\.[0-9]*)?$', 1)"
    return f"if(length({strip(x)}) > 1, cast(try_cast({whole} as int) as string), null)"


def norm_doi(x: str, strict_reference: bool = False) -> str:
    """Bare lower-case DOI; NULL for one-character cells and 'not …' remarks."""
    t = f"lower({strip(x)})"
    if strict_reference:
        for text in ("https://doi.org/", "http://dx.doi.org/", "doi:", "doi"):
            t = f"replace({t}, '{text}')"
    else:
        t = f"regexp_replace({t}, r'^(https?://)?(dx\\.)?doi\\.org/', '')"
        t = f"regexp_replace({t}, r'^doi:?\\s*', '')"
    return f"if(not contains(lower({x}), 'not ') and length({x}) > 1, {strip(t)}, null)"


def norm_link(x: str) -> str:
    return f"if(not contains(lower({x}), 'not found') and length({x}) > 1, {strip(x)}, null)"


def norm_title(x: str) -> str:
    """Title without double quotes; NULL (row to skip) when shorter than two."""
    return f"if(length({x}) > 1, replace({strip(x)}, '\"'), null)"


def norm_number(x: str, strict_reference: bool = False) -> str:
    """Volume, issue or page range without parentheses."""
    shortest = 1 if strict_reference else 0
    return f"if(length({x}) > {shortest}, {drop_parens(strip(x))}, null)"


def split_themes(x: str, strict_reference: bool = False,
                 vocabulary: list[str] | None = None) -> str:
    """Array of theme labels of a cell such as ``['a', 'b']``.

    Commas inside a known vocabulary label do not split it, unless
    `strict_reference` asks for the plain split.
    """
    t = f"regexp_replace(regexp_replace({x}, r'^[\\[\\]]+', ''), r'[\\[\\]]+$', '')"
    if not strict_reference:
        for label in vocabulary or M.SUBJECTS:
            pieces = label.split(", ")
            if len(pieces) > 1:
                pattern = "(?i)" + ", ".join(f"({re.escape(p)})" for p in pieces)
                whole = "\\u0001".join(f"${i}" for i in range(1, len(pieces) + 1))
                t = f"regexp_replace({t}, r'{pattern}', '{whole}')"
    parts = f"split({t}, ', ')"
    clean = f"transform({parts}, v -> replace(replace(v, '\\u0001', ', '), '\\'', ''))"
    return f"if(length({x}) > 1 and length({parts}[0]) > 0, {clean}, null)"


def repair_label(x: str) -> str:
    """Remove runs of empty author slots such as '; ; ;'."""
    return f"regexp_replace({x}, r'((;\\s*)+;)', '')"


def last_segment(x: str) -> str:
    return f"substring_index({x}, '/', -1)"


def camel_words(x: str) -> str:
    """'BookChapter' → 'Book Chapter'."""
    return (f"regexp_replace({x}, "
            "r'(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])', ' ')")


def readable_name(uri: str) -> str:
    """Words of the last path or fragment segment of a term."""
    return camel_words(f"substring_index({last_segment(uri)}, '#', -1)")


def to_id(x: str) -> str:
    return f"replace(lower({x}), ' ', '_')"


def is_number(x: str) -> str:
    return f"{x} rlike r'^\\p{{N}}+$'"


def parse_moment(x: str) -> str:
    """Timestamp text to the second, fractions cut; NULL when not a moment."""
    return f"try_to_timestamp(substring({x}, 1, 19), \"yyyy-MM-dd'T'HH:mm:ss\")"


def encode_user(x: str) -> str:
    return f"replace(replace({x}, '@', '-at-'), '.', '-dot-')"


def decode_user(x: str) -> str:
    return f"replace(replace({x}, '-dot-', '.'), '-at-', '@')"


def tokens(x: str) -> str:
    """Lower-case runs of letters and digits, in text order."""
    return f"filter(split(lower({x}), r'[^\\p{{L}}\\p{{N}}]+'), t -> t <> '')"


def name_key(x: str) -> str:
    """Letters and digits only, lower-case: equal for spelling variants."""
    return f"regexp_replace(lower({x}), r'[^\\p{{L}}\\p{{N}}]+', '')"
