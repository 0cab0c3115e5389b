"""Bibliographic citation of a cleaned batch row as one SQL expression.

The expressions read the columns of `transform.clean_rows`: `kind` (lower-case
publication type), `author_k`, `editor_k`, `title`, `year`, `journal`, `volume`,
`issue`, `booktitle`, `publisher` and `pages`; missing values are NULL.
"""

from __future__ import annotations

PERIODICAL = "(contains(kind, 'issue') or contains(kind, 'article'))"
LOOSE_PART = "(contains(kind, 'incollection') and journal is null or contains(kind, 'misc'))"
# Types that name editors, and types that are part of a book.
EDITED = f"((contains(kind, 'book') or {LOOSE_PART}) and not {PERIODICAL})"
IN_BOOK = f"((contains(kind, 'book chapter') or {LOOSE_PART}) and not {PERIODICAL})"


def _names(word: str, first: int = 1) -> str:
    return ", ".join(f"{word}_{k}" for k in range(first, 11))


def _after(lead: str, x: str) -> str:
    """Lead text and value, nothing when the value is missing."""
    return f"coalesce('{lead}' || {x}, '')"


def citation() -> str:
    editors = (f"if(editor_2 is null, coalesce(editor_1, ''), "
               f"concat_ws('; ', coalesce(editor_1, ''), {_names('editor', 2)}))")

    def marked(one: str, many: str) -> str:
        return f"({editors} || if(editor_2 is null, '{one}', '{many}'))"

    by = (f"case when author_1 is not null then concat_ws('; ', {_names('author')}) "
          f"when contains(kind, 'book') then {marked(' (ed)', ' (eds)')} "
          "else 'No author' end")
    serial = " || ".join([
        _after(" ", "journal"), _after(", ", "volume"),
        f"if(volume is null, {_after(', ', 'issue')}, coalesce('(' || issue || ')', ''))"])
    inside = (f"if({EDITED} and author_1 is null and editor_1 is not null, "
              f"' In ' || {marked(' (ed), ', ' (eds), ')}, '')")
    host = (f"{inside} || if({IN_BOOK}, coalesce(booktitle || '.', ''), '') || "
            + _after(" ", "publisher"))
    return (f"trim({by} || ' (' || coalesce(year, '') || '). ' || title || '.' || "
            f"if({PERIODICAL}, {serial}, {host}) || {_after(', ', 'pages')})")
