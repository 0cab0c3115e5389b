"""URIs and class names as SQL expressions over SQL expressions."""

from __future__ import annotations

from stemma import model as M
from stemma.functions.text import last_segment, lit


def first_hit(x: str, pairs: list[tuple[str, str]], default: str) -> str:
    """Value of the first pair whose text occurs in `x`, else the default."""
    whens = " ".join(f"when contains({x}, {lit(t)}) then {lit(v)}" for t, v in pairs)
    return f"case {whens} else {default} end"


def choose(x: str, values: dict[str, str]) -> str:
    """Value listed for `x`, NULL when none is."""
    whens = " ".join(f"when {lit(k)} then {lit(v)}" for k, v in values.items())
    return f"case {x} {whens} end"


def vocab_uri(label: str, base: str = M.BASE) -> str:
    """URI of a controlled-vocabulary term."""
    low = f"lower({label})"
    return (f"concat({lit(base + 'vocabularies/')}, "
            + first_hit(low, M.SUBJECT_IDS, f"replace({low}, ' ', '-')") + ")")


def work_class(publication_type: str) -> str:
    x = f"lower(coalesce({publication_type}, ''))"

    def guard(text):
        return f" and not contains({x}, {lit(M.CLASS_GUARDS[text])})" if text in M.CLASS_GUARDS else ""

    whens = " ".join(f"when contains({x}, {lit(t)}){guard(t)} then {lit(v)}" for t, v in M.CLASS_CASCADE)
    return f"case {whens} else {lit(M.WORK)} end"


def template_of(work_class_uri: str) -> str:
    """Template that describes a class; plain works use the report template."""
    return choose(work_class_uri, {M.WORK: "report"} | {
        c: t for t, c in M.TEMPLATE_CLASSES.items()})


def uri_base(value: str, base: str = M.BASE) -> str:
    """Namespace that a submitted identifier belongs to."""
    return (f"case when startswith({value}, 'Q') then {lit(M.WIKIDATA)} "
            f"when {value} rlike r'^\\p{{Nd}}+$' then {lit(M.GEONAMES)} "
            f"when startswith({value}, 'http') then '' else {lit(base)} end")


def short_uri(uri: str) -> str:
    """Identifier only for external authority URIs, the full URI otherwise."""
    return (f"if(contains({uri}, 'wikidata') or contains({uri}, 'geonames'), "
            f"{last_segment(uri)}, {uri})")


def minted_uri(kind: str, label: str, base: str = M.BASE) -> str:
    """URI of a new entity: stable, so two runs and two tasks agree."""
    return f"concat({lit(base)}, sha2(concat_ws('#', {kind}, {label}), 256))"


def display_class(work_class_uri: str) -> str:
    return first_hit(work_class_uri, M.DISPLAY_CLASSES, lit(M.DEFAULT_DISPLAY_CLASS))


def slot_property(role: str, ordinal: str, base: str = M.BASE) -> str:
    """Predicate of the k-th author or editor."""
    words = ", ".join(lit(o) for o in M.ORDINALS)
    return (f"concat({lit(base)}, element_at(array({words}), {ordinal}), "
            f"{lit(role.capitalize())})")
