"""Reference-manager text of records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stemma import model as M
from stemma.functions import terms
from stemma.functions.text import lit
from stemma.operators.analytics import property_value, work_properties
from stemma.plans.catalog import Catalog


def to_ris(cat: Catalog, database_name: str = "Catalogue",
           fields: list[tuple] | None = None) -> DataFrame:
    """(work, ris): tagged lines of each work, only tags with data.

    A tag appears only where the template of the work's class has its property.
    `fields` are template rows as in `model.standard_fields`.
    """
    holders: dict[str, list[str]] = {}
    for row in fields or M.standard_fields():
        holders.setdefault(row[4], []).append(row[0])
    tags = {f"author{k}": p for k, p in enumerate(M.AUTHOR_PROPS, 1)} | {
        "year": M.PUBLICATION_DATE, "doi": M.DOI, "issue": M.ISSUE, "title": M.DCT_TITLE,
        "host": M.PART_OF, "volume": M.VOLUME, "publisher": M.DCT_PUBLISHER,
        "language": M.DCT_LANGUAGE, "link": M.URL}
    wide = (
        work_properties(cat).groupBy("work")
        .agg(property_value(M.RDF_TYPE, "class"),
             *[property_value(p, c) for c, p in tags.items()])
        .filter("class is not null")
        .selectExpr("*", f"{terms.template_of('class')} as template")
        .selectExpr("*", f"coalesce({terms.choose('template', M.RIS_TYPES)}, 'JOUR') as kind")
    )

    def line(tag: str, name: str) -> str:
        fits = ", ".join(lit(t) for t in holders.get(tags[name], [""]))
        return f"if(template in ({fits}), {tag} || {name}, null)"

    simple = {"PY": "year", "DO": "doi", "IS": "issue", "TI": "title", "JO": "host",
              "VL": "volume", "PB": "publisher", "LA": "language", "L2": "link"}
    host_tag = "if(kind = 'CHAP', 'J2 - ', 'JO - ')"
    lines = [
        "'TY - ' || kind", *[line("'AU - '", f"author{k}") for k in range(1, 11)],
        *[line(host_tag if tag == "JO" else f"'{tag} - '", name)
          for tag, name in simple.items()],
        lit("DP - " + database_name), "'ER  - '",
    ]
    return wide.selectExpr("work", f"concat_ws('\\n', {', '.join(lines)}) as ris")
