"""Files that leave the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stemma.operators.analytics import EXPORT_COLUMNS, export_wide
from stemma.operators.ris import to_ris
from stemma.plans.catalog import Catalog


def write_csv_export(cat: Catalog, path: str) -> None:
    export_wide(cat).select(*EXPORT_COLUMNS).write.csv(
        path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False)


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a written export, without the header that each file has."""
    return (spark.read.text(path).select(F.col("value").alias("line"))
            .filter(F.col("line") != ",".join(EXPORT_COLUMNS)))


def write_ris(cat: Catalog, path: str, database_name: str = "Catalogue") -> None:
    to_ris(cat, database_name).select("ris").write.text(path)


def citation_blocks(works: DataFrame) -> DataFrame:
    """Citations of selected works, each followed by a blank line."""
    return works.select(F.concat("citation", F.lit("\n")).alias("value"))


def write_citations(works: DataFrame, path: str) -> None:
    citation_blocks(works).write.text(path)


def chart_json(series: DataFrame) -> DataFrame:
    """One JSON object per chart point."""
    return series.select(F.to_json(F.struct(*series.columns)).alias("point"))


def write_chart_json(series: DataFrame, path: str) -> None:
    series.write.json(path)
