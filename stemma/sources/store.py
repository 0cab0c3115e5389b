"""Catalogue tables on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stemma import model as M
from stemma.plans.catalog import Catalog

TABLES = ("types", "links", "literals", "labels", "state")


def write_version(quads: DataFrame, root: str, version: int) -> str:
    """Quads of a new version beside the old ones; readers switch by number.

    Files are clustered by graph, so a record's rows stay together and filters
    on `g` or `p` skip row groups.
    """
    path = f"{root}/version={version}"
    (quads.repartitionByRange("g", "s").sortWithinPartitions("g", "p", "s")
     .write.mode("errorifexists").parquet(path))
    return path


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.schema(M.QUAD).parquet(f"{root}/version={version}")


def save_catalog(cat: Catalog, database: str, buckets: int = 200, version: int = 1) -> None:
    """Typed tables of a new version, bucketed by record, so that per-record work is local.

    Tables of other versions stay as they are. The state table comes last, so a version
    that has one is whole. `buckets` should keep a bucket to some hundred MB.
    """
    for name in sorted(TABLES, key=lambda n: n == "state"):
        table = getattr(cat, name)
        key = "g" if "g" in table.columns else "uri"
        (table.repartition(buckets, key).write.mode("errorifexists").bucketBy(buckets, key).sortBy(key)
         .saveAsTable(f"{database}.{name}_v{version}"))


def load_catalog(spark: SparkSession, database: str, version: int | None = None) -> Catalog:
    """The tables of a version, by default of the last whole one."""
    if version is None:
        version = max(int(t.name[7:]) for t in spark.catalog.listTables(database, "state_v*"))
    return Catalog(*[spark.table(f"{database}.{name}_v{version}") for name in TABLES])
