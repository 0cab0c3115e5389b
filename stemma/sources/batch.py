"""Tabular batches and name-authority lists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from stemma.functions.text import cell, lit


def read_batch(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV or parquet batch: lower-case headers, unnamed columns dropped.

    Cells stay text and missing ones are NULL. Cells that span lines need `multi_line`,
    with which a file can't be split among tasks.
    """
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    return tidy_headers(df)


def tidy_headers(df: DataFrame) -> DataFrame:
    keep = [c for c in df.columns if "Unnamed" not in c and not re.fullmatch(r"_c\d+", c)]
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c.lower()) for c in keep])


def read_authority(spark: SparkSession, path: str, kinds: list[str],
                   multi_line: bool = True) -> DataFrame:
    """Name lists with quoted multi-line headers as distinct (kind, label).

    `kinds` names the leading columns, e.g. ['journals']; further ones are notes.
    """
    df = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    columns = df.columns[:len(kinds)]
    pairs = ", ".join(f"named_struct('kind', {lit(k)}, 'label', {cell(f'`{c}`')})"
                      for k, c in zip(kinds, columns))
    return df.selectExpr(f"inline(array({pairs}))").filter("label is not null").distinct()
