"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

SALTS = 64


def least_hashed(rows: DataFrame, group: str, id_: str, n: int, *ties: str) -> DataFrame:
    """The n rows of each group with the least hash of their id; ties go to the smaller id, then the smaller `ties`.

    Ranked within salts of a group first, so that a group's task gets SALTS * n rows at most,
    however many rows and tasks there are.
    """
    rows = rows.withColumn("_hash", F.xxhash64(id_))
    for key in ([group, F.pmod("_hash", F.lit(SALTS))], [group]):
        order = Window.partitionBy(*key).orderBy("_hash", id_, *ties)
        rows = rows.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= n).drop("_nth")
    return rows.drop("_hash")
