"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stemma.plans.durable import written


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component) for every end of `edges` (a, b); component is the smallest id reachable.

    Alternates large-star and small-star steps; each step is two grouped
    minima, written to the shared folder, until a whole round changes nothing.
    A vertex with very many links is a skewed join side at most, which adaptive
    execution splits; its minimum is combined before the shuffle. An empty edge
    list gives an empty result.
    """
    def stamp(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    links = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .filter("u != v").distinct(), name)
    before = stamp(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.filter("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())
        large = written(large, name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct("u", F.col("m").alias("v")))).alias("e"))
                 .select("e.*").filter("u != v").distinct())
        links = written(small, name)
        after = stamp(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
