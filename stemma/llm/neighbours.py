"""Approximate nearest neighbours with a forest of long hash strings."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

BLOCK = 50_000         # vectors of one forest, about
TREES = 96
BITS = 24              # length of a hash string
SHARE = 0.5            # synchronous ascent goes on until matches reach this share of the block
_DONE = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Forest:
    """Sorted arrays of hash strings, one per tree, over the vectors of a block.

    A string's bits are the sides of random planes through the block's mean. Strings are
    kept as integers, so those with a common prefix stand together and are found by
    binary search.
    """

    def __init__(self, vectors: np.ndarray, seed: int = 3):
        self.vectors = vectors
        self.mean = vectors.mean(0)
        self.planes = np.random.default_rng(seed).normal(size=(vectors.shape[1], TREES * BITS))
        strings = self.strings(vectors)
        self.order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        out = np.empty((TREES, len(vectors)), np.int64)
        for lo in range(0, len(vectors), 4096):
            side = ((vectors[lo:lo + 4096] - self.mean) @ self.planes > 0).reshape(-1, TREES, BITS)
            out[:, lo:lo + 4096] = (side @ (1 << np.arange(BITS - 1, -1, -1))).T
        return out

    def candidates(self, queries: np.ndarray, enough: int):
        """For each query the rows whose strings share its longest prefixes.

        Each tree is descended to the full string; then all trees ascend together, one bit at
        a time, until their matches add up to `enough` or the prefix is empty.
        """
        strings = self.strings(queries)
        n = self.sorted.shape[1]
        lo, hi = np.zeros((2, TREES, len(queries)), np.int64)
        open_ = np.ones(len(queries), bool)
        for up in range(BITS + 1):
            q = strings[:, open_] >> up << up
            for t in range(TREES):
                lo[t, open_] = np.searchsorted(self.sorted[t], q[t], "left")
                hi[t, open_] = np.searchsorted(self.sorted[t], q[t] + (1 << up), "left")
            open_ &= (hi - lo).sum(0) < enough
            if not open_.any():
                break
        for k in range(len(queries)):
            hit = np.zeros(n, bool)
            for t in range(TREES):
                hit[self.order[t, lo[t, k]:hi[t, k]]] = True
            yield np.flatnonzero(hit)


def _matrix(column, size):
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _search(k: int):
    def run(index, queries):
        out = {"query_id": [], "vec_id": [], "score": []}
        if index.num_rows and queries.num_rows:
            size = index.column("size")[0].as_py()
            index = index.sort_by("vec_id")
            ids, vectors = index.column("vec_id").to_numpy(), _matrix(index.column("vector"), size)
            forest = Forest(vectors)
            asked, points = queries.column("vec_id").to_numpy(), _matrix(queries.column("vector"), size)
            enough = max(200 * k, math.ceil(SHARE * len(ids)))
            for lo in range(0, len(asked), 256):
                for q, p, found in zip(asked[lo:lo + 256], points[lo:lo + 256],
                                       forest.candidates(points[lo:lo + 256], enough)):
                    found = found[ids[found] != q]
                    far = np.sqrt(((vectors[found] - p) ** 2).sum(1))
                    best = np.lexsort((ids[found], far))[:k]
                    out["query_id"] += [q] * len(best)
                    out["vec_id"] += ids[found[best]].tolist()
                    out["score"] += far[best].tolist()
        return pa.table(out, schema=_DONE)
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest found to each query: (query_id, rank, vec_id, score), nearest first.

    Both tables have vec_id and embedding; other columns are ignored. score is the Euclidean
    distance in double precision, ties go to the smaller vec_id, rank starts at 1. A query
    never finds its own vec_id. Vectors that are null, empty, zero, or hold a null or
    non-finite component, and rows without vec_id take no part; vectors meet only those of the
    same length. Rows repeated with one vec_id and vector count once; vectors that share a
    vec_id are each candidates, and each query row asks for itself under the same query_id,
    of which the k best results are given. With fewer candidates all are returned; empty
    tables give an empty result.

    Method: vectors are dealt by a hash into blocks of about BLOCK, and each builds a forest of
    TREES sorted arrays of BITS-bit strings. Every block gets the queries, which are a
    stated set, matches them and measures its candidates exactly; the k best of all blocks
    are the answer. Where the data have no structure, as random directions
    in many dimensions, near strings say little, and SHARE must be as high as it is for a
    recall over 0.9; work is then a fixed part of that of an exact search in blocks.
    """
    def usable(df):
        v = F.col("embedding").cast("array<double>")
        return (df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))
                .filter("vec_id is not null and vector is not null and size(vector) > 0")
                .filter("forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
                .filter("exists(vector, x -> x != 0)").withColumn("size", F.size("vector")))

    index, asked = usable(vectors).distinct(), usable(queries).distinct()
    sizes = index.groupBy("size").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    index = index.join(sizes, "size").select("vec_id", "vector", "size", F.expr("pmod(xxhash64(vec_id), blocks)").alias("block"))
    asked = (asked.join(sizes.toDF("length", "count"), F.col("size") == F.col("length"))
             .select("vec_id", "vector", "size", F.explode(F.expr("sequence(0L, count - 1)")).alias("block")))
    found = index.groupBy("size", "block").cogroup(asked.groupBy("size", "block")).applyInArrow(
        _search(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
