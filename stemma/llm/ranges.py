"""Dealing rows by ranges of an id, in the order of the ids."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

RANGES = 1000          # ranges of about equal numbers of rows, each cut further into even steps


def bounds_of(docs: DataFrame, size: int) -> tuple[int, tuple[np.ndarray, int]]:
    """Bytes of all texts, and the bounds of doc_id ranges of about `size` bytes of text each.

    The driver gets at most RANGES + 1 ids, whatever the size of the table.
    """
    share = [i / RANGES for i in range(RANGES + 1)]
    total, ids = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))),
                          F.percentile_approx("doc_id", share, 20 * RANGES)).first()
    wanted = max(1, math.ceil((total or 0) / size))
    ids = np.array(ids or [0] * (RANGES + 1), np.int64)
    if wanted < RANGES:
        ids = ids[np.linspace(0, RANGES, wanted + 1).astype(int)]
    return total or 0, (ids, math.ceil(wanted / RANGES))


def range_number(bounds: tuple[np.ndarray, int], column: str) -> Column:
    """Number of the range that holds an id; never falls as the id grows. Null is in the first."""
    ids, steps = bounds

    def number(x: pa.Array) -> pa.Array:
        x = pc.fill_null(x, int(ids[0])).to_numpy(zero_copy_only=False)
        r = np.clip(np.searchsorted(ids, x, "right") - 1, 0, len(ids) - 2)
        wide = np.maximum((ids[r + 1] - ids[r]) / steps, 1e-9)
        part = np.clip(((x - ids[r]) / wide).astype(np.int64), 0, steps - 1)
        return pa.array(r * steps + part, pa.int64())

    return F.arrow_udf(number, LongType())(column)
