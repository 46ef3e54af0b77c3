"""Whole-number vectors for the operators that promise exact scores and distances."""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sums of squares of differences stay within 64 bits below this total of squares.
ROOM = 2.0 ** 60


def whole(vector: Column, scale: int) -> Column:
    """The components x as integers floor(scale * x), x as double; null for a vector that has none.

    It has none where the vector is null, where a component is null, not finite, or so large that scores would leave
    64 bits (beyond sqrt(ROOM / length)). An empty vector stays empty.
    """
    vector = vector.cast("array<double>")
    most = F.lit(sqrt(ROOM)) / F.sqrt(F.greatest(F.size(vector), F.lit(1)))
    # NaN is above every number in Spark; a null component makes the test null
    fits = F.forall(vector, lambda x: F.abs(x * scale) < most)
    return F.when(F.coalesce(fits, F.lit(False)), F.transform(vector, lambda x: F.floor(x * scale).cast("int")))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column whose lists all have this length."""
    return np.asarray(lists.flatten(), np.int64).reshape(len(lists), width)


def lists_of(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, max(width, 1))[:n + 1] if width else np.zeros(n + 1, int), pa.int32()), pa.array(values.ravel()))


def usable(rows: DataFrame, scale: int, *keep: Column) -> DataFrame:
    """The kept columns and v, the whole-number vector, of the rows that have one."""
    return rows.select(*keep, whole(rows["embedding"], scale).alias("v")).filter("v IS NOT NULL")
