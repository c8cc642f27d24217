"""Which vectors take part, and Arrow helpers for them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import only


def usable(vector: Column) -> Column:
    """Not null, not empty, without null, NaN or infinite components, and not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(
        vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column of one length, in double precision."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def by_dim(batch: pa.RecordBatch, column: int) -> list[tuple[int, np.ndarray]]:
    """The lengths of the vectors of a batch, each with the places that have it."""
    n = np.asarray(batch.column(column).value_lengths())
    return [(int(d), np.flatnonzero(n == d)) for d in np.unique(n)]


def as_doubles(df: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    return only(df, [key, vector, *more]).withColumn(vector, F.col(vector).cast("array<double>"))
