"""Reading vector columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: Column) -> Column:
    """True for vectors of finite components that are not all zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(column.isNotNull() & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def lengths(vectors: DataFrame, column: str) -> list[int]:
    """The lengths of usable vectors: a dimension or a few, each of them a problem of its own."""
    return sorted(r["n"] for r in vectors.where(usable(F.col(column))).select(F.size(column).alias("n")).distinct().collect())


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column whose lists all hold dim numbers, in the column's own precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False)).reshape(len(column), dim)
