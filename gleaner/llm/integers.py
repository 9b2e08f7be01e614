"""Vectors as integers: floor(256 * x) of every component, in rows that have a name of their own."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored


def finite(column: Column) -> Column:
    """True for vectors that are not null and hold only finite components; zero and empty vectors are."""
    each = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(column.isNotNull() & each, F.lit(False))


def most(dim: int) -> int:
    """Integers beyond this are taken as this, so that 128 times a sum of dim products or squared differences fits 63 bits."""
    return min((1 << 24) - 1, math.isqrt((1 << 54) // max(1, dim)))


def floors(flat: np.ndarray, dim: int) -> np.ndarray:
    return np.clip(np.floor(flat.astype(np.float64) * 256), -most(dim), most(dim)).astype(np.int32)


def integer_rows(vectors: DataFrame, keep: list[str], vector_col: str, name: str) -> DataFrame:
    """Stored rows (uid, *keep, dim, q): q holds the vector's integers as little-endian 32-bit ones, uid names the row.

    Vectors that are null or hold null or non-finite components give no row.  A uid is a row's place in its partition of the
    input, so equal rows have different ones; they are written once and read from then on."""
    src = vectors.select(*keep, F.col(vector_col).cast("array<double>").alias("v")).where(finite(F.col("v")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            v = b.column("v")
            dims = np.diff(v.offsets.to_numpy()).astype(np.int64)
            flat, out = v.flatten().to_numpy(zero_copy_only=False), []
            at = 0
            for d in dims.tolist():
                out.append(floors(flat[at : at + d], d).tobytes())
                at += d
            new = [pa.array(np.arange(uid, uid + b.num_rows)), *[b.column(c) for c in keep], pa.array(dims), pa.array(out, pa.binary())]
            uid += b.num_rows
            yield pa.RecordBatch.from_arrays(new, names=["uid", *keep, "dim", "q"])

    kinds = ", ".join(f"{c} {dict(src.dtypes)[c]}" for c in keep)
    return stored(src.mapInArrow(run, f"uid long, {kinds}, dim long, q binary"), name)


def matrix_of(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The integers of rows of one length."""
    joined = b"".join(x.as_py() for x in column)
    return np.frombuffer(joined, "<i4").reshape(len(column), dim)
