"""Vectors of an Arrow column as a matrix, and exact products that don't depend on their neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    bad = F.exists(
        vector,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")),
    )
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def real(name: str, frame: DataFrame) -> Column:
    """The column as it is if it holds floating-point numbers, else cast to double."""
    kind = frame.schema[name].dataType.simpleString()
    return F.col(name).cast(kind if kind in ("array<float>", "array<double>") else "array<double>").alias(name)


def dimension(embeddings: DataFrame) -> int:
    """The most frequent length of usable vectors (the smallest of equals); 0 without any."""
    found = (
        embeddings.filter(usable(F.col("embedding")))
        .groupBy(F.size("embedding").alias("n"))
        .count()
        .orderBy(F.desc("count"), "n")
        .first()
    )
    return found["n"] if found else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, all of length ``width``, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products row by row, components added in order: equal rows give equal results anywhere."""
    out = np.zeros(len(left))
    for k in range(left.shape[1]):
        out += left[:, k] * right[:, k]
    return out
