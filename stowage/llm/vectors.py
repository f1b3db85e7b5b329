"""Rows of vectors: which ones take part, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for vectors that are not null and without null or non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def usable(vector: Column) -> Column:
    """True for finite vectors that are not empty and not all zero."""
    return finite(vector) & F.coalesce((F.size(vector) > 0) & F.exists(vector, lambda x: x != 0), F.lit(False))


def as_numbers(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector) of every row; floats stay floats, every other component type becomes double."""
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("vector"))


def keyed(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that have a key."""
    return as_numbers(df, key, vector).filter("id is not null")


def lengths(vectors: DataFrame, column: str) -> list[int]:
    """The lengths that occur, ascending; a handful in any sensible table."""
    return sorted(r["d"] for r in vectors.select(F.size(column).alias("d")).distinct().collect())


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of equal lengths as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
