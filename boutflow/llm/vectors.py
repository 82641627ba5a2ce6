"""Vectors in Arrow batches, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable(vector: Column) -> Column:
    """Neither the vector nor an entry is null, and each entry is finite."""
    infinite = F.lit(float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)), F.lit(False))


def dimensions(rows: DataFrame, vector: str) -> int:
    """The length of the longest vector, 0 without rows."""
    return rows.agg(F.max(F.size(vector))).first()[0] or 0


def scaled(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(``scale`` * entry), entries as doubles, as a matrix of longs; shorter vectors are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = np.floor(np.asarray(column.flatten(), dtype=np.float64) * scale).astype(np.int64)
    out = np.zeros((len(lengths), dims), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), at] = flat
    return out
