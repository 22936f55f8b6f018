"""Vectors as rows: which take part, and how bounded groups of them travel as one packed row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """A vector that is not null and holds only non-null, finite components."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int, dtype) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def dimension(df: DataFrame, v: str) -> int:
    return df.agg(F.coalesce(F.max(F.size(v)), F.lit(0))).first()[0]
