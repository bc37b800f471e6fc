"""Reading embedding columns: which rows take part, and their values as numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(vector: Column, below: float = float("inf")) -> Column:
    """Neither null nor empty, and every entry a number of an absolute value under ``below``."""
    inside = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(below)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & inside, F.lit(False))


def value_type(df: DataFrame, vector: str) -> str:
    """numpy type of the entries: single precision if the column has it, else double."""
    entry = df.schema[vector].dataType
    return "<f4" if isinstance(entry, T.ArrayType) and isinstance(entry.elementType, T.FloatType) else "<f8"


def matrix(column: pa.Array | pa.ChunkedArray, dims: int, dtype: str = "<f8") -> np.ndarray:
    """Rows of a list column whose lists all have ``dims`` entries."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, dims)


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of at most ``rows`` rows, full ones but for the last."""
    held, count = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            piece = batch.slice(at, rows - count)
            at += piece.num_rows
            held.append(piece)
            count += piece.num_rows
            if count == rows:
                yield pa.Table.from_batches(held)
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)
