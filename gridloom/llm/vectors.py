"""What the two vector operators share: which vectors take part, and their blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and every component finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def numbered(vectors: DataFrame, least: int, most: int, spread: float) -> tuple[int, int]:
    """(rows, blocks): blocks grow with the root of the rows, between least and most rows each."""
    n = vectors.count()
    return n, max(1, -(-n // int(min(most, max(least, spread * n**0.5)))))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))
