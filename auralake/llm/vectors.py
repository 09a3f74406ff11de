"""Columns of vectors as whole numbers, and as matrices inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def scaled(vector: Column, scale: int, offset: int = 0) -> Column:
    """floor(scale * entry) + offset of each entry, as 64-bit integers; products beyond 2**62 count as 2**62."""
    end = F.lit(2.0**62)
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, end), -end)) + F.lit(offset).cast("long"))


def matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of their vectors) for each length of vectors in the batch."""
    lists = batch.column(column)
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(size) - size
    for length in np.unique(size):
        at = np.flatnonzero(size == length)
        yield at, flat[first[at][:, None] + np.arange(length)].reshape(len(at), length)
