"""Columns of vectors: which take part, and their entries as whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole entries up to this size are offered; their products then fit two words.
LARGEST = 2**52


def finite(vector: Column) -> Column:
    """True where the vector is there and all of its entries are numbers."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def whole(vector: Column, scale: int, shift: int = 0) -> Column:
    """floor(scale * entry) + shift of every entry, taken as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)) + F.lit(shift).cast("long"))


def matrix(column: pa.ChunkedArray | pa.Array, width: int = 0, fill: int = 0) -> np.ndarray:
    """Rows of lists as a matrix of at least ``width`` columns; shorter rows end in ``fill``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    sizes = np.diff(ends)
    width = max(width, int(sizes.max(initial=0)))
    flat = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    if len(flat) == len(sizes) * width:
        return flat.reshape(len(sizes), width)
    out = np.full((len(sizes), width), fill, flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out
