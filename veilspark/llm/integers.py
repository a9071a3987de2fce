"""Vectors as integers, for the operators that compare in exact arithmetic (11 and 12).

A vector that is null, or holds null or non-finite components, is no vector. Components become floor(factor * x); integers are held within
2**30 / length, so that squares and products of a whole vector fit into 64 bits. Vectors are handled by their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOUBLES = "array<double>"


def most(length: int) -> int:
    """The largest integer that a component of a vector of this length may have."""
    return 2**30 // max(1, length)


def doubles(vectors: DataFrame, col: str) -> Column:
    """A vector column of any numeric type as array<double>."""
    return F.col(col).cast(DOUBLES)


def usable(vec: Column) -> Column:
    inf = F.lit(float("inf"))
    return vec.isNotNull() & ~F.coalesce(F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf)), F.lit(False))


def integer_rows(column: pa.ListArray, factor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, integers) of the usable vectors of a column, for each length that occurs."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == n)
        x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), n)
        good = np.isfinite(x).all(axis=1)
        if good.any():
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(factor * x[good]), -most(n), most(n))
            yield rows[good], x.astype(np.int64)
