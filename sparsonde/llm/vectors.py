"""Vectors as integers, and exact products of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether ``vector`` is there and holds neither nulls nor numbers that aren't finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def quantised(vector: Column, scale: int, most: int) -> Column:
    """floor(scale * x) of each component, held within ``most`` on either side."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * float(scale), F.lit(float(most))), F.lit(float(-most)))).cast("int"))


def bound(width: int, bits: int) -> int:
    """The largest power of two so that ``width`` products of two such numbers add up to at most 2**bits; 2**30 at most."""
    return 1 << min((bits - max(width - 1, 0).bit_length()) // 2, 30)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equally long lists as rows of int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b' of integer matrices, exactly: in doubles where they hold every sum, else in 64-bit integers."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T
