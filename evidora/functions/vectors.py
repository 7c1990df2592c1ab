"""Vector columns: expressions for single pairs, Arrow kernels for many."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of no length, of unlike sizes, or null."""
    length = norm(a) * norm(b)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (length > 0)
    return F.coalesce(F.when(usable, dot(a, b) / length), F.lit(0.0))


def l2_normalized(a: Column, floor: float = 1e-12) -> Column:
    """The length is bound once and not worked out for each component."""
    return F.transform(F.array(F.greatest(norm(a), F.lit(floor))), lambda n: F.transform(_doubles(a), lambda x: x / n))[0]


def finite(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as doubles; a row that is null, of another size or not finite throughout is zero."""
    out = np.zeros((len(column), dim))
    sizes = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, int)
    good = np.flatnonzero((sizes == dim) & np.asarray(column.is_valid()))
    if len(good):
        flat = column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False)
        rows = flat.astype(np.float64).reshape(len(good), dim)
        out[good] = np.where(np.isfinite(rows).all(1, keepdims=True), rows, 0.0)
    return out


def units(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)
