"""Distances between sets of vectors within a batch, in tiles; of two arrays, as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import EPS
from .tiles import pairwise


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def quadratic(x: Column, y: Column) -> Column:
    """Euclidean distance of arrays, floored at the root of machine precision; from direct differences, which cancel less."""
    return F.sqrt(F.greatest(_sum(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))), F.lit(EPS)))


def direct(x: Column, y: Column, p: float = 2) -> Column:
    """The p-norm distance of arrays, its p-th power floored at machine precision."""
    e = F.lit(float(p))
    power = _sum(F.zip_with(x, y, lambda a, b: F.abs(a - b) if p == 1 else F.pow(F.abs(a - b), e)))
    return F.pow(F.greatest(power, F.lit(EPS)), F.lit(1.0 / p))


def _prepared(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as columns, and their lengths; one that is null or has a null has NaN for a length."""
    size = pc.list_value_length(v).cast(pa.float64()).to_numpy(zero_copy_only=False).copy()
    flat = v.flatten()
    if not len(v) or (not flat.null_count and (size == size[0]).all()):
        return np.ascontiguousarray(flat.to_numpy().reshape(len(v), -1 if len(flat) else 0).T), size
    out = np.zeros((int(np.nanmax(size, initial=0)), len(v)))
    for n, row in enumerate(v.to_pylist()):
        if row is None or None in row:
            size[n] = np.nan
        else:
            out[: len(row), n] = row
    return out, size


def _norm(p: float):
    """Matrices of distances of prepared vectors; what can't be told (unequal lengths, nulls) is at the floor, as in `direct`."""

    def power(d: np.ndarray) -> np.ndarray:
        if p == 1 or p == 3:
            np.abs(d, out=d)
            return d if p == 1 else d * d * d
        return np.multiply(d, d, out=d) if p == 2 else np.power(np.abs(d, out=d), p)

    def kernel(x, y):
        (xv, nx), (yv, ny) = x, y
        total, d = np.zeros((len(nx), len(ny))), np.empty((len(nx), len(ny)))
        for a, b in zip(xv, yv):
            total += power(np.subtract(a[:, None], b[None, :], out=d))
        total[nx[:, None] != ny[None, :]] = 0.0
        np.maximum(total, EPS, out=total)
        return np.sqrt(total) if p == 2 else total if p == 1 else np.power(total, 1.0 / p), None

    return kernel


def cdist(x: DataFrame, y: DataFrame | None = None, p: float = 2, batch: str = "batch") -> DataFrame:
    """batch, i, j, dist for rows (batch, id, v) of x against those of y (or x itself) in the same batch, in tiles."""
    x, y = (d.select(batch, "id", F.col("v").cast("array<double>").alias("v")) for d in (x, x if y is None else y))
    return pairwise(x, y, [batch], _prepared, _norm(p), "dist")
