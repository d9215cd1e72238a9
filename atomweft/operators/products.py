"""Contraction of two coordinate lists over shared indices, as products of tiles.

Coordinates become rows, each with the summed indices and values that it has as two arrays; rows
of one operand meet those of the other in `tiles`, where a tile is a product of two dense
matrices over the indices that both have. As in a join with a sum, a result is there where an
index is shared, and null where no product of shared ones is.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tiles import pairwise

KEYS = 4096  #: summed indices multiplied at a time
WHOLE = 1 << 21  #: numbers of a tile that may stay dense


class _Rows(NamedTuple):
    """Rows of a tile: the distinct summed indices in order, and either all values as a matrix or entries (row, place of the index, value, whether not null)."""

    n: int
    keys: np.ndarray
    dense: np.ndarray | None
    row: np.ndarray | None
    at: np.ndarray | None
    value: np.ndarray | None
    valid: np.ndarray | None
    finite: bool

    def part(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums, numbers of entries and of entries that are not null, by row and index (places of some, ascending)."""
        if self.dense is not None:
            some = np.ones((self.n, len(keys)))
            return self.dense[:, keys], some, some
        place = np.full(len(self.keys), -1)
        place[keys] = np.arange(len(keys))
        at = place[self.at]
        of = at >= 0
        at, size = self.row[of] * len(keys) + at[of], self.n * len(keys)
        made = [np.bincount(at, weights=w, minlength=size) for w in (self.value[of], None, self.valid[of])]
        return tuple(m.astype(float).reshape(self.n, len(keys)) for m in made)


def _prepared(v: pa.Array) -> _Rows:
    keys, values = v.field(0).flatten(), v.field(1).flatten()
    row = np.repeat(np.arange(len(v)), pc.list_value_length(v.field(1)).to_numpy(zero_copy_only=False))
    whole = pa.types.is_integer(keys.type)
    keys, at = np.unique(keys.to_numpy(zero_copy_only=False) if whole else np.array(keys.to_pylist(), object), return_inverse=True)
    value, valid = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False), pc.is_valid(values).to_numpy(zero_copy_only=False)
    finite, size = bool(np.isfinite(value).all()), len(v) * len(keys)
    if size == len(value) <= WHOLE and finite and valid.all():
        place = row * len(keys) + at
        if (np.bincount(place, minlength=size) == 1).all():
            dense = np.empty(size)
            dense[place] = value
            return _Rows(len(v), keys, dense.reshape(len(v), -1), None, None, None, None, True)
    return _Rows(len(v), keys, None, row, at, value, valid, finite)


def _product(x: _Rows, y: _Rows):
    if x.dense is not None and y.dense is not None and np.array_equal(x.keys, y.keys):
        return x.dense @ y.dense.T, None
    _, kx, ky = np.intersect1d(x.keys, y.keys, assume_unique=True, return_indices=True)
    total, met, known = (np.zeros((x.n, y.n)) for _ in range(3))
    for k in range(0, len(kx), KEYS):
        (a, ma, na), (b, mb, nb) = x.part(kx[k : k + KEYS]), y.part(ky[k : k + KEYS])
        met += ma @ mb.T
        known += na @ nb.T
        if x.finite and y.finite:
            total += a @ b.T
            continue
        for c in range(a.shape[1]):  # what is not there must not meet an infinity
            with np.errstate(invalid="ignore"):
                total += np.where(np.outer(na[:, c], nb[:, c]) > 0, np.outer(a[:, c], b[:, c]), 0.0)
    return np.ma.masked_array(total, known == 0), met > 0


def fit(x: DataFrame, y: DataFrame) -> bool:
    """Whether products of the two are doubles; others (whole numbers, decimals) are exact by a join."""
    kinds = [d.schema["v"].dataType for d in (x, y)]
    return T.DoubleType() in kinds and all(isinstance(t, (T.DoubleType, T.FloatType, T.IntegralType)) for t in kinds) and not (x.isStreaming or y.isStreaming)


def contract(x: DataFrame, y: DataFrame, on: list[str], summed: list[str]) -> DataFrame:
    """`on`, the other indices of x and of y, and `v`: sums over `summed` of products of x and y with equal `on`.

    A row (all its summed indices) has to fit into a task, rows are any number. Of an operand's
    entries with equal indices the values are added before they are multiplied.
    """
    kinds = {c: x.select(c).union(y.select(c)).schema[c].dataType for c in [*on, *summed]}
    own = [[c for c in d.columns if c not in (*on, *summed, "v")] for d in (x, y)]
    keys = [f"__k{n}" for n in range(max(1, len(on)))]  # one for all where nothing is shared but what is summed
    one = len(summed) == 1 and isinstance(kinds[summed[0]], T.IntegralType)

    def rows(d: DataFrame, mine: list[str]) -> DataFrame:
        d = d.dropna(subset=[*on, *summed])
        at = [F.col(c).cast(kinds[c]).alias(c) for c in summed]
        at = at[0].cast("long") if one else F.to_json(F.struct(*at))
        key = [F.col(c).cast(kinds[c]).alias(k) for c, k in zip(on, keys)] or [F.lit(0).alias(keys[0])]
        d = d.select(*key, (F.col(mine[0]) if len(mine) == 1 else F.struct(*mine)).alias("id"), F.struct(at.alias("at"), F.col("v").cast("double").alias("v")).alias("e"))
        return d.groupBy(*keys, "id").agg(F.collect_list("e").alias("e")).select(*keys, "id", F.struct(F.col("e.at").alias("at"), F.col("e.v").alias("v")).alias("v"))

    made = pairwise(rows(x, own[0]), rows(y, own[1]), keys, _prepared, _product, "v")
    flat = [(F.col(side) if len(mine) == 1 else F.col(f"{side}.{c}")).alias(c) for side, mine in zip("ij", own) for c in mine]
    return made.select(*[F.col(k).cast(x.schema[c].dataType).alias(c) for c, k in zip(on, keys)], *flat, "v")
