"""Batched linear algebra: contractions over coordinate lists, bounds, dense eigenproblems.

Contractions of a matrix and a vector are equi-joins with a sum, those of two matrices products of
tiles, in an order fixed by the builder. Dense problems of one matrix a row go to numpy by Arrow
batches: matrices are ragged, so there is no padding. Eigenvectors have their largest component positive.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import products

MATRIX = T.ArrayType(T.ArrayType(T.DoubleType()))
EIGEN = T.StructType([T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("v", MATRIX)])
METHODS = ("cond", "lorn", "none")


def einsum(spec: str, *operands: DataFrame, order: str = "greedy") -> DataFrame:
    """Contract coordinate lists by a spec such as "bij,bjk->bik"; columns are the index letters and `v`.

    An operand has its columns in the order of its letters, `v` apart. A letter twice in an
    operand takes its diagonal ("ii->" is the trace; the columns are then `i` and `i_2`).
    Operands that share no letter give their outer product, last of all joins. Joins go pairwise: the pair that shares most indices first, of such the one whose
    result has fewest ("greedy"), or as written ("left"). An index is summed away as soon as no later operand or the result has it.
    Where two operands are summed over a shared index and both keep one of their own, there are
    many products for each sum: these are made in tiles (`products`), and no product is a row.
    """
    ins, out = spec.replace(" ", "").split("->")
    terms = []
    for t, df in zip(ins.split(","), operands, strict=True):
        named = [c if c not in t[:n] else f"{c}_{t[: n + 1].count(c)}" for n, c in enumerate(t)]
        for c, twin in zip(t, named):
            df = df if c == twin else df.filter(F.col(c) == F.col(twin))
        terms.append((set(t), df.select(*sorted(set(t)), "v")))
    if not set(out) <= set(ins):
        raise ValueError(f"{out!r} has indices that no operand has")

    def reduced(letters: set, df: DataFrame, rest: set) -> tuple[set, DataFrame]:
        keep = [c for c in sorted(letters) if c in rest]
        return set(keep), df.groupBy(*keep).agg(F.sum("v").alias("v")) if len(keep) < len(letters) else df

    def needed(a: int, b: int) -> set:
        """Indices that the result or an operand other than these two has."""
        return set(out).union(*[t[0] for n, t in enumerate(terms) if n not in (a, b)])

    def rank(a: int, b: int) -> tuple:
        la, lb = terms[a][0], terms[b][0]
        return len(la & lb), -len((la | lb) & needed(a, b)), -a, -b

    while len(terms) > 1:
        ranked = [rank(a, b) for a in range(len(terms)) for b in range(a + 1, len(terms))]
        *_, a, b = max(ranked) if order == "greedy" else (0, -1)
        (la, da), (lb, db), rest = terms[-a], terms[-b], needed(-a, -b)
        terms = [t for n, t in enumerate(terms) if n not in (-a, -b)]
        (la, da), (lb, db) = reduced(la, da, lb | rest), reduced(lb, db, la | rest)
        shared = sorted(la & lb)
        summed = [c for c in shared if c not in rest]
        if summed and la - lb and lb - la and products.fit(da, db):
            terms.append(((la | lb) - set(summed), products.contract(da, db, [c for c in shared if c in rest], summed)))
            continue
        da, db = da.withColumnRenamed("v", "va"), db.withColumnRenamed("v", "vb")
        both = da.join(db, shared) if shared else da.crossJoin(db)  # an outer product is one by definition
        both = both.select(*sorted(la | lb), (F.col("va") * F.col("vb")).alias("v"))
        terms.append(reduced(la | lb, both, rest))
    letters, df = terms[0]
    return reduced(letters, df, set(out))[1].select(*out, "v")


def gershgorin(coo: DataFrame) -> DataFrame:
    """m, low, high: bounds of the eigenvalues of matrices (m, i, j, v)."""
    rows = coo.groupBy("m", "i").agg(F.sum(F.abs("v")).alias("s"), F.sum(F.when(F.col("i") == F.col("j"), F.col("v")).otherwise(0.0)).alias("c"))
    radius = F.col("s") - F.abs("c")
    return rows.groupBy("m").agg(F.min(F.col("c") - radius).alias("low"), F.max(F.col("c") + radius).alias("high"))


def _signed(v: np.ndarray) -> np.ndarray:
    at = np.argmax(np.abs(v), axis=0)
    return v * np.where(v[at, np.arange(v.shape[1])] < 0, -1.0, 1.0)


def _eigen(a) -> dict | None:
    if a is None:
        return None
    w, v = np.linalg.eigh(np.array([list(r) for r in a], float).reshape(len(a), -1)) if len(a) else (np.zeros(0), np.zeros((0, 0)))
    return {"w": w.tolist(), "v": _signed(v).tolist() if len(a) else []}


@F.pandas_udf(EIGEN)
def eigh(a: pd.Series) -> pd.DataFrame:
    """Ascending eigenvalues w and eigenvectors (columns of v) of symmetric matrices."""
    return pd.DataFrame([_eigen(m) or {"w": None, "v": None} for m in a], columns=["w", "v"])


def _array(m) -> np.ndarray:
    return np.array([list(r) for r in m], float).reshape(len(m), -1 if len(m) else 0)


def _padding(m: np.ndarray) -> np.ndarray:
    """Which rows and columns are all zero."""
    return (m == 0).all(0) & (m == 0).all(1)


def _whole(n: int, real: np.ndarray, w: np.ndarray, v: np.ndarray) -> dict:
    """Results of the part that isn't padding, with ghosts last: eigenvalue 0 and a unit vector each."""
    full, at, rest = np.zeros((n, n)), np.flatnonzero(real), np.flatnonzero(~real)
    full[np.ix_(at, range(len(at)))] = v
    full[rest, len(at) + np.arange(len(rest))] = 1.0
    return {"w": [*w.tolist(), *[0.0] * len(rest)], "v": full.tolist()}


@F.pandas_udf(EIGEN)
def eigh_padded(a: pd.Series) -> pd.DataFrame:
    """eigh of matrices packed with zeros: the padding takes no part, its ghosts come last. Null gives null."""

    def one(m):
        if m is None:
            return {"w": None, "v": None}
        m = _array(m)
        real = ~_padding(m) if len(m) else np.zeros(0, bool)
        w, v = np.linalg.eigh(m[np.ix_(real, real)]) if real.any() else (np.zeros(0), np.zeros((0, 0)))
        return _whole(len(m), real, w, _signed(v) if real.any() else v)

    return pd.DataFrame([one(m) for m in a], columns=["w", "v"])


def _reduction(b: np.ndarray, scheme: str, direct_inv: bool) -> np.ndarray:
    """back with back' b back = 1."""
    if scheme == "chol":
        low = np.linalg.cholesky(b)
        return (np.linalg.inv(low) if direct_inv else np.linalg.solve(low, np.eye(len(low)))).T
    w, u = np.linalg.eigh(b)
    return (u * w**-0.5) @ u.T


def eigh_general(scheme: str = "chol", direct_inv: bool = False, is_posdef: bool = False):
    """A UDF of (a, b) for a z = w b z, by Cholesky reduction or symmetric orthogonalisation.

    Unless `is_posdef` says that b has none, rows and columns of b that are all zero are
    padding: they take no part, and their ghosts (eigenvalue 0, a unit vector) come last. A
    null matrix gives null; matrices of different sizes, or a b that isn't positive definite
    beside its padding, are an error.
    """
    if scheme not in ("chol", "lowd"):
        raise ValueError(f"unknown scheme {scheme!r}")

    def one(a, b):
        if a is None or b is None:
            return {"w": None, "v": None}
        a, b = _array(a), _array(b)
        if a.shape != b.shape:
            raise ValueError(f"matrices of {len(a)} and {len(b)} rows")
        real = np.ones(len(b), bool) if is_posdef or not len(b) else ~_padding(b)
        if not real.any():
            return _whole(len(b), real, np.zeros(0), np.zeros((0, 0)))
        back = _reduction(b[np.ix_(real, real)], scheme, direct_inv)
        w, y = np.linalg.eigh(back.T @ a[np.ix_(real, real)] @ back)
        return _whole(len(b), real, w, _signed(back @ y))

    @F.pandas_udf(EIGEN)
    def solve(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x, y) for x, y in zip(a, b)], columns=["w", "v"])

    return solve


def _broadened(w: np.ndarray, method: str, factor: float) -> np.ndarray:
    """1 / (w_j - w_i), kept from blowing up where eigenvalues are (nearly) equal; 0 on the diagonal."""
    d = w[None, :] - w[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        if method == "cond":
            f = np.sign(d) / np.maximum(np.abs(d), factor)
        elif method == "lorn":
            f = d / (d * d + factor)
        else:
            f = 1 / d
    np.fill_diagonal(f, 0.0)
    return f


def eigh_vjp(method: str = "cond", factor: float = 1e-12):
    """A UDF of (a, w_bar, v_bar): the gradient by a, with broadened differences of eigenvalues. Null gives null."""
    if method not in METHODS:
        raise ValueError(f"unknown broadening method {method!r}")

    def one(a, w_bar, v_bar):
        if a is None or w_bar is None or v_bar is None:
            return None
        w, v = np.linalg.eigh(_array(a))
        v = _signed(v)
        t = _broadened(w, method, factor) * (v.T @ _array(v_bar))
        return (v @ (np.diag(np.asarray(w_bar, float)) + (t + t.T) / 2) @ v.T).tolist()

    @F.pandas_udf(MATRIX)
    def gradient(a: pd.Series, w_bar: pd.Series, v_bar: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(a, w_bar, v_bar)])

    return gradient


PAIR = T.StructType([T.StructField("a", MATRIX), T.StructField("b", MATRIX)])


def eigh_general_vjp(method: str = "cond", factor: float = 1e-12):
    """A UDF of (a, b, w_bar, v_bar): the symmetric gradients by a and by b of the problem a z = w b z.

    With z' b z = 1: dw_i = z_i' (da - w_i db) z_i, and dz_i has the parts z_j' (da - w_i db) z_i / (w_i - w_j)
    along the other z_j and -z_i' db z_i / 2 along itself. Null gives null.
    """
    if method not in METHODS:
        raise ValueError(f"unknown broadening method {method!r}")

    def one(a, b, w_bar, v_bar):
        if a is None or b is None or w_bar is None or v_bar is None:
            return {"a": None, "b": None}
        a, b, bar = _array(a), _array(b), _array(v_bar)
        back = _reduction(b, "chol", False)
        w, y = np.linalg.eigh(back.T @ a @ back)
        z = _signed(back @ y)
        own = z.T @ bar  # (j, i): what moving z_i along z_j is worth
        m = _broadened(w, method, factor) * own + np.diag(np.asarray(w_bar, float))
        by_b = m * w[None, :] + np.diag(np.diag(own)) / 2
        even = lambda x: ((x + x.T) / 2).tolist()
        return {"a": even(z @ m @ z.T), "b": even(-(z @ by_b @ z.T))}

    @F.pandas_udf(PAIR)
    def gradients(a: pd.Series, b: pd.Series, w_bar: pd.Series, v_bar: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*x) for x in zip(a, b, w_bar, v_bar)], columns=["a", "b"])

    return gradients


def sort_out(df: DataFrame, w: str = "w", v: str = "v", ghost: bool = True) -> DataFrame:
    """Move ghosts last, in their order: eigenvalues of exactly 0 (1 if not `ghost`, then set to 0) with a unit vector."""
    mark = 0.0 if ghost else 1.0
    column = lambda k: F.transform(v, lambda r: F.get(r, k))
    unit = lambda k: (F.size(F.filter(column(k), lambda x: x == 1.0)) == 1) & F.forall(column(k), lambda x: (x == 0.0) | (x == 1.0))
    at = F.sequence(F.lit(0), F.size(w) - 1)
    is_ghost = lambda k: (F.get(F.col(w), k) == mark) & unit(k)
    order = F.when(F.size(w) > 0, F.concat(F.filter(at, lambda k: ~is_ghost(k)), F.filter(at, is_ghost))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("__order", order).withColumn("__ghosts", F.filter("__order", is_ghost))
    value = lambda k: F.when(F.array_contains("__ghosts", k), F.lit(0.0)).otherwise(F.get(F.col(w), k))
    df = df.withColumn("__w", F.transform("__order", value)).withColumn("__v", F.transform(v, lambda r: F.transform("__order", lambda k: F.get(r, k))))
    return df.withColumn(w, F.col("__w")).withColumn(v, F.col("__v")).drop("__order", "__ghosts", "__w", "__v")


def dense(coo: DataFrame) -> DataFrame:
    """m, a: matrices as arrays of rows, from full coordinate lists (m, i, j, v)."""
    rows = coo.groupBy("m", "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("r"))
    return rows.groupBy("m").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "r"))), lambda s: s["r"]).alias("a"))
