"""Fractional coordination numbers and their derivatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions.elements import lookup
from .pairs import near, needs_grid, pairs, within_grid

#: Count name -> (kernel, its keyword for the steepness).
_ERF = {k.erf_count}


def with_count(df: DataFrame, count, out: str, r: str = "d", r0: str = "r0", **kw) -> DataFrame:
    """df with count(r, r0) as `out`; the error function gets its argument as a column of its own."""
    if count in _ERF:
        kcn = float(kw.get("kcn", k.KCN_D4))
        arg = df.withColumn("__arg", F.lit(-kcn) * (k.divide(F.col(r), F.col(r0)) - 1.0))
        return arg.withColumn(out, F.lit(0.5) * (F.lit(1.0) + k.erf(F.col("__arg")))).drop("__arg")
    return df.withColumn(out, count(F.col(r), F.col(r0), **kw))


def coordination_number(atoms: DataFrame, *, count=k.exp_count, rcov: Column | None = None, cutoff: float | None = None, cn_max: float | None = None, weight: Column | None = None, grid: bool | None = None, keep: tuple[str, ...] = (), **kw) -> DataFrame:
    """sys_id, atom_idx, z, cn for every real atom, and its columns `keep`.

    `weight` is a Column over the pair (en_i, en_j, zi, zj, d). `cutoff` is inclusive, None
    is no gate. `grid` takes the cell join, by default where a system has more than
    `pairs.GRID_ATOMS` atoms; it needs a cutoff.
    """
    held = atoms.withColumns({"r": lookup("r_cov", F.col("z")) if rcov is None else rcov, "en": lookup("en", F.col("z"))})
    if grid and cutoff is None:
        raise ValueError("the grid join needs a cutoff")
    if cutoff is not None and (needs_grid(atoms) if grid is None else grid):
        near = within_grid(held, cutoff, ("r", "en", *keep))
        own = held.filter("z <> 0").select("sys_id", F.col("atom_idx").alias("i"), F.col("z").alias("zi"), F.lit(0.0).alias("f"), *[F.col(c).alias(f"{c}_i") for c in keep])
        counted = with_count(near.withColumn("r0", F.col("r_i") + F.col("r_j")), count, "f", **kw)
        f = F.col("f") if weight is None else F.col("f") * weight
        rows = counted.select("sys_id", "i", "zi", f.alias("f"), *[f"{c}_i" for c in keep]).unionByName(own)
    else:
        both = pairs(held, diagonal=True, carried=("r", "en", *keep)).withColumn("r0", F.col("r_i") + F.col("r_j"))
        counted = with_count(both, count, "f", **kw)
        f = F.col("f") if weight is None else F.col("f") * weight
        gate = F.col("i") != F.col("j")
        if cutoff is not None:
            gate = gate & (F.col("d") <= cutoff)
        rows = counted.select("sys_id", "i", "zi", F.when(gate, f).otherwise(F.lit(0.0)).alias("f"), *[f"{c}_i" for c in keep])
    cn = rows.groupBy("sys_id", F.col("i").alias("atom_idx"), F.col("zi").alias("z")).agg(F.sum("f").alias("cn"), *[F.first(f"{c}_i").alias(c) for c in keep])
    return cn if cn_max is None else cn.withColumn("cn", k.cut(F.col("cn"), cn_max))


def cn_d3(atoms: DataFrame, count=k.exp_count, **kw) -> DataFrame:
    return coordination_number(atoms, count=count, cutoff=k.CUTOFF_D3, **kw)


def d4_weight() -> Column:
    gap = F.abs(F.col("en_i") - F.col("en_j")) + F.lit(k.D4_K5)
    return F.lit(k.D4_K4) * F.exp(-(gap * gap) / F.lit(k.D4_K6))


def cn_d4(atoms: DataFrame, count=k.erf_count, **kw) -> DataFrame:
    return coordination_number(atoms, count=count, cutoff=k.CUTOFF_D4, weight=d4_weight(), **kw)


def cn_eeq(atoms: DataFrame, count=k.erf_count, cutoff: float | None = k.CUTOFF_EEQ, cn_max: float | None = k.CN_MAX_EEQ, **kw) -> DataFrame:
    return coordination_number(atoms, count=count, cutoff=cutoff, cn_max=cn_max, **kw)


def cn_eeq_en(atoms: DataFrame, count=k.erf_count, cutoff: float | None = k.CUTOFF_EEQ, **kw) -> DataFrame:
    """Signed by the difference of electronegativity, neighbour minus atom."""
    return coordination_number(atoms, count=count, cutoff=cutoff, weight=F.col("en_j") - F.col("en_i"), kcn=k.KCN_EEQ_EN, **kw)


def cn_gfn2(atoms: DataFrame, count=k.gfn2_count, **kw) -> DataFrame:
    return coordination_number(atoms, count=count, cutoff=k.CUTOFF_GFN2, **kw)


def cn_d3_gradient(atoms: DataFrame, dcount=k.dexp_count, cutoff: float | None = k.CUTOFF_D3, rcov: Column | None = None, grid: bool | None = None, **kw) -> DataFrame:
    """sys_id, i, j and d CN_i / d R_j (gx, gy, gz) for i <> j; the term i = j and pairs beyond the cutoff are zero and left out."""
    held = atoms.withColumn("r", lookup("r_cov", F.col("z")) if rcov is None else rcov)
    both = pairs(held, carried=("r",)) if cutoff is None else near(held, cutoff, ("r",), grid)
    f = k.divide(dcount(F.col("d"), F.col("r_i") + F.col("r_j"), **kw), F.col("d"))
    return both.withColumn("f", f).select("sys_id", "i", "j", *[(F.col("f") * F.col(c)).alias(g) for c, g in (("dx", "gx"), ("dy", "gy"), ("dz", "gz"))])
