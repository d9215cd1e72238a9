"""Angles, linearity, centre of mass, inertia, rotational constants and system properties."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels as k
from ..functions import units
from ..functions.elements import lookup, symbol
from .pairs import isclose, near, pairs, real_atoms


def bond_angles(atoms: DataFrame) -> DataFrame:
    """sys_id, i, j, k, angle in degrees at vertex j, for all triples of different atoms."""
    arm = pairs(atoms).select("sys_id", F.col("i").alias("j"), F.col("j").alias("e"), "dx", "dy", "dz")
    one = arm.select("sys_id", "j", F.col("e").alias("i"), F.col("dx").alias("ax"), F.col("dy").alias("ay"), F.col("dz").alias("az"))
    two = arm.select("sys_id", "j", F.col("e").alias("k"), F.col("dx").alias("bx"), F.col("dy").alias("by"), F.col("dz").alias("bz"))
    both = one.join(two, ["sys_id", "j"]).filter("i <> k")
    dot = lambda a, b: F.col(a + "x") * F.col(b + "x") + F.col(a + "y") * F.col(b + "y") + F.col(a + "z") * F.col(b + "z")
    cosine = k.clamp(k.divide(dot("a", "b"), F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b"))), -1.0, 1.0)
    return both.select("sys_id", "i", "j", "k", F.degrees(F.acos(cosine)).alias("angle"))


def _bent(angle: Column, atol: float, rtol: float) -> Column:
    return ~(isclose(angle, F.lit(0.0), atol, rtol) | isclose(angle, F.lit(180.0), atol, rtol))


def _cosine(ax, ay, az, bx, by, bz) -> Column:
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    a, b = (ax, ay, az), (bx, by, bz)
    return k.clamp(k.divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), -1.0, 1.0)


def is_linear(atoms: DataFrame, atol: float = 1e-8, rtol: float = 1e-5) -> DataFrame:
    """sys_id, is_linear: all angles close to 0 or 180; one or two atoms are linear.

    The angles at the first atom between the second and each other one are looked at first:
    one look an atom tells all bent systems. Only those that pass have all their angles made.
    """
    real = real_atoms(atoms)
    order = Window.partitionBy("sys_id").orderBy("atom_idx")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one, two = ([F.nth_value(c, n).over(whole) for c in ("x", "y", "pz")] for n in (1, 2))
    seen = real.select("sys_id", "x", "y", "pz", F.row_number().over(order).alias("n"), *[c.alias(f"{s}{n}") for n, cs in ((1, one), (2, two)) for s, c in zip("xyz", cs)])
    arms = [F.col(f"{s}2") - F.col(f"{s}1") for s in "xyz"] + [F.col(c) - F.col(f"{s}1") for c, s in zip(("x", "y", "pz"), "xyz")]
    bad = (F.col("n") > 2) & _bent(F.degrees(F.acos(_cosine(*arms))), atol, rtol)
    first = seen.groupBy("sys_id").agg(F.bool_or(bad).alias("bent"), F.max("n").alias("n"))
    passed = first.filter(~F.col("bent") & (F.col("n") > 2)).select("sys_id")
    rest = bond_angles(real.join(passed, "sys_id", "left_semi")).groupBy("sys_id").agg(F.bool_or(_bent(F.col("angle"), atol, rtol)).alias("late"))
    return first.join(rest, "sys_id", "left").select("sys_id", (~F.col("bent") & ~F.coalesce("late", F.lit(False))).alias("is_linear"))


def with_mass(atoms: DataFrame, atomic_units: bool = True) -> DataFrame:
    return atoms.withColumn("mass", lookup("mass_au" if atomic_units else "mass", F.col("z")))


def center_of_mass(massed: DataFrame) -> DataFrame:
    """sys_id, cx, cy, cz of atoms with `mass`; a system without mass lies at the origin."""
    total = k.reciprocal(F.sum("mass"))
    return massed.groupBy("sys_id").agg(*[(F.sum(F.col("mass") * F.col(c)) * total).alias(o) for c, o in (("x", "cx"), ("y", "cy"), ("pz", "cz"))])


def relative_to_com(massed: DataFrame) -> DataFrame:
    """The atoms with positions relative to their system's centre of mass."""
    return massed.join(center_of_mass(massed), "sys_id").withColumns({"x": F.col("x") - F.col("cx"), "y": F.col("y") - F.col("cy"), "pz": F.col("pz") - F.col("cz")}).drop("cx", "cy", "cz")


def inertia(massed: DataFrame, center_pa: bool = True, already_com: bool = False) -> DataFrame:
    """sys_id and the six entries ixx .. izz; center_pa gives tr(I) 1 - I."""
    own = massed if already_com else relative_to_com(massed)
    m = {"xx": ("x", "x"), "yy": ("y", "y"), "zz": ("pz", "pz"), "xy": ("x", "y"), "xz": ("x", "pz"), "yz": ("y", "pz")}
    out = own.groupBy("sys_id").agg(*[F.sum(F.col("mass") * F.col(a) * F.col(b)).alias(f"i{n}") for n, (a, b) in m.items()])
    if not center_pa:
        return out
    trace = F.col("ixx") + F.col("iyy") + F.col("izz")
    return out.select("sys_id", *[(trace - F.col(f"i{n}")).alias(f"i{n}") for n in ("xx", "yy", "zz")], *[(-F.col(f"i{n}")).alias(f"i{n}") for n in ("xy", "xz", "yz")])


def eigenvalues3(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> list[Column]:
    """Ascending eigenvalues of symmetric 3 x 3 matrices in closed form."""
    q = (xx + yy + zz) / 3.0
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + off * 2.0) / 6.0)
    s = F.when(p > 0, p).otherwise(F.lit(1.0))
    a, b, c, d, e, f = (xx - q) / s, (yy - q) / s, (zz - q) / s, xy / s, xz / s, yz / s
    r = k.clamp((a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2.0, -1.0, 1.0)
    phi = F.acos(r) / 3.0
    high, low = q + p * 2.0 * F.cos(phi), q + p * 2.0 * F.cos(phi + F.lit(2.0 * math.pi / 3.0))
    return [low, q * 3.0 - high - low, high]


def rotational_constants(massed: DataFrame) -> DataFrame:
    """sys_id, rot_a, rot_b, rot_c from the moments in ascending order; a vanishing moment gives 0."""
    c_au = 137.035999139
    m = inertia(massed)
    w = eigenvalues3(*[F.col(f"i{n}") for n in ("xx", "yy", "zz", "xy", "xz", "yz")])
    moments = m.select("sys_id", *[v.alias(n) for v, n in zip(w, ("w0", "w1", "w2"))])
    rot = lambda v: F.when(F.col(v) <= 1e-6, F.lit(0.0)).otherwise(k.reciprocal(F.lit(4.0 * math.pi * c_au) * F.col(v)))
    return moments.select("sys_id", rot("w0").alias("rot_a"), rot("w1").alias("rot_b"), rot("w2").alias("rot_c"))


def nuclear_repulsion(atoms: DataFrame, cutoff: float = 25.0, grid: bool | None = None) -> DataFrame:
    """sys_id, enn: half the sum of Zi Zj / d over pairs within the cutoff."""
    if cutoff is None:
        raise TypeError("cutoff must be a number")
    term = k.divide((F.col("zi") * F.col("zj")).cast("double"), F.col("d"))
    terms = near(atoms, cutoff, grid=grid).select("sys_id", term.alias("e"))
    none = real_atoms(atoms).select("sys_id", F.lit(0.0).alias("e"))  # systems without a pair
    return terms.unionByName(none).groupBy("sys_id").agg((F.lit(0.5) * F.sum("e")).alias("enn"))


def total_mass(atoms: DataFrame, atomic_units: bool = False) -> DataFrame:
    return with_mass(real_atoms(atoms), atomic_units).groupBy("sys_id").agg(F.sum("mass").alias("mass"))


def composition(atoms: DataFrame) -> DataFrame:
    return real_atoms(atoms).groupBy("sys_id", "z").agg(F.count("*").alias("n"))


def sum_formula(atoms: DataFrame) -> DataFrame:
    """sys_id, formula: symbols by ascending number, a count of one is not written."""
    part = F.concat(symbol(F.col("z")), F.when(F.col("n") > 1, F.col("n").cast("string")).otherwise(F.lit("")))
    parts = composition(atoms).groupBy("sys_id").agg(F.sort_array(F.collect_list(F.struct("z", part.alias("part")))).alias("parts"))
    return parts.select("sys_id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formula"))


def in_unit(df: DataFrame, column: str, factor: str) -> DataFrame:
    return df.withColumn(column, units.convert(F.col(column), factor))
