"""Bond lengths and bond orders from coordination numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions.elements import lookup
from .ncoord import with_count
from .pairs import late, near, pairs


def bond_length(atoms: DataFrame, diagonal: bool = True, cutoff: float | None = None) -> DataFrame:
    """sys_id, i, j, d, bond_length for atoms that carry `cn`; the diagonal is included. With a cutoff, different atoms within it only, for large systems by the grid."""
    z = F.col("z")
    held = atoms.withColumns({"ra": lookup("bo_r0", z) + lookup("bo_cf", z) * F.col("cn"), "en": lookup("bo_en", z), "p1": lookup("bo_p1", z), "p2": lookup("bo_p2", z)})
    carried = ("ra", "en", "p1", "p2")
    both = pairs(held, diagonal=diagonal, carried=carried) if cutoff is None else near(held, cutoff, carried)
    gap = F.col("en_i") - F.col("en_j")
    half = F.lit(0.5)
    scale = F.lit(1.0) - half * (F.col("p1_i") + F.col("p1_j")) * F.abs(gap) - half * (F.col("p2_i") + F.col("p2_j")) * gap * gap
    return both.select("sys_id", "i", "j", "d", (scale * (F.col("ra_i") + F.col("ra_j"))).alias("bond_length"))


def bond_order(atoms: DataFrame, count=k.erf_count, cutoff: float | None = None, **kw) -> DataFrame:
    """sys_id, i, j, bond_order of every pair of different real atoms; with a cutoff, of those within it: orders fall to nothing at some bond lengths."""
    kw = {"kcn": k.KCN_D4} | kw if count is k.erf_count else kw
    both = bond_length(atoms, diagonal=False, cutoff=cutoff)
    return with_count(both, count, "bond_order", r0="bond_length", **kw).select("sys_id", "i", "j", "bond_order")


def bonded(orders: DataFrame, least: float = 0.3) -> DataFrame:
    return orders.filter(late(F.col("bond_order") > least))
