"""Pair and triple expansion of atoms within systems, masks, and the grid join for large systems.

Atoms: sys_id, atom_idx, z, x, y, pz (Bohr); z = 0 is padding and takes part in nothing.
Pairs come from a window over sys_id that gives each atom its system's atoms as an array: one
exchange and one sort, both of which every later grouping by system or atom reuses, and no
join. The diagonal is kept where a reduction follows, so that isolated atoms keep a row and
no join back is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.kernels import EPS

ATOM = ("sys_id", "atom_idx", "z", "x", "y", "pz")


def real_atoms(atoms: DataFrame) -> DataFrame:
    """Only the atoms that are no padding."""
    return atoms.filter(F.col("z") != 0)


def late(condition: Column) -> Column:
    """A condition that Spark leaves where it stands; it would repeat what the tested column is made of, below that column, once for each time it is named."""
    return condition & (F.spark_partition_id() >= 0)


def _beside(atoms: DataFrame, left: list[tuple[str, str]], right: list[tuple[str, str]]) -> DataFrame:
    """Each real atom beside every one of its system, itself included; left and right name the columns of the two. Streams have no such windows and are joined."""
    real = real_atoms(atoms)
    named = lambda names: [F.col(a).alias(b) for a, b in names]
    if real.isStreaming:
        return real.select("sys_id", *named(left)).join(real.select("sys_id", *named(right)), "sys_id")
    every = F.collect_list(F.struct(*named(right))).over(Window.partitionBy("sys_id"))
    return real.filter("sys_id IS NOT NULL").select("sys_id", *named(left), every.alias("__all")).select("sys_id", *[b for _, b in left], F.inline("__all"))


def _names(s: str, carried: tuple[str, ...]) -> list[tuple[str, str]]:
    return [("atom_idx", s), ("z", f"z{s}"), ("x", f"x{s}"), ("y", f"y{s}"), ("pz", f"p{s}"), *[(c, f"{c}_{s}") for c in carried]]


def _side(atoms: DataFrame, s: str, carried: tuple[str, ...]) -> DataFrame:
    return atoms.select("sys_id", *[F.col(a).alias(b) for a, b in _names(s, carried)])


def pairs(atoms: DataFrame, diagonal: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """Ordered pairs of real atoms: sys_id, i, j, zi, zj, dx, dy, dz (from i to j), d and the carried columns of both."""
    both = _beside(atoms, _names("i", carried), _names("j", carried))
    if not diagonal:
        both = both.filter("i <> j")
    both = both.withColumns({"dx": F.col("xj") - F.col("xi"), "dy": F.col("yj") - F.col("yi"), "dz": F.col("pj") - F.col("pi")})
    square = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")
    keep = ["sys_id", "i", "j", "zi", "zj", "dx", "dy", "dz", *[f"{c}_{s}" for c in carried for s in "ij"]]
    return both.select(*keep, F.sqrt(F.greatest(square, F.lit(EPS))).alias("d"))


def mask_pairs(atoms: DataFrame, mask_diagonal: bool = True) -> DataFrame:
    """The pairs that a real-pair mask has."""
    both = _beside(atoms, [("atom_idx", "i")], [("atom_idx", "j")])
    return both.filter("i <> j") if mask_diagonal else both


def _triples(atoms: DataFrame, mask_diagonal: bool, mask_self: bool) -> DataFrame:
    """sys_id, i, j and `ks`, the third atoms of the triples that begin with i, j (some have none)."""
    real = real_atoms(atoms).filter("sys_id IS NOT NULL")
    every = F.collect_list("atom_idx").over(Window.partitionBy("sys_id"))
    both = real.select("sys_id", F.col("atom_idx").alias("i"), every.alias("all")).select("sys_id", "i", "all", F.explode("all").alias("j"))
    if mask_self:
        return both.filter("i <> j").select("sys_id", "i", "j", F.filter("all", lambda k: (k != F.col("i")) & (k != F.col("j"))).alias("ks"))
    return both.select("sys_id", "i", "j", (F.filter("all", lambda k: k != F.col("j")) if mask_diagonal else F.col("all")).alias("ks"))


def mask_triples(atoms: DataFrame, mask_diagonal: bool = True, mask_self: bool = True) -> DataFrame:
    """Triples of real atoms; mask_diagonal drops j = k, mask_self any two equal."""
    return _triples(atoms, mask_diagonal, mask_self).select("sys_id", "i", "j", F.explode("ks").alias("k"))


def count_triples(atoms: DataFrame, mask_diagonal: bool = True, mask_self: bool = True) -> DataFrame:
    """sys_id, i, j, and of mask_triples the number `n` and the sum `k` of third atoms: told from each system's array, with no row a triple and no table of groups. Atoms of a system must differ in atom_idx."""
    both = _triples(atoms, mask_diagonal, mask_self).filter(late(F.size("ks") > 0))
    return both.select("sys_id", "i", "j", F.size("ks").cast("long").alias("n"), F.aggregate("ks", F.lit(0).cast("long"), lambda s, k: s + k).alias("k"))


def within(atoms: DataFrame, cutoff: float, carried: tuple[str, ...] = ()) -> DataFrame:
    """Ordered pairs with d <= cutoff, by the plain self join: for systems of up to some hundred atoms."""
    return pairs(atoms, carried=carried).filter(F.col("d") <= cutoff)


#: Half of a cell's surroundings: itself and those of its 26 neighbours that come after it.
HALF = [(a, b, c) for a in (0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) >= (0, 0, 0)]


def within_grid(atoms: DataFrame, cutoff: float, carried: tuple[str, ...] = ()) -> DataFrame:
    """The same pairs by an equi-join on grid cells of the cutoff's size, for systems of over `GRID_ATOMS` atoms.

    One side stays in its cell, the other visits its own and 13 neighbours, so each pair meets
    once and is given both ways; work grows with an atom's surroundings and not with the square
    of the system, and a large system is many keys. Small systems in the same table have few
    pairs to save and 15 copies of an atom to lose, so they are paired where they are.
    """
    if atoms.isStreaming:
        return _by_cells(atoms, cutoff, carried)
    sized = real_atoms(atoms).withColumn("__n", F.count("*").over(Window.partitionBy("sys_id")))
    small, large = (sized.filter(c).drop("__n") for c in (F.col("__n") <= GRID_ATOMS, F.col("__n") > GRID_ATOMS))
    return within(small, cutoff, carried).unionByName(_by_cells(large, cutoff, carried))


def _by_cells(atoms: DataFrame, cutoff: float, carried: tuple[str, ...]) -> DataFrame:
    real = real_atoms(atoms)
    at = lambda names: dict(zip(("cx", "cy", "cz"), [F.floor(F.col(c) / F.lit(float(cutoff))) for c in names]))
    home = _side(real, "j", carried).withColumns(at(("xj", "yj", "pj")))
    step = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in HALF])
    visit = _side(real, "i", carried).withColumns(at(("xi", "yi", "pi"))).withColumn("s", F.explode(step))
    visit = visit.withColumns({"cx": F.col("cx") + F.col("s.a"), "cy": F.col("cy") + F.col("s.b"), "cz": F.col("cz") + F.col("s.c"), "own": (F.col("s.a") == 0) & (F.col("s.b") == 0) & (F.col("s.c") == 0)}).drop("s")
    both = visit.join(home, ["sys_id", "cx", "cy", "cz"]).filter(~F.col("own") | (F.col("i") < F.col("j")))
    both = both.withColumns({"dx": F.col("xj") - F.col("xi"), "dy": F.col("yj") - F.col("yi"), "dz": F.col("pj") - F.col("pi")})
    square = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")
    both = both.withColumn("d", F.sqrt(F.greatest(square, F.lit(EPS)))).filter(F.col("d") <= cutoff)
    turned = {"i": "j", "j": "i", "zi": "zj", "zj": "zi"} | {f"{c}_{s}": f"{c}_{t}" for c in carried for s, t in ("ij", "ji")}
    keep = ["i", "j", "zi", "zj", "dx", "dy", "dz", *[f"{c}_{s}" for c in carried for s in "ij"]]
    one = F.struct(*[F.col(c).alias(c) for c in keep])
    other = F.struct(*[(-F.col(c) if c in ("dx", "dy", "dz") else F.col(turned[c])).alias(c) for c in keep])
    return both.select("sys_id", "d", F.explode(F.array(one, other)).alias("p")).select("sys_id", *[f"p.{c}" for c in keep], "d")


GRID_ATOMS = 500  #: from this size of the largest system on the grid join is taken


def needs_grid(atoms: DataFrame) -> bool:
    """Whether the largest system has more than `GRID_ATOMS` atoms: a count by system; a stream isn't counted."""
    if atoms.isStreaming:
        return False
    most = atoms.groupBy("sys_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) > GRID_ATOMS


def near(atoms: DataFrame, cutoff: float, carried: tuple[str, ...] = (), grid: bool | None = None) -> DataFrame:
    """Ordered pairs with d <= cutoff, by the grid where the systems are large (or as told)."""
    grid = needs_grid(atoms) if grid is None else grid
    return within_grid(atoms, cutoff, carried) if grid else within(atoms, cutoff, carried)


def isclose(a: Column, b: Column, atol: float = 1e-8, rtol: float = 1e-5) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
