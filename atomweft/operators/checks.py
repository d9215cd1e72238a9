"""Validation of atom tables: reports a system, or an error on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.elements import MAX_ELEMENT
from ..functions.kernels import EPS
from .pairs import real_atoms


class EmptyFileError(RuntimeError):
    """A file without what is to be read."""


class FormatError(RuntimeError):
    """A file that is not in its format."""


class FormatErrorXYZ(FormatError):
    pass


class FormatErrorTM(FormatError):
    pass


class FormatErrorORCA(FormatError):
    pass


class MoleculeError(RuntimeError):
    """A structure that can't be."""


class MoleculeWarning(UserWarning):
    pass


class DtypeError(ValueError):
    pass


class DeviceError(RuntimeError):
    pass


def coldfusion(atoms: DataFrame, threshold: float = EPS**0.75) -> DataFrame:
    """sys_id, collides: whether two real atoms are nearer than the threshold (no floor under distances)."""
    a = real_atoms(atoms).select("sys_id", F.col("atom_idx").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), F.col("pz").alias("pi"))
    b = a.toDF("sys_id", "j", "xj", "yj", "pj")
    both = a.join(b, "sys_id")
    d = F.sqrt(sum(((F.col(f"{c}i") - F.col(f"{c}j")) * (F.col(f"{c}i") - F.col(f"{c}j")) for c in "xyp"), F.lit(0.0)))
    return both.groupBy("sys_id").agg(F.bool_or((F.col("i") != F.col("j")) & (d < threshold)).alias("collides"))


def content(atoms: DataFrame, max_element: int = MAX_ELEMENT, allow_batched: bool = True, threshold: float = EPS**0.75) -> DataFrame:
    """sys_id, max_z, min_z, ok: numbers in range, no padding unless batched, no collision."""
    z = atoms.groupBy("sys_id").agg(F.max("z").alias("max_z"), F.min("z").alias("min_z"))
    ok = (F.col("max_z") <= max_element) & (F.col("min_z") >= (0 if allow_batched else 1)) & ~F.coalesce("collides", F.lit(False))
    return z.join(coldfusion(atoms, threshold), "sys_id", "left").select("sys_id", "max_z", "min_z", ok.alias("ok"))


def require(report: DataFrame, ok: str, message: str) -> DataFrame:
    """The report; reading it raises at the first system that is not ok."""
    return report.withColumn(ok, F.when(F.col(ok), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(message + ": system "), F.col("sys_id").cast("string"))).cast("boolean")))


def deflatable(atoms: DataFrame, pad: float = 0.0) -> DataFrame:
    """sys_id, last_is_pad: whether the last atom lies at the padding value on all axes and would be lost on deflation."""
    last = atoms.groupBy("sys_id").agg(F.max_by(F.struct("x", "y", "pz"), "atom_idx").alias("p"))
    return last.select("sys_id", ((F.col("p.x") == pad) & (F.col("p.y") == pad) & (F.col("p.pz") == pad)).alias("last_is_pad"))


def shifted(atoms: DataFrame, by: float = 1e-3, pad: float = 0.0) -> DataFrame:
    """Atoms of systems that could not be deflated, moved by `by` on all axes; the others as they are."""
    rows = atoms.join(deflatable(atoms, pad), "sys_id")
    return rows.withColumns({c: F.when(F.col("last_is_pad"), F.col(c) + by).otherwise(F.col(c)) for c in ("x", "y", "pz")}).drop("last_is_pad")


def shape(packed: DataFrame) -> DataFrame:
    """sys_id, ok of packed systems: as many positions as numbers, three coordinates each."""
    three = F.forall("positions", lambda p: F.size(p) == 3)
    return packed.select("sys_id", ((F.size("numbers") == F.size("positions")) & three).alias("ok"))


def depth(kind: T.DataType) -> int:
    return 1 + depth(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def dimension(df: DataFrame, column: str, least: int = -1, most: int = 10) -> None:
    """Raise unless the column's array depth is within bounds."""
    if not isinstance(least, int) or not isinstance(most, int):
        raise TypeError("bounds must be whole numbers")
    n = depth(df.schema[column].dataType)
    if not least <= n <= most:
        raise RuntimeError(f"{column} has {n} dimensions; {least} to {most} are allowed")


def schema(atoms: DataFrame) -> DataFrame:
    """atoms, if its columns are those of an atom table with a whole-numbered z."""
    for c in ("sys_id", "atom_idx", "z", "x", "y", "pz"):
        if c not in atoms.columns:
            raise ValueError(f"no column {c}")
    if not isinstance(atoms.schema["z"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise DtypeError("z must be a whole number")
    return atoms
