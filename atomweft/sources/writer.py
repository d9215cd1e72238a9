"""Structure text from atoms, rendered by built-in functions, and the sinks that write it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import elements, units

WRITABLE = {"xyz": "xyz", "log": "xyz", "turbomole": "turbomole", "coord": "turbomole", "tmol": "turbomole", "tm": "turbomole"}
KNOWN = {"qm9", "json", "qcschema", "mol", "sdf", "gen", "pdb", "qchem", "poscar", "contcar", "vasp", "crystal", "ein", "gaussian"}


def _lines(atoms: DataFrame, line: Column) -> DataFrame:
    """sys_id, n and the lines of the system's real atoms in order."""
    rows = atoms.filter("z <> 0") if line is not None else atoms
    return rows.groupBy("sys_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("atom_idx", line.alias("line")))), lambda s: s["line"]), "\n").alias("body"))


def xyz_text(atoms: DataFrame, fmt: str = "%20.14f", comment: str = "") -> DataFrame:
    """sys_id, text: one XYZ frame a system, in Angstrom."""
    if "\n" in comment:
        raise ValueError("a comment has no line breaks")
    at = [F.col(c) * F.lit(units.AU2AA) for c in ("x", "y", "pz")]
    line = F.format_string(f"%-2s {fmt} {fmt} {fmt}", elements.symbol(F.col("z")), *at)
    return _lines(atoms, line).select("sys_id", F.concat(F.col("n").cast("string"), F.lit(f"\n{comment.rstrip()}\n"), "body", F.lit("\n")).alias("text"))


def turbomole_text(atoms: DataFrame, fmt: str = "%20.14f") -> DataFrame:
    """sys_id, text: a $coord section a system, in Bohr; X is written q."""
    name = F.lower(F.when(F.col("z") == 0, F.lit("Q")).otherwise(elements.symbol(F.col("z"))))
    line = F.format_string(f"{fmt}  {fmt}  {fmt}      %s ", "x", "y", "pz", name)
    rows = atoms.groupBy("sys_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("atom_idx", line.alias("line")))), lambda s: s["line"]), "\n").alias("body"))
    return rows.select("sys_id", F.concat(F.lit("$coord\n"), "body", F.lit("\n$end\n")).alias("text"))


def qcschema_text(atoms: DataFrame) -> DataFrame:
    """sys_id, text: a QCSchema molecule a system."""
    a = F.sort_array(F.collect_list(F.struct("atom_idx", "z", "x", "y", "pz")))
    rows = atoms.filter("z <> 0").withColumn("s", elements.symbol(F.col("z"))).groupBy("sys_id").agg(a.alias("a"), F.sort_array(F.collect_list(F.struct("atom_idx", "s"))).alias("s"))
    molecule = F.struct(F.flatten(F.transform("a", lambda r: F.array(r["x"], r["y"], r["pz"]))).alias("geometry"), F.transform("s", lambda r: r["s"]).alias("symbols"))
    return rows.select("sys_id", F.to_json(F.struct(molecule.alias("molecule"))).alias("text"))


def write(atoms: DataFrame, path: str, ftype: str = "xyz", mode: str = "error", files: bool = False, **kw) -> None:
    """Write a folder with a text file a partition; XYZ frames, and sections of Turbomole coordinates, follow one another.

    With `files` a Turbomole system is a folder of its own (sys_id=...), which programs want
    that read one structure; that is a file a system, so keep it to few. An existing folder
    is an error unless mode is "overwrite".
    """
    key = ftype.lower()
    if key in KNOWN:
        raise NotImplementedError(f"writing {ftype!r} is not supported")
    if key not in WRITABLE:
        raise ValueError(f"unknown type {ftype!r}")
    texts = {"xyz": xyz_text, "turbomole": turbomole_text}[WRITABLE[key]](atoms, **{"fmt": "%22.15f"} | kw)
    texts = texts.select("sys_id", F.regexp_replace("text", "\n$", "").alias("text"))
    if files and WRITABLE[key] == "turbomole":
        texts.write.mode(mode).partitionBy("sys_id").text(path)
    else:
        texts.select("text").write.mode(mode).text(path)
