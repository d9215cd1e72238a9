"""Mol: a lazy façade over atoms, with the properties of their systems."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import checks, geometry
from .operators import ncoord as nc
from .operators.pairs import pairs
from .sources import reader


@dataclass(frozen=True)
class Mol:
    """Atoms (sys_id, atom_idx, z, x, y, pz) of one or many systems; immutable, so nothing cached goes stale."""

    atoms: DataFrame
    name: str | None = None
    charges: DataFrame | None = None  #: sys_id, charge, uhf (unpaired electrons); without it all are 0

    def __post_init__(self):
        checks.schema(self.atoms)

    @classmethod
    def from_path(cls, spark: SparkSession, path: str, ftype: str | None = None, name: str | None = None) -> Mol:
        """Structures below a path, with the charges and unpaired electrons in the .CHRG and .UHF beside each file."""
        atoms = reader.as_atoms(reader.read(spark, path, ftype))
        systems = atoms.select("sys_id", "path").distinct()
        charges = reader.dotfiles(reader.dotfiles(systems), ".UHF", "uhf").select("sys_id", "charge", "uhf")
        return cls(atoms, name, charges)

    def charge(self) -> DataFrame:
        """sys_id, charge and uhf of every system."""
        if self.charges is None:
            return self.atoms.select("sys_id").distinct().withColumns({"charge": F.lit(0), "uhf": F.lit(0)})
        return self.charges

    def with_atoms(self, atoms: DataFrame) -> Mol:
        return replace(self, atoms=atoms)

    def cached(self) -> Mol:
        """Keep the atoms in the cluster's cache, spilling to disk."""
        return replace(self, atoms=self.atoms.persist())

    def clear_cache(self) -> None:
        self.atoms.unpersist()

    def distances(self) -> DataFrame:
        return pairs(self.atoms, diagonal=True).select("sys_id", "i", "j", "d")

    def enn(self, cutoff: float = 25.0) -> DataFrame:
        return geometry.nuclear_repulsion(self.atoms, cutoff)

    def com(self) -> DataFrame:
        return geometry.center_of_mass(geometry.with_mass(self.atoms))

    def mass(self, atomic_units: bool = False) -> DataFrame:
        return geometry.total_mass(self.atoms, atomic_units)

    def sum_formula(self) -> DataFrame:
        return geometry.sum_formula(self.atoms)

    def cn(self, model: str = "d4", **kw) -> DataFrame:
        return {"d3": nc.cn_d3, "d4": nc.cn_d4, "eeq": nc.cn_eeq, "eeq_en": nc.cn_eeq_en, "gfn2": nc.cn_gfn2}[model](self.atoms, **kw)
