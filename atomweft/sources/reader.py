"""Structure files as tables. Spark lists and opens the files, so any store that it reads will do.

A file is one row of text; the parser runs once for each file in Arrow batches. In permissive
mode a file that can't be read gives one row with its error and nulls, else the query fails.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import elements
from . import parsers

STRUCTURE = "path string, frame int, atom_idx int, symbol string, x double, y double, pz double, error string"


def _texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


ROWS = 20_000  #: rows of a batch that is handed on
_KINDS = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}


def _each(texts: DataFrame, rows_of: Callable, schema: str) -> DataFrame:
    """Rows of `schema` of each file, as rows_of(path, value) gives them; however many come of a batch of files, a task holds `ROWS` and a few files."""
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    def run(batches):
        rows = []
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for path, value in zip(part.column("path").to_pylist(), part.column("value").to_pylist()):
                    for r in rows_of(path, value):
                        rows.append(r)
                        if len(rows) == ROWS:
                            yield batch(rows)
                            rows = []
        if rows:
            yield batch(rows)

    return texts.select("path", "value").mapInArrow(run, schema)


def parse(texts: DataFrame, ftype: str | None = None, mode: str = "failfast") -> DataFrame:
    """Rows of STRUCTURE from (path, value); works on static and streaming tables."""

    def rows_of(path, value):
        for r in parsers.STRUCTURES[parsers.kind_of(path, ftype)](value.splitlines()):
            yield (path, *r, None)

    def permissive(path, value):
        try:
            return list(rows_of(path, value))
        except Exception as e:
            return [(path, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]

    return _each(texts, permissive if mode == "permissive" else rows_of, STRUCTURE)


def read(spark: SparkSession, path: str | list[str], ftype: str | None = None, mode: str = "failfast") -> DataFrame:
    """All structures below path; the type comes from each file's suffix unless given."""
    return parse(_texts(spark, path), ftype, mode)


def as_atoms(rows: DataFrame) -> DataFrame:
    """Atoms with a system id from path and frame (a 64-bit hash), and both kept."""
    return rows.filter(F.col("symbol").isNotNull()).select(F.xxhash64("path", "frame").alias("sys_id"), "atom_idx", elements.number(F.col("symbol")).alias("z"), "x", "y", "pz", "path", "frame")


def _orca(lines):
    energy, grad = parsers.orca_engrad(lines)
    return [(energy, n, *g) for n, g in enumerate(grad)] or [(energy, 0, None, None, None)]


#: Kinds of single-valued files: rows of a file's lines, and their schema.
VALUES = {
    "turbomole_energy": (lambda lines: [(parsers.turbomole_energy(lines),)], "energy double"),
    "orca_engrad": (_orca, "energy double, atom_idx int, gx double, gy double, gz double"),
    "tblite_engrad": (lambda lines: [(n, e, *g) for n, (e, g) in enumerate(zip(*parsers.tblite_engrad(lines)))], "atom_idx int, energy double, gx double, gy double, gz double"),
}


def values(texts: DataFrame, kind: str) -> DataFrame:
    """path and the values of files of a kind in VALUES, from (path, value); works on static and streaming tables."""
    parser, schema = VALUES[kind]
    return _each(texts, lambda path, value: ((path, *r) for r in parser(value.splitlines())), "path string, " + schema)


def turbomole_energy(spark: SparkSession, path) -> DataFrame:
    """path, energy."""
    return values(_texts(spark, path), "turbomole_energy")


def orca_engrad(spark: SparkSession, path) -> DataFrame:
    """path, energy, atom_idx, gx, gy, gz; a file without a gradient gives one row."""
    return values(_texts(spark, path), "orca_engrad")


def tblite_engrad(spark: SparkSession, path) -> DataFrame:
    """path, atom_idx, energy, gx, gy, gz."""
    return values(_texts(spark, path), "tblite_engrad")


def dotfiles(systems: DataFrame, name: str = ".CHRG", column: str = "charge") -> DataFrame:
    """systems (with `path`, a file's address) and the number in the dotfile of each one's folder; 0 where there is none.

    Spark's own readers skip names with a leading dot, so executors open one file for each
    different folder, by pyarrow's filesystems. What isn't a whole number is an error.
    """
    folder = F.regexp_replace("path", "/[^/]*$", "")

    def run(batches):
        from pyarrow import fs

        for pdf in batches:
            out = []
            for where in pdf["__dir"]:
                store, at = (fs.LocalFileSystem(), where) if where.startswith("/") else fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", where))
                if store.get_file_info(f"{at}/{name}").type == fs.FileType.File:
                    with store.open_input_stream(f"{at}/{name}") as f:
                        out.append((where, parsers.dotfile(f.read().decode().splitlines())))
            yield pd.DataFrame(out, columns=["__dir", column])

    table = systems.select(folder.alias("__dir")).distinct().mapInPandas(run, f"__dir string, {column} int")
    return systems.withColumn("__dir", folder).join(table, "__dir", "left").withColumn(column, F.coalesce(column, F.lit(0))).drop("__dir")
