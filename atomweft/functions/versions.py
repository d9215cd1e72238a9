"""Version strings as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_tuple(version: Column) -> Column:
    """major, minor and patch as an array of three ints; what follows -, + or _, and letters after a number, are left out. Fewer parts raise."""
    parts = F.split(F.regexp_extract(version, "^[^-+_]*", 0), "[.]")
    number = lambda n: F.regexp_extract(F.get(parts, n), "^[^a-zA-Z]*", 0).try_cast("int")
    wrong = F.raise_error(F.concat(F.lit("no version MAJOR.MINOR.PATCH: "), version)).cast("array<int>")
    three = F.array(*[number(n) for n in range(3)])
    return F.when(version.isNull(), F.lit(None)).when((F.size(parts) < 3) | F.exists(three, lambda x: x.isNull()), wrong).otherwise(three)
