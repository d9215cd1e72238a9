"""Connected components of a link table by alternating large and small stars.

Every round is written to the shared folder and read again, so lineage stays short. Minima
are combined before the shuffle; stars with a hot centre are joined, not collected, and the
join's large partitions can be split at run time.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first())


def joined_anew(rows: DataFrame, found: DataFrame, key: str, how: str = "inner", anew=F.bitwise_not) -> DataFrame:
    """rows joined with one row a key, grouped by that key just before.

    The key goes in as its complement (or another one-to-one function `anew`): an expression
    that the group-by isn't known to be dealt by, so both sides have exchanges of their own and
    a hot key's rows can be split between tasks.
    """
    found = found.withColumn("__key", anew(F.col(key))).drop(key)
    return rows.join(found, anew(F.col(key)) == F.col("__key"), how).drop("__key")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return joined_anew(both.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = joined_anew(down, least, "u")
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) with v the smallest node that u reaches, for every u that reaches a smaller one. Edges: two long columns u, v.

    Rounds go on until one changes nothing: a graph of n nodes needs some log(n) squared at most.
    """
    spark = edges.sparkSession
    base, old, now = common.shared_dir(spark, "components"), None, None
    edges = common.materialise(edges.filter("u <> v").distinct(), f"{base}/0")
    for n in itertools.count(1):
        edges = common.materialise(_small(_large(edges)), f"{base}/{n}")
        old, now = now, _state(edges)
        common.remove(spark, f"{base}/{n - 1}")
        if now == old or not now[0]:
            return edges
