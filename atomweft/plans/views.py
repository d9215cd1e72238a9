"""How the driver's tables are read as molecular data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NUMBERS = (1, 6, 7, 8, 9, 14, 16, 17)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as atoms in a box of about 8 Bohr; an order is a system."""
    order = Window.partitionBy("sys_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    z = F.get(F.array(*map(F.lit, NUMBERS)), (F.col("l_partkey") % len(NUMBERS)).cast("int"))
    at = {"x": F.col("l_quantity") * F.lit(0.16), "y": F.col("l_extendedprice") * F.lit(0.00008), "pz": F.col("l_discount") * F.lit(80.0)}
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "sys_id")  # before the window, so that what is dealt by sys_id stays so
    return lines.select("sys_id", (F.row_number().over(order) - 1).alias("atom_idx"), z.alias("z"), *[c.alias(n) for n, c in at.items()])


def padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every fourth atom of a system as padding."""
    return atoms(spark, sf_dir).withColumn("z", F.when(F.col("atom_idx") % 4 == 3, F.lit(0)).otherwise(F.col("z")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch, id, v: embeddings as arrays of doubles, their label as batch."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("batch"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def matrices(spark: SparkSession, sf_dir: str, n: int = 8) -> DataFrame:
    """m, i, j, v: each embedding's first n * n numbers as a matrix by rows."""
    one = vectors(spark, sf_dir).select(F.col("id").alias("m"), F.posexplode(F.slice("v", 1, n * n)).alias("at", "v"))
    return one.select("m", F.floor(F.col("at") / n).cast("int").alias("i"), (F.col("at") % n).cast("int").alias("j"), "v")


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, with one zero.

    Spark rounds by way of the decimal digits, which takes longer than what most queries compute.
    Doubles that are clearly on one side of a tie are rounded as whole numbers of the last
    digit instead, to the same bits; ties, large numbers, NaN and null are left to Spark.
    """
    x = F.col(c) if isinstance(c, str) else c
    r, scale = F.round(x, digits), F.lit(float(10**digits))
    last = x * scale
    clear = (F.abs(last) < 1e12) & (F.abs(last - F.rint(last)) < 0.499)
    return F.when(clear, F.rint(last) / scale + F.lit(0.0)).otherwise(F.when(r == 0, F.lit(0.0)).otherwise(r))


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded."""
    return df.select(*[rounded(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
