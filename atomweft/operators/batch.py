"""Ragged and packed forms: pack, unpack, deflate, merge, padded sorts, array restructuring.

Long rows are the working form; packed arrays exist at the edges. The width of a pack is a
one-row maximum joined back, and ties in sorts go by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pack(rows: DataFrame, value: str, pad: float = 0.0, size: int | None = None, mask: bool = False) -> DataFrame:
    """sys_id and `packed` (all of one width, the largest system's or `size`), of rows sys_id, atom_idx, value; with a mask on demand."""
    lists = rows.groupBy("sys_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("atom_idx", value))), lambda s: s[value]).alias("own"))
    if size is None:
        # a second, cheap aggregate over one number a system
        lists = lists.crossJoin(F.broadcast(rows.groupBy("sys_id").agg(F.count("*").alias("n")).agg(F.max("n").cast("int").alias("width"))))
    else:
        lists = lists.withColumn("width", F.lit(size))
    kind = rows.schema[value].dataType
    gap = F.greatest(F.col("width") - F.size("own"), F.lit(0))
    out = ["sys_id", F.concat("own", F.array_repeat(F.lit(pad).cast(kind), gap)).alias("packed")]
    if mask:
        out.append(F.concat(F.transform("own", lambda _: F.lit(True)), F.array_repeat(F.lit(False), gap)).alias("mask"))
    return lists.select(*out)


def deflate(a: Column, pad: float = 0.0) -> Column:
    """An array without its trailing padding."""
    back = F.reverse(a)
    keep = F.aggregate(back, F.struct(F.lit(0).alias("n"), F.lit(False).alias("on")), lambda s, v: F.struct((s["n"] + F.when(s["on"] | (v != pad), 1).otherwise(0)).alias("n"), (s["on"] | (v != pad)).alias("on")), lambda s: s["n"])
    return F.slice(a, 1, keep)


def _any(x: Column, dims: int, pad: float) -> Column:
    """Whether a nested array holds anything but padding."""
    return x != pad if dims == 0 else F.exists(x, lambda y: _any(y, dims - 1, pad))


def _extent(a: Column, dims: int, axis: int, pad: float) -> Column:
    """The size along an axis without trailing padding."""
    per = (lambda x, i: F.when(_any(x, dims - 1, pad), i + 1).otherwise(0)) if axis == 0 else (lambda x, i: _extent(x, dims - 1, axis - 1, pad))
    return F.coalesce(F.array_max(F.transform(a, per)), F.lit(0))


def deflate_nd(a: Column, dims: int, pad: float = 0.0, axis: int | None = None) -> Column:
    """A nested array of `dims` dimensions without trailing padding along any axis; `axis` is spared. One dimension can't be spared."""
    if axis is not None and dims == 1:
        raise ValueError("a one-dimensional array has no other axis to deflate")
    spared = None if axis is None else axis % dims

    def cut(x: Column, left: int, at: int) -> Column:
        x = x if at == spared else F.slice(x, 1, _extent(a, dims, at, pad))
        return x if left == 1 else F.transform(x, lambda y: cut(y, left - 1, at + 1))

    return cut(a, dims, 0)


def deflate2(a: Column, pad: float = 0.0, axis: int | None = None) -> Column:
    """A two-dimensional array without trailing rows and columns of padding; one axis can be spared."""
    return deflate_nd(a, 2, pad, axis)


def _filled(sizes: list[Column], pad: float, kind: str) -> Column:
    out = F.lit(pad).cast(kind)
    for n in reversed(sizes):
        out = F.array_repeat(out, n)
    return out


def pad_nd(a: Column, sizes: list[Column], pad: float = 0.0, kind: str = "double") -> Column:
    """A nested array padded to the sizes, one a dimension."""
    n, *rest = sizes
    inner = F.transform(a, lambda x: pad_nd(x, rest, pad, kind)) if rest else a
    gap = F.greatest(n - F.size(a), F.lit(0))
    return F.concat(inner, F.array_repeat(_filled(rest, pad, kind), gap))


def pack_nd(rows: DataFrame, value: str, dims: int, pad: float = 0.0, kind: str = "double") -> DataFrame:
    """rows with `packed`: nested arrays of `dims` dimensions, all padded to the largest size along each."""
    size = lambda a, k: F.size(a) if k == 0 else F.coalesce(F.array_max(F.transform(a, lambda x: size(x, k - 1))), F.lit(0))
    most = rows.agg(*[F.coalesce(F.max(size(F.col(value), k)), F.lit(0)).alias(f"__n{k}") for k in range(dims)])  # one row
    return rows.crossJoin(F.broadcast(most)).withColumn("packed", pad_nd(F.col(value), [F.col(f"__n{k}") for k in range(dims)], pad, kind)).drop(*[f"__n{k}" for k in range(dims)])


def last_axis(packed: DataFrame, value: str = "packed") -> DataFrame:
    """Packed rows with systems along the last axis: at, packed (an array over the systems in order). Each row is as long as the batch has systems."""
    long = packed.select("sys_id", F.posexplode(value).alias("at", "v"))
    return long.groupBy("at").agg(F.transform(F.sort_array(F.collect_list(F.struct("sys_id", "v"))), lambda s: s["v"]).alias("packed"))


def merge_packed(*batches: DataFrame, pad: float = 0.0, axis: int = 0) -> DataFrame:
    """Packed batches (sys_id from 0, packed) as one: along axis 0 systems follow one another, padded to one width; along axis 1 rows of equal number are joined end to end, those that a batch lacks as padding."""
    if axis not in (0, 1, -1):
        raise ValueError(f"no axis {axis} in packed batches")
    if axis == 0:
        both = merge(*[b.select("sys_id", F.col("packed").alias("own")) for b in batches])
        return pack_nd(both, "own", 1, pad, _element(batches[0])).select("sys_id", "packed")
    out = None
    for n, b in enumerate(batches):
        width = b.agg(F.coalesce(F.max(F.size("packed")), F.lit(0)).alias(f"w{n}"))  # one row
        b = b.select("sys_id", F.col("packed").alias(f"p{n}"))
        out = (b if out is None else out.join(b, "sys_id", "full")).crossJoin(F.broadcast(width))
    kind = _element(batches[0])
    return out.select("sys_id", F.concat(*[F.coalesce(f"p{n}", _filled([F.col(f"w{n}")], pad, kind)) for n in range(len(batches))]).alias("packed"))


def _element(b: DataFrame) -> str:
    return b.schema["packed"].dataType.elementType.simpleString()


def unpack(packed: DataFrame, pad: float = 0.0) -> DataFrame:
    """sys_id, atom_idx, value of packed rows, without trailing padding."""
    return packed.select("sys_id", F.posexplode(deflate(F.col("packed"), pad)).alias("atom_idx", "value"))


def merge(*batches: DataFrame) -> DataFrame:
    """The systems of several batches one after the other, renumbered by a running offset; rows sys_id, atom_idx, ...

    The offset runs over one row a batch; within a batch systems keep their order.
    """
    out, offset = None, F.lit(0).cast("long")
    for n, b in enumerate(batches):
        b = b.withColumn("batch", F.lit(n))
        out = b if out is None else out.unionByName(b)
    top = out.groupBy("batch").agg((F.max("sys_id") + 1).alias("n"))
    offset = top.withColumn("offset", F.sum("n").over(Window.orderBy("batch")) - F.col("n")).select("batch", "offset")
    return out.join(F.broadcast(offset), "batch").withColumn("sys_id", F.col("sys_id") + F.col("offset")).drop("batch", "offset")


def psort(rows: DataFrame, value: str, padded: Column | None = None) -> DataFrame:
    """Rows with their `rank` from 0 within the system: ascending, padding last, ties by index."""
    first = [F.coalesce(padded, F.lit(False))] if padded is not None else []
    order = Window.partitionBy("sys_id").orderBy(*first, value, "atom_idx")
    return rows.withColumn("rank", F.row_number().over(order) - 1)


def pargsort(rows: DataFrame, value: str, padded: Column | None = None) -> DataFrame:
    """sys_id, rank, atom_idx: the index that stands at each rank."""
    return psort(rows, value, padded).select("sys_id", "rank", "atom_idx")


def eye(n: Column, value: float = 1.0) -> Column:
    """An identity matrix of n rows, times `value`."""
    at = F.sequence(F.lit(0), n - 1)
    return F.when(n > 0, F.transform(at, lambda i: F.transform(at, lambda j: F.when(i == j, F.lit(value)).otherwise(F.lit(0.0))))).otherwise(F.array().cast("array<array<double>>"))


def reshape_fortran(a: Column, rows: int, cols: int) -> Column:
    """A flat column-major array as a matrix."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda j: F.get(a, i + j * rows)))


def symmetrize(coo: DataFrame, force: bool = False, tol: float = 10 * 2.220446049250313e-16) -> DataFrame:
    """(m, i, j, v) averaged with its transpose; unless forced, an asymmetric matrix raises when read. An entry that a sparse list lacks is zero."""
    both = coo.select("m", "i", "j", "v", F.lit(0.0).alias("t")).unionByName(coo.select("m", F.col("j").alias("i"), F.col("i").alias("j"), F.lit(0.0).alias("v"), F.col("v").alias("t")))
    both = both.groupBy("m", "i", "j").agg(F.sum("v").alias("v"), F.sum("t").alias("t"))
    mean = (F.col("v") + F.col("t")) / 2.0
    if not force:
        close = F.abs(F.col("v") - F.col("t")) <= F.lit(tol) + F.lit(tol) * F.abs(F.col("t"))
        mean = F.when(close, mean).otherwise(F.raise_error(F.lit("matrix is not symmetric")).cast("double"))
    return both.select("m", "i", "j", mean.alias("v"))


def memory_mb(*dims: Column, itemsize: int = 8) -> Column:
    """Megabytes of a dense array."""
    out = F.lit(float(itemsize))
    for d in dims:
        out = out * d.cast("double")
    return out / F.lit(1024.0**2)


def any_to_double(text: Column) -> Column:
    """Text as a number; what is none raises."""
    return F.coalesce(text.try_cast("double"), F.raise_error(F.concat(F.lit("no number: "), text)).cast("double"))
