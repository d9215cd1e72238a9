"""All pairs of rows within a batch, in tiles of a bounded number of left rows against a stream of right rows.

Left rows are dealt to blocks by a hash, right rows visit each block of their batch; a batch is
many keys, a task holds a block's left rows, in parts of `ROWS`, and a few right ones, and no
pair is shuffled. What is shuffled is the right side once for each block of its batch. These are
`BLOCKS` for all but the smallest and largest batches, so it grows with the rows, not with the pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 1024  #: left rows of a tile
BLOCKS = 8  #: blocks of a batch of at least `ROWS` rows and at most `BLOCKS * BLOCKS` times as many
PAIRS = 1 << 17  #: pairs made at a time


def _changes(table: pa.RecordBatch, names: list[str], last: tuple | None) -> tuple[list[int], tuple]:
    """Where a run of equal keys begins, and the last row's key."""
    n, new = table.num_rows, np.zeros(table.num_rows, bool)
    for c in names:
        a = table.column(c)
        new[1:] |= pc.not_equal(a.slice(0, n - 1), a.slice(1)).to_numpy(zero_copy_only=False)
    key = lambda at: tuple(table.column(c)[at].as_py() for c in names)
    new[0] = key(0) != last
    return np.flatnonzero(new).tolist(), key(n - 1)


def blocks(rows: Column) -> Column:
    """Of a batch with so many left rows."""
    return F.greatest(F.least(F.ceil(rows * BLOCKS / F.lit(ROWS)), F.lit(BLOCKS).cast("long")), F.ceil(rows / F.lit(ROWS * BLOCKS)))


def pairwise(x: DataFrame, y: DataFrame, on: list[str], prepare: Callable, kernel: Callable, value: str) -> DataFrame:
    """on, i, j, `value` (double) for rows (on, id, v) of x against those of y with equal, non-null `on`.

    kernel(prepare(xv), prepare(yv)), of two Arrow arrays of v, gives a matrix of values, as a
    masked array where some are null, and which of them there are (None: all).
    """
    sized = x.groupBy(*on).agg(blocks(F.count("*")).alias("__n"))
    left = x.join(sized, on).select(*on, F.pmod(F.xxhash64("id"), F.col("__n")).alias("__block"), F.lit(0).alias("__side"), F.col("id").alias("i"), F.lit(None).cast(y.schema["id"].dataType).alias("j"), "v")
    right = y.join(sized, on).select(*on, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("__block"), F.lit(1).alias("__side"), F.lit(None).cast(x.schema["id"].dataType).alias("i"), F.col("id").alias("j"), "v")
    tile = [*on, "__block"]
    n = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = left.unionByName(right).repartition(n, *tile).sortWithinPartitions(*tile, "__side")
    schema = T.StructType([*[x.schema[c] for c in on], T.StructField("i", x.schema["id"].dataType), T.StructField("j", y.schema["id"].dataType), T.StructField(value, T.DoubleType())])

    def made(key: list, held: list[tuple], j: pa.Array, v: pa.Array):
        for i, xv in held:
            step = max(1, PAIRS // len(i))
            for at in range(0, len(j), step):
                js, (d, real) = j.slice(at, step), kernel(xv, prepare(v.slice(at, step)))
                rows, cols = np.divmod(np.arange(d.size) if real is None else np.flatnonzero(real), len(js))
                d = d.ravel() if real is None else d[real]
                out = pa.array(np.ma.getdata(d), mask=np.ma.getmaskarray(d)) if isinstance(d, np.ma.MaskedArray) else pa.array(d)
                yield pa.RecordBatch.from_arrays([*[pa.repeat(k, len(rows)) for k in key], i.take(pa.array(rows)), js.take(pa.array(cols)), out], names=[*on, "i", "j", value])

    def run(batches):
        last, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            starts, end = _changes(b, tile, last)
            last = end
            if starts[:1] != [0]:
                starts = [0, *starts]
            else:
                held = []
            for a, z in zip(starts, [*starts[1:], b.num_rows]):
                held = held if a == 0 else []
                part = b.slice(a, z - a)
                lefts = int(pc.sum(pc.equal(part.column("__side"), 0)).as_py())
                for k in range(0, lefts, ROWS):  # a block can be somewhat larger
                    own = part.slice(k, min(ROWS, lefts - k))
                    held.append((own.column("i"), prepare(own.column("v"))))
                if lefts < part.num_rows:
                    rest = part.slice(lefts)
                    yield from made([part.column(c)[0] for c in on], held, rest.column("j"), rest.column("v"))

    return both.mapInArrow(run, schema)
