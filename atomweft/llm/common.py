"""Shared helpers: the cluster's shared folder, materialised tables, word splitting."""

from __future__ import annotations

import gc
import hashlib
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space bytes.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"


_SCRATCH: list[str] = []


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share; it goes when the session's JVM ends, or by release()."""
    path = f"{shared_base(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    fs, target = _file(spark, path)
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    _SCRATCH.append(path)
    return path


def scratch_now() -> int:
    """A mark for release()."""
    return len(_SCRATCH)


def release(spark: SparkSession, mark: int) -> None:
    """Delete the scratch folders made since the mark; what reads them must have been written."""
    for path in _SCRATCH[mark:]:
        remove(spark, path)
    del _SCRATCH[mark:]


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def shared_base(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session (tests) gets a temporary one; a cluster gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def kept_dir(spark: SparkSession, tag: str, of: str) -> str:
    """A lasting path below the shared folder, one for each input `of`."""
    return f"{shared_base(spark)}/{tag}-{hashlib.sha1(of.encode()).hexdigest()[:12]}"


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet and read it again: lineage ends, executors may be lost later."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the Hadoop API, whatever store it is on."""
    fs, target = _file(spark, path)
    fs.delete(target, True)


def let_go(spark: SparkSession) -> None:
    """Collect garbage, so that Spark deletes the shuffle files of tables that have been written and dropped.

    Twice and with a pause, as the last query is referred to until its end has been announced.
    """
    for _ in range(2):
        time.sleep(0.7)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, so that further columns never clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Documents can be long, so an Arrow batch is bounded by its bytes too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
