"""Streaming ingest of structure files: new files of a folder become atoms and results as they arrive.

A system arrives whole in its file, so per-system results need no state and no watermark
where the trigger's files are worked on by a batch function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import reader


def structures(spark: SparkSession, folder: str, ftype: str = "xyz", mode: str = "permissive", files_per_trigger: int = 1000) -> DataFrame:
    """A streaming table in the columns of reader.STRUCTURE."""
    texts = spark.readStream.option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).format("text").load(folder)
    return reader.parse(texts.select(F.col("_metadata.file_path").alias("path"), "value"), ftype, mode)


def run(spark: SparkSession, folder: str, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, ftype: str = "xyz"):
    """Apply an atom operator to each trigger's systems and append its result to `out` as Parquet, once per batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        operator(reader.as_atoms(batch)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return structures(spark, folder, ftype).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
