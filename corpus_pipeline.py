"""Corpus pipeline: language ID, near-duplicates, secrets, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. A stage's
result is written as Parquet in the shared folder and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atomweft.llm import common, language, mixing, packing, secrets, simhash, wordpiece


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the language machines reject: without a letter, or with contradicting verdicts.

    Null and empty texts have no letter. Where no document has a language, all with a letter
    stay. Repeated rows, null ids and further columns stay as they are.
    """
    common.small_batches(spark)
    return language.accepted(docs, language.train(docs.select("doc_id", "text", "lang")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component: the smallest id (null last), then the least text hash.

    Rows equal in id and text are one row afterwards. Null and empty texts have fingerprint
    zero, like each other.
    """
    common.small_batches(spark)
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret found, and keep n_chars in step; no document goes. Null texts stay null.

    The ledger lasts, one for each sf_dir, so texts that were scanned before aren't scanned again.
    """
    return secrets.redact(docs, common.kept_dir(spark, "secrets", sf_dir))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents as often, and as far, as their source's target has it.

    A document can come twice or as its beginning, under the same id. Null is a source; texts
    without a word are of no size and go. The order among equal rows is any.
    """
    return mixing.mixed_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences. Null and empty texts are their end id; repeated rows are packed each."""
    common.small_batches(spark)
    return packing.best_fit(docs, wordpiece.default_path())


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("source_mix", source_mix), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents table. A stage's scratch tables and its input go when its result is written."""
    docs, base, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.shared_dir(spark, "pipeline"), None
    for n, (_, stage) in enumerate(STAGES):
        began = common.scratch_now()
        docs = common.materialise(stage(spark, docs, sf_dir), f"{base}/{n}")
        common.release(spark, began)
        if before is not None:
            common.remove(spark, before)
        before = f"{base}/{n}"
    return docs
