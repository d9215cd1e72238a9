"""The thin op queries over whole driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, language, mixing, ngrams, packing, quality, secrets, simhash, syncmers, token_files, warc, wordpiece


def op1_secrets(spark: SparkSession, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """The ledger lasts, one for each input folder, so a second run scans only what is new."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return secrets.digest(secrets.scan(docs, ledger or common.kept_dir(spark, "secrets", sf_dir)))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return packing.best_fit(common.documents(spark, sf_dir), wordpiece.default_path())


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.digest(common.documents(spark, sf_dir))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = warc.write(warc.planned(pages), common.shared_dir(spark, "warc"))
    found = warc.referred(warc.assemble(warc.read(archives, with_payload=False)))
    return found.select(F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs = common.documents(spark, sf_dir)
    held = language.fold(F.col("doc_id"), 3) == 1
    model = language.train(docs.select("doc_id", "text", "lang").filter(~held))
    found = language.predict(docs, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    found = simhash.classes(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs = common.documents(spark, sf_dir)
    manifest = token_files.write(docs, common.shared_dir(spark, "tokens"), wordpiece.default_path())
    return token_files.read(manifest)


def op9_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs = common.documents(spark, sf_dir)
    held = language.fold(F.col("doc_id"), 5) == 1
    scored = ngrams.train_and_score(docs, ~held, common.shared_dir(spark, "trie"))[1]
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    measured = common.materialise(quality.measure(common.documents(spark, sf_dir)), common.shared_dir(spark, "measured"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.judge(measured, quality.fit(measured, labels))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_secrets": op1_secrets, "op2_mix": op2_mix, "op3_pack": op3_pack, "op4_syncmers": op4_syncmers, "op5_warc": op5_warc, "op6_language": op6_language, "op7_simhash": op7_simhash, "op8_token_files": op8_token_files, "op9_ngrams": op9_ngrams, "op10_quality": op10_quality}


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": secrets.SQL, "op2_mix": mixing.SQL, "op5_warc": warc.SQL}
