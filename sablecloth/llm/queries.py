"""Queries of this subpackage: thin uses of its operators on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import byte_bpe, fingerprints, mixing, near_dedup, oracles, quality_classifier, quality_rules, secret_scans, substring_dedup, suffix_dedup, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_next(_table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the last number of a page's path is that of its document: a page is bad if that is toxic or of low quality
    pages = _table(spark, sf_dir, "pages")
    number = F.expr("try_cast(regexp_extract(path, '/([0-9]+)([.]html|/)?$', 1) AS bigint)")
    shown = pages.select("page_id", url_filters.path_of(F.col("url")).alias("path")).select("page_id", number.alias("doc_id"))
    labels = _table(spark, sf_dir, "labels").select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("bad"))
    return url_filters.judge(pages, shown.join(labels, "doc_id").select("page_id", "bad"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ["assign", "access", "hex"]
    found = secret_scans.scan(_table(spark, sf_dir, "documents"), "doc_id")
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in base), F.sha2(secret_scans.listed(base), 256).alias("base_sha256"), secret_scans.listed(secret_scans.KINDS).alias("spans"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *quality_rules.RATIOS, *(f"most_{name}" for name in quality_rules.RATIOS)
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_url_filters, op3_secret_scans, op4_quality_rules, op5_suffix_dedup, op6_substring_dedup, op7_quality_classifier, op8_mixing, op9_near_dedup, op10_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    """The others fit models, draw sketches or samples, or are too slow in SQL over whole
    tables; tests hold those against plain versions."""
    return {"op2_url_filters": oracles.url_filters_sql(), "op4_quality_rules": oracles.quality_rules_sql(), "op5_suffix_dedup": oracles.suffix_sql(), "op6_substring_dedup": oracles.substring_sql(), "op9_near_dedup": oracles.near_dedup_sql()}
