"""A corpus pipeline of five stages, each an operator of sablecloth.llm.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents.  run() writes each stage's
rows to the shared folder and reads them again, so a lost executor costs at most
the current stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sablecloth.llm import byte_bpe, mixing, near_dedup, quality_classifier, secret_scans
from sablecloth.llm.cluster import give_back_heap, written

#: Least similarity, in percent, of the near-duplicates that go.
NEAR_PERCENT = 80
#: Share of the clean domain's tokens that mixing may not go under for its targets.
LEAST_CLEAN = 0.95
#: Stages two to four fit models and draw statistics; SQL can't express the first.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_classifier.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.deduplicated(docs, NEAR_PERCENT)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secret_scans.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay at the rates that bring the domains to their targets; clean ones stay."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), least_first=LEAST_CLEAN)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and round trip of every document that is left."""
    import public_tokenizers

    give_back_heap(spark)  # the stages before took all they could get; here most memory is Python's
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality), ("near-dedup", near_duplicates), ("secret scans", secrets), ("mixing", mix), ("byte-level BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
