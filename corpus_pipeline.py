"""The corpus pipeline: toxicity, quality rules, near-duplicates, personal data, packing.

Every stage takes what its predecessor kept, as a frame read back from Parquet, and all
but the last return the columns of ``documents``.  Two stages are trained and two are
iterative, so SQL cannot express the whole: the tests hold each stage against a
brute-force version or held-out labels instead.

Null, empty and blank texts have no words, so they go with the quality rules; very long texts
are worked on whole in every stage; rows without a doc_id and rows that repeat one are judged by
their texts; further columns are kept as they are, whatever their names; an empty table gives
an empty frame in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quiverspark.llm import near_dup, packing, pii, quality, toxicity
from quiverspark.plans.workspace import write_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; a score of 0.5 rejects, null and empty texts have none to show."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep the quality rules; null, empty and blank texts go, an anomaly at the threshold stays."""
    return quality.rule_abiding(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, at a similarity of 0.8 or more: that of the smallest doc_id.

    Null, empty and blank texts and rows without a doc_id belong to no group and stay; rows that
    repeat the doc_id that stays, stay with it.
    """
    return near_dup.deduplicated(docs, threshold=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their personal data; null and empty texts stay as they are."""
    return pii.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences; a null or empty text is its end id alone."""
    return packing.pack_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
