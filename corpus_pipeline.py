"""A training corpus from raw documents: rules, classifier, near copies, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.llm import minhash, packing, pii, quality_model, quality_rules
from zonecast.llm.common import stored, table


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; references come from the documents at hand."""
    return quality_rules.keep_good(docs, quality_rules.fit_references(docs))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps. It learns from the raw table, where what the rules reject is still there."""
    weights = quality_model.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", 5, 0)
    return quality_model.keep_likely(docs, weights)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8."""
    return minhash.keep_one(docs, 5, 80)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that remain, each a sequence: their ids, with the checksum beside them."""
    pieces = packing.pack_pieces(docs, packing.byte_vocabulary())
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("minhash_near_dedup", near_duplicates_stage),
    ("pii", personal_data_stage),
    ("packing", packing_stage),
]

#: Fitted models, tokens and signatures are beyond SQL; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to what the one before it stored."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
