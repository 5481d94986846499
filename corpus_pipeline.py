"""A corpus pipeline of five stages; each returns the documents that its operator leaves, the last one where they are packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import decontaminate, near_dedup, packing, quality_classifier, quality_rules
from matchloom.llm.common import discard, stage_at


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality_classifier.keep_accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their band."""
    return quality_rules.keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its place in a sequence."""
    return packing.best_fit(docs)


STAGES = [("quality_classifier", quality), ("quality_rules", rules), ("near_dedup", dedup), ("decontamination", decontaminated), ("packing", packed)]

#: A classifier, tokenizers and alignments aren't SQL; tests check the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents; each result is written as Parquet and read again, and goes when the next one's is there.

    Defined results: a null or empty text, or one of fewer than ten words, fails the quality rules; of rows alike in id and text one stays; an
    empty table gives no rows; without labels of both classes the first stage keeps every row.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, step in STAGES:
        docs, folder = stage_at(step(spark, docs, sf_dir))
        discard(spark, last)
        last = folder
    return docs
