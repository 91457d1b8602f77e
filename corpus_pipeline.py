"""A training corpus from raw documents in five stages. Each takes (spark, docs, sf_dir) and returns the next one's documents; the last returns packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserine.llm.common import stored
from tesserine.llm.mixing import mix_documents
from tesserine.llm.packing import pack_documents
from tesserine.llm.quality import drop_low_quality
from tesserine.llm.simhash import simhash_dedup
from tesserine.llm.templates import drop_recurring_lines


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels, scores below 0.5 go."""
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; every document stays."""
    return drop_recurring_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words at a similarity of 0.8, that with the smallest id stays."""
    return simhash_dedup(docs, words=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The flattest mix of sources that reads each in full once, and none more than twice."""
    return mix_documents(docs, budget="cover", max_repeats=2.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences of 1024 ids."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: SQL can't express tokenisation, and none of the trained and hashed stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
