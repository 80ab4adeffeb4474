"""Corpus pipeline: quality rules, toxicity, near-dedup, source mixing and packing over `documents`.

Every stage takes all rows that the one before kept and returns whole rows with all their columns, whatever their names;
the last returns pieces. Null or empty texts fail the base rule of the first stage and go. A null doc_id is judged like any
other and is no duplicate. Of repeated rows the third stage keeps one; two texts under one doc_id are judged each by itself.
Ties go by hash of doc_id or text, so a run repeats exactly. Very long texts are whole in every stage. Empty tables pass
through all stages. Without labels the first stage keeps what its base rule keeps and the second keeps everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terraloom.llm import decision_list, mixing, near_dedup, packing, toxicity
from terraloom.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned decision list keeps."""
    return decision_list.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.keep_one(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the seeded epochs of their leaf take them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows that follow the mixture."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("toxicity", without_toxicity), ("near_dedup", one_of_each), ("mixing", source_mixture), ("packing", packed)]
#: Learned rules, shingle links and tokens are not expressible in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
