"""Registered queries of this subpackage and the SQL that must return the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terraloom.llm import decision_list, decontamination, fingerprints, hard_negatives, language_id, licenses, mixing, near_dedup, packing, prefix_trie, token_files, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op2_minhash_near_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate component of every document at five-word shingles and a similarity of 0.75."""
    return near_dedup.near_duplicates(table(spark, folder, "documents")).drop("text_hash")


@query("op6_token_files")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Index of the token files of all documents, read back from them."""
    return token_files.encode_and_index(table(spark, folder, "documents"))


@query("op10_mixture_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens that follow the sources' shares."""
    return packing.pack(table(spark, folder, "documents"))


@query("op4_source_mixing", mixing.ORACLE)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, epochs and tokens that fill the budget of every domain-language-source leaf."""
    return mixing.mixture(table(spark, folder, "documents")).drop("text_hash")


@query("op7_quality_rules")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every document, the base rule and the verdict of the learned decision list."""
    return decision_list.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document by the learned lexicon."""
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op1_language_id")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the labelled ones that are not held out."""
    return language_id.identify(table(spark, folder, "documents"))


@query("op8_warc_round_trip")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the archives written from all pages, read back."""
    return warc.archive_round_trip(table(spark, folder, "pages"))


@query("op9_license_scan", licenses.ORACLE)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Licence that each document is, and notices among its lines."""
    return licenses.scan(table(spark, folder, "documents"))


@query("op5_fingerprints")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and how like they are."""
    return fingerprints.fingerprints(table(spark, folder, "documents"))


@query("op11_decontamination", decontamination.ORACLE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in ten-word windows of benchmark items, and the items."""
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_prefix_trie", prefix_trie.ORACLE)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    return prefix_trie.trie(table(spark, folder, "conversations"))


@query("op12_hard_negatives", hard_negatives.ORACLE)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector and its positives, searched among all vectors."""
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"))
