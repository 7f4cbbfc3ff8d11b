"""The training-data pipeline: five stages, each of them one operator of ``rowloom.llm`` over all rows its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowloom.llm import decontaminate, mixing, quality, simhash, tokens
from rowloom.llm.common import materialise
from rowloom.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.filter_rejected(docs, vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.tiktoken"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return simhash.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson copies of documents, so that all sources weigh the same; in shuffled order."""
    return mixing.mix(docs, keep_copy=False)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written as planes in the shuffled order, and read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.encode_and_read_back(docs, vocabulary("byte_bpe_50k.json"), order="given")


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mix", source_mix), ("token_output", token_output)]

# Tokenisers and fingerprints are beyond SQL; tests/llm/test_pipeline.py holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
