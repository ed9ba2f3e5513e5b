"""The corpus pipeline: quality rules, SimHash near-dedup, suffix-array dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept. The first four return the columns of ``documents``: rejected
documents are gone after stage 1, one document of each near-duplicate group is
left after stage 2 (the smallest doc_id), repeated passages are cut from the
texts in stage 3, and stage 4 holds each document as often as the mix takes it.
The last returns (doc_id, lang, source, ids, n_tokens, ids_sha256, decoded_sha256).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, common, mixing, quality_rules, queries, simhash, suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), queries.vocabulary_path())


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", exact_dedup),
    ("mixing to target weights", mix),
    ("BPE encoding and decoding", encode),
]
#: Fingerprints, suffix arrays and merges are not for SQL: tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again before the next; the last is the caller's to write."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with common.scratch(spark) as made:  # what a stage wrote for itself goes once its result is written
            docs = common.cut(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
            written, before = made.pop(), written
            made += [before] if before else []
    return STAGES[-1][1](spark, docs, sf_dir)
