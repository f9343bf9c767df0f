"""The training-corpus pipeline: documents in, token ids of clean, distinct, uncontaminated documents out.

Every stage takes any table with doc_id and text, other columns whatever they are called, and gives back the same
columns (the last: ids). Empty tables stay empty. Null texts go in the first stage, as they have too few words; a stage
alone keeps them (near copies of each other, without spans or hits, of no ids). Rows with a null doc_id stay in each
stage: they can't be named as a copy or a place. Repeated rows become one in the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import decontam, piece_codec, rules, simhash, substring
from quillstone.llm.common import Workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the standard policy keep; null and blank texts go."""
    return rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id; equal rows become one, different texts of one doc_id are told apart."""
    return simhash.near_dedup(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated spans; the first place of a span keeps them. A document of which all words go stays, with an empty text."""
    return substring.dedup(docs).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the coverage limit, without their spans of benchmark text; ties (exactly the limit) go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, lossless) of each document left; null and empty texts have no ids."""
    return piece_codec.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL has no fingerprints, suffix automaton or segmentation of this kind; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's result is written and read again for the next."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
