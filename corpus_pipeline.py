"""A corpus from raw documents to packed sequences: stages, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from askgrid.llm import exact_dedup, packing, quality_rules, simhash, substring_dedup
from askgrid.llm.queries import END_ID, WordIds
from askgrid.llm.rows import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality rules keep."""
    return quality_rules.quality_rules(docs).filter("kept").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id."""
    return exact_dedup.keep_distinct(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    return simhash.keep_representatives(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages a document with a smaller doc_id has."""
    return substring_dedup.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, placed in sequences of 2048 tokens."""
    return packing.pack(docs, WordIds(public_tokenizers.path("word_bpe_49k.json")), END_ID)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("simhash", near),
    ("substring_dedup", substrings),
    ("packing", pack),
]

# Fingerprints and token ids have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
