"""A small training-data pipeline: quality, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the `docs` of the next one. All but the last return the columns of documents. A stage learns
from what its predecessor kept, so an empty table or one without labels still passes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import langid, near_texts, packing, quality
from riskloom.session import settle


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are surely in one of the languages learned."""
    return langid.keep_known(docs, public_tokenizers.path("piece_bpe_32k.model"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    return near_texts.keep_first(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the remaining documents goes; workers share their machines with full heaps by now."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, remembered=150_000)


STAGES = [("quality", good_quality), ("language", known_language),
          ("near_duplicates", without_copies), ("packing", packed)]

# A trained classifier and sampled signatures cannot be said in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
