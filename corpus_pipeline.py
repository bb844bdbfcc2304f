"""Corpus pipeline: language, quality, near copies, benchmark leaks, packing.

Each stage takes what the one before it kept, written as Parquet and read again. The first four return
documents in all their columns; the last returns the pieces of the packed sequences. Documents whose
language is not told clearly, bad documents, all but one of each class of near copies and documents that
contain a benchmark item go. Null and empty texts go with the first stage; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factorloom.llm import common, decontam, langid, neardup, packing, quality


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells with a margin that isn't narrow."""
    return langid.keep_identified(docs, langid.train(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores 0.5 or more."""
    return quality.keep_good(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return neardup.keep_one(docs, common.shared_dir(spark))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing.pack_documents(docs)


STAGES = [("language ID", language), ("quality", good), ("near-dedup", distinct), ("decontamination", clean), ("packing", pack)]

#: Compression, a fitted machine and a tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, folder = common.table(spark, sf_dir, "documents"), common.shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = common.written(stage(spark, docs, sf_dir), f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
