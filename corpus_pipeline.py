"""The corpus pipeline: documents to a clean, mixed and sharded training set. Every stage works on all rows its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, jaccard, mixing, sharding, toxicity
from tidemark.llm.common import cut, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity chain rejects go."""
    return toxicity.acceptable_documents(docs, table(spark, folder, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity of 0.75 or more."""
    return jaccard.one_per_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that share ten consecutive words with a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, folder, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Whole documents, each as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The shard and the place in it of every row: doc_id, size, tokens, text_crc32, shard, slot."""
    return sharding.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: a trained chain and greedy packing are beyond SQL: tests compare the stages with brute-force versions
ORACLE_SQL: str | None = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
