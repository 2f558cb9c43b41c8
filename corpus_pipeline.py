"""A training corpus from documents: language ID, exact dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir); all but the last return rows of documents with their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import langid
from logloom.llm.decontaminate import keep_clean
from logloom.llm.entries import table, tokenizer
from logloom.llm.exact_dedup import keep_first
from logloom.llm.packing import pack
from logloom.llm.simhash import keep_one
from logloom.session import checkpoint, workers_can_import


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language of the labels; those without letters or far from all profiles go."""
    workers_can_import(spark)
    return langid.keep_known(docs, langid.fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of the texts that are equal without white space."""
    workers_can_import(spark)
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies."""
    workers_can_import(spark)
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    workers_can_import(spark)
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    workers_can_import(spark)
    return pack(docs, tokenizer())


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: The stages are not expressible in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
