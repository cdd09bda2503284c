"""The training-data pipeline: five stages, each over all that the one before kept.

Every stage takes nulls in any column, texts of any length, repeated rows and
extra columns, which stay as they are up to the last stage; an empty table
gives an empty one. What each does with null texts and ids, and with rows that
are alike, is said below or in the operator's module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semnet.llm import decontam, neardup, packing, pii, quality_fm
from semnet.llm.base import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the documents that reach this stage. Without usable labels all stay; a null text is scored as an empty one, repeated rows each."""
    return quality_fm.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.80): the one with the least id; of repeated rows of it, one. Rows without words stay; a null id comes after all others."""
    return neardup.deduplicate(docs, percent=80, rows=neardup.ROWS_80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items, repeated ones each; null and empty texts have none and stay."""
    return decontam.without_items(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars is the new length, null of a null text."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of every piece of every document, repeated rows each; a text without words has no piece."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("sanitise", sanitise), ("pack", pack)]

#: The classifier's decisions can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
