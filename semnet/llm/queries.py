"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, digests, langid, lines, neardup, packing, phrases, pii, quality_fm, urls, warc, whiten
from .base import table
from .oracles import ORACLES


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_frequency_rules(table(spark, sf_dir, "documents"))


def op2_setsketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).fillna("", ["items"])


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(spark, sf_dir)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(table(spark, sf_dir, "conversations"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # near copies are one cluster, and don't share a bin
    return packing.pack(docs, clusters=neardup.clusters(docs))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.exact_duplicates(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_frequency, op2_setsketch_neardup, op3_quality_fm, op4_template_decontam, op5_url_filter,
        op6_chat_format, op7_warc, op8_best_fit_packing, op9_language_id, op10_pii,
        op11_phrase_collocations, op12_exact_dedup, op13_embedding_whitening,
    )
}
ORACLE_SQL = ORACLES
