"""The operators' queries, each over its whole table with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from capledger.llm.ann import nearest_neighbours
from capledger.llm.chat import format_chats
from capledger.llm.common import load
from capledger.llm.licenses import find_licenses
from capledger.llm.mixing import mix_sources, mix_sql
from capledger.llm.ngram_join import classes_sql, document_classes
from capledger.llm.pieces import sample_pieces
from capledger.llm.pii import find_pii
from capledger.llm.quality import quality_scores, scores_sql
from capledger.llm.resharding import resharded
from capledger.llm.secret_scan import find_secrets


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_classes(load(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(load(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(load(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(load(spark, sf_dir, "conversations"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(load(spark, sf_dir, "documents"))


def op6_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharded(load(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(load(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(load(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(load(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_mixing": op3_mixing,
    "op4_chat_format": op4_chat_format,
    "op5_license_scan": op5_license_scan,
    "op6_resharding": op6_resharding,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_pii": op8_pii,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_rules": op10_quality_rules,
}

SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": classes_sql(),
    "op3_mixing": mix_sql(),
    "op10_quality_rules": scores_sql(),
}
