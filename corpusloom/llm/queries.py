"""Queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    ann_tree,
    chat_snapshots,
    html_density,
    ngram_join,
    packing,
    piece_viterbi,
    quality_gbt,
    quality_llr,
    secret_scan,
    token_counts,
)
from .common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract_content(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbt.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality_llr.trusted_ids(table(spark, sf_dir, "labels"))
    return quality_llr.score_documents(table(spark, sf_dir, "documents"), trusted)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_related_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_related(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_viterbi.encode_pieces(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th row's neighbours among all rows."""
    return ann_tree.neighbours(table(spark, sf_dir, "embeddings"), every=50)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_snapshots.maximal_conversations(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_token_counts,
        op3_quality_classifier,
        op4_quality_rules,
        op5_secret_scans,
        op6_ngram_jaccard_join,
        op7_related_packing,
        op8_sentencepiece,
        op9_nearest_neighbours,
        op10_chat_formatting,
    )
}

ORACLES: dict[str, str] = {
    "op4_quality_rules": quality_llr.oracle(),
    "op6_ngram_jaccard_join": ngram_join.oracle(),
    "op10_chat_formatting": chat_snapshots.ORACLE,
}
