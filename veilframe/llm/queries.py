"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html, langid, linededup, neardup, packing, quality, rules, suffixdedup, tokencount
from .common import crc_fold, table, tokenizer


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, may_use = table(spark, sf_dir, "documents"), ~quality.held_out(F.col("doc_id"))
    model = quality.fit(docs, table(spark, sf_dir, "labels"), may_use)
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 4) == 2
    model = langid.fit(docs, ~held_out)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op4_line_dedup_maximal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole maximal repeated runs; op4_line_dedup follows its oracle SQL, which has windows forward only."""
    return linededup.dedup_lines(table(spark, sf_dir, "documents"), both_ways=True).select("doc_id", "text", "n_lines", "n_removed")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixdedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "coverage", "item_ids")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ALL = (
    op1_quality_classifier,
    op2_near_duplicates,
    op3_language_id,
    op4_line_dedup,
    op4_line_dedup_maximal,
    op5_html_extraction,
    op6_token_counts,
    op7_packing,
    op8_suffix_dedup,
    op9_decontamination,
    op10_quality_rules,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {
    "op2_near_duplicates": neardup.oracle(3, 85),
    "op4_line_dedup": linededup.ORACLE,
    "op4_line_dedup_maximal": linededup.MAXIMAL_ORACLE,
    "op8_suffix_dedup": suffixdedup.ORACLE,
}
