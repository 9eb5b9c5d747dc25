"""Whole plans: from documents to entities, masked texts and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.boxes import tighten
from ..functions.labels import is_low_signal, is_oversized, normalize_category, risk_tier
from ..functions.payloads import parse_answer
from ..operators.detect import detect, holds_any
from ..operators.fuzzy import localize_quotes
from ..operators.localize import span_boxes
from ..operators.resolve import resolve_entities
from ..operators.segments import mask_text
from ..sources.words import word_spans

#: Types whose recognizers every engine can check alike: those that the oracle SQL tells.
TYPES = ["EMAIL_ADDRESS", "IP_ADDRESS", "CREDIT_CARD", "PHONE_NUMBER", "PASSWORD"]


def placed_words(docs: DataFrame) -> DataFrame:
    """Words under the names that the localization takes."""
    return word_spans(docs).select("doc_id", "word_index", F.col("word").alias("text"), F.col("start").alias("start_char"), F.col("end").alias("end_char"), "bbox", "line_key")


def detections(docs: DataFrame, spans: DataFrame, source: str = "Presidio", held: bool = False) -> DataFrame:
    """Spans as detections with the boxes of their words. Only texts with spans are cut into words.

    ``held``: ``docs`` has few texts without spans, so that spans need not be worked out
    once more to find those with some.
    """
    some = docs if held else docs.join(spans.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = spans.withColumn("seq", F.col("start") * 64 + F.pmod(F.hash("entity_type", "end"), F.lit(64)))
    boxes = span_boxes(rows, placed_words(some), ["doc_id", "seq", "entity_type", "start", "end", "score", "match"])
    return boxes.select(
        "doc_id", "seq", F.col("match").alias("entity_text"), "entity_type", F.col("score").alias("confidence_score"), F.lit(source).alias("source"),
        "boxes", F.array(F.lit(source)).alias("supporting_sources"), F.lit(None).cast("string").alias("decision_reason"),
    )


def answer_spans(answers: DataFrame, words: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Spans of what a language model's raw answers (doc_id, page_number, raw) name, found again in the page's words."""
    items = answers.withColumn("_a", parse_answer(F.col("raw"), config.llm_raw_limit)).select("doc_id", "page_number", F.explode("_a.items").alias("i"))
    items = items.select("doc_id", "page_number", "i.quote", normalize_category("i.category", "i.quote").alias("category"), "i.confidence")
    items = items.where(~is_low_signal("quote", "category"))
    found = localize_quotes(items, words, config).where(F.col("score") >= config.min_entity_confidence)
    return found.where(~is_oversized("quote", config.max_span_tokens, config.max_span_chars))


def entities(docs: DataFrame, config: EngineConfig = DEFAULT, types: list[str] | None = None) -> DataFrame:
    """Reconciled entities of ``docs(doc_id, text)`` with boxes ready for redaction."""
    found = detections(docs.where(holds_any(types=types)), detect(docs, types=types), held=True)
    return resolve_entities(found, config.min_entity_confidence).withColumn("boxes", F.transform("boxes", lambda b: tighten(b, config)))


def sanitize(docs: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """``docs`` with masked_text, in which no detected character is left."""
    return mask_text(docs, detect(docs), mask=config.mask)


def entity_counts(docs: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Entities and their documents by type and risk tier."""
    found = entities(docs, types=types).withColumn("risk_tier", risk_tier("entity_type"))
    return found.groupBy("entity_type", "risk_tier").agg(F.count("*").alias("entities"), F.count_distinct("doc_id").alias("documents"), F.sum(F.size("boxes")).cast("long").alias("boxes"))
