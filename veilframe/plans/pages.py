"""Whole documents of several pages: from positioned words to entities and the boxes to redact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.boxes import box_key, clip, tighten
from ..operators import canonical, localize
from ..operators.detect import detect
from ..operators.resolve import pages_per_entity, resolve_entities

#: Places of detections on a page lie below this, so that pages come in order.
PAGE_PLACES = 1 << 40


def extraction(words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All words of the documents, the boxes of every distinct word, and the lines with their hulls."""
    return words, localize.word_map(words), localize.phrase_map(words)


def page_texts(words: DataFrame) -> DataFrame:
    """doc_id, page_number, text and offset, the page's start in the whole document, from words (doc_id, page_number, word_index, text, line_key, bbox)."""
    texts = canonical.canonical_text(_placed(words), "page").select("page.*", "text")
    return canonical.page_offsets(texts, "doc_id", "page_number", "text")


def _placed(words: DataFrame) -> DataFrame:
    return canonical.place_words(words.withColumn("page", F.struct("doc_id", "page_number")), "page.page_number", "page")


def page_detections(words: DataFrame, source: str = "Presidio") -> DataFrame:
    """Detections in every page's text with the boxes of their words. No page without words has any."""
    placed = _placed(words)
    spans = detect(canonical.canonical_text(placed, "page"), "page")
    spans = spans.withColumn("seq", F.col("page.page_number") * F.lit(PAGE_PLACES) + F.col("start") * 64 + F.pmod(F.hash("entity_type", "end"), F.lit(64)))
    spans = spans.withColumn("doc_id", F.col("page"))
    placed = placed.drop("doc_id", "page_number").withColumnRenamed("page", "doc_id")
    boxes = localize.span_boxes(spans, placed, ["doc_id", "seq", "entity_type", "score", "match"])
    return boxes.select(
        F.col("doc_id.doc_id").alias("doc_id"), "seq", F.col("match").alias("entity_text"), "entity_type", F.col("score").alias("confidence_score"), F.lit(source).alias("source"),
        "boxes", F.array(F.lit(source)).alias("supporting_sources"), F.lit(None).cast("string").alias("decision_reason"),
    )


def document_entities(words: DataFrame, others: list[DataFrame] | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Entities of whole documents with their pages; ``others`` are more detections, such as faces or a language model's.

    Boxes hold their page, so claims on one box are settled in one pass for all pages.
    """
    found = page_detections(words)
    for more in others or []:
        found = found.unionByName(more.select(*found.columns))
    out = resolve_entities(found, config.min_entity_confidence).withColumn("boxes", F.transform("boxes", lambda b: tighten(b, config)))
    return pages_per_entity(out)


def ordered(entities: DataFrame) -> DataFrame:
    """Entities as they are shown: by document, type and text, case aside."""
    return entities.orderBy("doc_id", "entity_type", F.lower("entity_text"), "source")


def redaction_boxes(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_number, x0, y0, x1, y1 of every distinct box, clipped to its page (doc_id, page_number, width, height); empty ones go."""
    rows = entities.select("doc_id", F.explode("boxes").alias("b")).groupBy("doc_id", box_key("b").alias("_k")).agg(F.first("b").alias("b"))
    rows = rows.select("doc_id", F.col("b.page_number").alias("page_number"), "b").join(pages, ["doc_id", "page_number"])
    rows = rows.select("doc_id", clip("b", F.col("width"), F.col("height")).alias("b")).where("b is not null")
    return rows.select("doc_id", "b.*")
