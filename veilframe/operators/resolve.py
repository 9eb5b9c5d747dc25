"""Reconciling detections that claim the same boxes, and merging them into entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.boxes import box_key, distinct_boxes
from ..functions.labels import LLM_CONTEXT, SOURCE_BONUS, SOURCES, STRUCTURED
from ..functions.text import collapse

REASONS = ["type_matrix_conflict_resolved", "type_matrix_llm_context_priority", "type_matrix_structured_priority"]


def supporting_sources(source, supporting, compat: bool = False) -> Column:
    """Known sources of a detection in their fixed order. ``compat``: Hybrid stands for all of them."""
    own = F.when(F.col(source) == "Hybrid", F.array(*map(F.lit, SOURCES)) if compat else F.array().cast("array<string>")).otherwise(F.array(source))
    named = F.concat(F.coalesce(F.col(supporting), F.array().cast("array<string>")), own)
    return F.filter(F.array(*map(F.lit, SOURCES)), lambda s: F.array_contains(named, s))


def source_rank(source: Column) -> Column:
    """Place in the fixed order; unknown sources last."""
    at = F.array_position(F.array(*map(F.lit, SOURCES)), source)
    return F.when(at > 0, at - 1).otherwise(len(SOURCES))


def type_score(entity_type: str = "entity_type", score: str = "confidence_score", source: str = "source", sources: str = "sources") -> Column:
    """Confidence with bonuses: 0.25 structured types, 0.15 context types from the language model, 0.08 some types from some source."""
    kind = F.upper(F.trim(F.coalesce(entity_type, F.lit(""))))
    out = F.col(score) + F.when(kind.isin(STRUCTURED), 0.25).otherwise(0.0) + F.when(kind.isin(LLM_CONTEXT) & (F.col(source) == "LLM"), 0.15).otherwise(0.0)
    bonus = [F.when((kind == t) & F.array_contains(sources, s), v).otherwise(0.0) for (t, s), v in SOURCE_BONUS.items()]
    return reduce(lambda a, b: a + b, bonus, out)


def resolve_boxes(detections: DataFrame, least: float = DEFAULT.min_entity_confidence, compat: bool = False) -> DataFrame:
    """One row per document and box: entity_text, entity_type, confidence_score, source, sources, decision_reason, box, seq.

    A single type wins by consensus. Else structured types come before context types of
    the language model and these before others; within a class the best score, then
    confidence, source and order decide. The text is the surest, then longest, of the
    winning type. Several sources make a Hybrid. Partial aggregates by type go into the
    box's, so no group of detections is ever gathered.
    """
    rows = detections.where(F.col("confidence_score") >= least).withColumn("sources", supporting_sources("source", "supporting_sources", compat))
    rows = rows.withColumn("score", type_score())
    kind, text = F.trim(F.coalesce("entity_type", F.lit(""))), collapse("entity_text")
    tier = F.when(kind.isin(STRUCTURED), 2).when(kind.isin(LLM_CONTEXT) & (F.col("source") == "LLM"), 1).otherwise(0)
    rank = F.when(tier == 1, 0).otherwise(source_rank(F.coalesce(F.get("sources", 0), F.col("source"))))
    rows = rows.select(
        "doc_id", "seq", kind.alias("kind"), text.alias("t"), "confidence_score", "sources",
        F.struct(tier.alias("tier"), F.col("score"), F.col("confidence_score").alias("conf"), (-rank).alias("rank"), (-F.col("seq")).alias("order")).alias("claim"),
        F.posexplode(distinct_boxes("boxes")).alias("box_no", "box"),
    )
    place = F.struct("seq", "box_no")
    said = F.struct((F.length("t") > 0).alias("said"), F.col("confidence_score").alias("conf"), F.length("t").alias("n"), (-F.col("seq")).alias("order"), "t")
    keys = ["doc_id", box_key("box").alias("k")]
    by_type = rows.groupBy(*keys, "kind").agg(
        F.max("claim").alias("claim"), F.max(said).alias("said"), F.max("confidence_score").alias("conf"),
        F.min(place).alias("place"), F.min_by("box", place).alias("box"), F.array_distinct(F.flatten(F.collect_set("sources"))).alias("sources"),
    )
    typed = F.when(F.col("kind") != "", F.struct("claim", "kind", "said"))
    out = by_type.groupBy("doc_id", "k").agg(
        F.max(typed).alias("win"), F.count(typed).alias("types"), F.max("said").alias("any_said"), F.max("conf").alias("confidence_score"),
        F.min("place").alias("seq"), F.min_by("box", "place").alias("box"), F.flatten(F.collect_list("sources")).alias("sources"),
    )
    out = out.withColumn("sources", F.filter(F.array(*map(F.lit, SOURCES)), lambda s: F.array_contains("sources", s)))
    source = F.when(F.size("sources") > 1, "Hybrid").otherwise(F.coalesce(F.get("sources", 0), F.lit(SOURCES[0])))
    reason = F.when(F.col("types") == 0, "type_matrix_missing_type").when(F.col("types") == 1, "type_consensus").otherwise(F.get(F.array(*map(F.lit, REASONS)), F.col("win.claim.tier")))
    return out.select(
        "doc_id", F.when(F.col("win.said.said"), F.col("win.said.t")).otherwise(F.col("any_said.t")).alias("entity_text"), F.coalesce("win.kind", F.lit("UNKNOWN")).alias("entity_type"),
        "confidence_score", source.alias("source"), "sources", reason.alias("decision_reason"), "box", "seq",
    )


def merge_entities(resolved: DataFrame) -> DataFrame:
    """Entities of a document: boxes with equal text (case aside), type, source and sources become one."""
    rows = resolved.where(F.trim("entity_text") != "").withColumn("_t", F.lower("entity_text"))
    boxes = F.array_sort(F.collect_list(F.struct("seq", "box")))
    out = rows.groupBy("doc_id", "_t", "entity_type", "source", "sources").agg(
        F.min_by("entity_text", "seq").alias("entity_text"), F.max("confidence_score").alias("confidence_score"),
        F.when(F.col("source") == "Hybrid", F.max_by("decision_reason", "seq")).otherwise(F.min_by("decision_reason", "seq")).alias("decision_reason"),
        F.transform(boxes, lambda b: b["box"]).alias("boxes"),
    )
    return out.select("doc_id", "entity_text", "entity_type", "confidence_score", "source", F.col("sources").alias("supporting_sources"), "decision_reason", distinct_boxes("boxes").alias("boxes"))


def resolve_entities(detections: DataFrame, least: float = DEFAULT.min_entity_confidence, compat: bool = False) -> DataFrame:
    return merge_entities(resolve_boxes(detections, least, compat))


def distinct_first(rows: DataFrame, value: str, seq: str) -> DataFrame:
    """Distinct values with the place of their first occurrence."""
    return rows.groupBy(value).agg(F.min(seq).alias("first_seq"))


def pages_per_entity(entities: DataFrame) -> DataFrame:
    """``entities`` with pages, the sorted distinct page numbers from 1."""
    return entities.withColumn("pages", F.array_sort(F.array_distinct(F.transform("boxes", lambda b: b["page_number"] + 1))))
