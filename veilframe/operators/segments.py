"""Segments of texts: merging, masking, and mapping offsets of projected texts back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT


def merge_segments(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, end of the unions of spans that overlap or touch; empty ones are dropped."""
    order = Window.partitionBy(key).orderBy("start", "end")
    rows = spans.where("end > start").select(key, "start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def mask_text(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text", mask: str = DEFAULT.mask) -> DataFrame:
    """``docs`` with masked_text: every merged span is replaced by one ``mask``; its characters are gone."""
    merged = merge_segments(spans, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_s"))
    rows = docs.join(merged, key, "left")
    starts = F.concat(F.array(F.lit(0)), F.transform("_s", lambda s: s["end"].cast("int")))
    stops = F.concat(F.transform("_s", lambda s: s["start"].cast("int")), F.array(F.length(text)))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda p: F.substring(F.col(text), p["a"] + 1, p["b"] - p["a"]))
    return rows.withColumn("masked_text", F.when(F.col("_s").isNull(), F.col(text)).otherwise(F.array_join(pieces, mask))).drop("_s")


def remap(spans: DataFrame, segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans of a projected text in the offsets of the text that its segments were taken from.

    ``segments``: key, start, end; they were joined in order, one character between two.
    A span that reaches beyond the projection is clamped; the character between two
    segments counts as the one before the second.
    """
    order = Window.partitionBy(key).orderBy("start")
    rows = segments.withColumn("_n", F.col("end") - F.col("start"))
    rows = rows.withColumn("_from", F.coalesce(F.sum(F.col("_n") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_from", "_n", "start"))).alias("_segs"))

    def place(at):
        last = F.element_at("_segs", -1)
        at = F.greatest(F.lit(0), F.least(at, last["_from"] + last["_n"] - 1))
        own = F.element_at(F.filter("_segs", lambda s: s["_from"] - 1 <= at), -1)
        return F.greatest(F.lit(0), own["start"] + at - own["_from"])

    out = spans.where("end > start").join(rows, key)
    return out.withColumn("start", place(F.col("start"))).withColumn("end", place(F.col("end") - 1) + 1).where("end > start").drop("_segs")
