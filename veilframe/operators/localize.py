"""From text spans to words and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.boxes import box_key

#: Characters of a bucket of the interval join: a few words, so that a long text spreads over many tasks.
BUCKET = 256


def overlap_join(spans: DataFrame, words: DataFrame, key: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """Every span with every word that it overlaps (half-open, equal key).

    Both sides are cut into buckets of offsets, so that key and bucket make an equi-join
    and no key's spans meet all of its words. A pair is kept in the first bucket that both
    are in. ``words`` has start_char and end_char; empty spans meet nothing.
    """
    buckets = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor((F.col(b) - 1) / bucket)))
    left = spans.where("end > start").withColumn("_b", buckets("start", "end"))
    right = words.where("end_char > start_char").withColumn("_b", buckets("start_char", "end_char"))
    both = left.join(right, [key, "_b"]).where((F.col("start_char") < F.col("end")) & (F.col("end_char") > F.col("start")))
    return both.where(F.col("_b") == F.floor(F.greatest("start", "start_char") / bucket)).drop("_b")


def span_boxes(spans: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and boxes: the distinct boxes of the words under each span, by page, top and left."""
    hits = overlap_join(spans, words)
    hits = hits.groupBy(*keys, box_key("bbox").alias("_k")).agg(F.min(F.struct(F.col("bbox.page_number"), F.col("bbox.y0"), F.col("bbox.x0"), F.col("bbox.x1"), F.col("bbox.y1"))).alias("b"))
    ordered = F.array_sort(F.collect_list("b"))
    return hits.groupBy(*keys).agg(F.transform(ordered, lambda b: F.struct(b["page_number"].alias("page_number"), b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"))).alias("boxes"))


def line_boxes(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hull of the words of each line."""
    b = F.col("bbox")
    return words.groupBy(key, b["page_number"].alias("page_number"), "line_key").agg(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"))


def word_map(words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text and the boxes of its occurrences in order."""
    boxes = F.array_sort(F.collect_list(F.struct("word_index", "bbox")))
    return words.groupBy(key, text).agg(F.transform(boxes, lambda b: b["bbox"]).alias("boxes"))


def phrase_map(words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_key, phrase: the line's words from left to right, and their hull."""
    b = F.col("bbox")
    parts = F.array_sort(F.collect_list(F.struct(b["x0"].alias("x0"), F.col("word_index"), F.col(text).alias("w"))))
    return words.groupBy(key, b["page_number"].alias("page_number"), "line_key").agg(
        F.array_join(F.transform(parts, lambda p: p["w"]), " ").alias("phrase"),
        F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"),
    )


def safe_insets(lines: DataFrame, margin: float = 0.6, key: str = "doc_id") -> DataFrame:
    """``lines`` (key, page_number, x0, y0, x1, y1) with safe_inset: half the gap to the nearest line above or below, less a margin.

    The nearest line above ends at or before the top, the nearest below starts at or after
    the bottom. Both come from running extremes over the page's edges in one sort, not
    from comparing all lines; null without neighbours.
    """
    page = [key, "page_number"]

    def nearest(rows: DataFrame, edge: str, own: str, order, best, name: str) -> DataFrame:
        """``rows`` with the extreme ``edge`` up to each one's ``own`` edge."""
        marks = rows.select(*page, F.col(edge).alias("_y"), F.lit(0).alias("_kind"), F.col(edge).alias("_edge"), F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType).alias("_line"))
        asked = rows.select(*page, F.col(own).alias("_y"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_edge"), F.struct(*rows.columns).alias("_line"))
        upto = Window.partitionBy(*page).orderBy(order("_y"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
        return marks.union(asked).withColumn(name, best("_edge").over(upto)).where("_kind = 1").select("_line.*", name)

    out = nearest(nearest(lines, "y1", "y0", F.asc, F.max, "_above"), "y0", "y1", F.desc, F.min, "_below")
    gap = F.least(F.col("y0") - F.col("_above"), F.col("_below") - F.col("y1"))
    return out.withColumn("safe_inset", F.when(gap.isNotNull(), F.greatest(F.lit(0.0), gap / 2 - margin))).drop("_above", "_below")


def nearest_anchor(cells: DataFrame, anchors: DataFrame, group: str, x: str = "x0", drift: float = 14.0) -> DataFrame:
    """``cells`` with col_index and delta of the nearest anchor (group, col_index, anchor); the first of equal ones; too far ones are dropped."""
    found = anchors.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("col_index", "anchor"))).alias("_a"))
    near = F.array_min(F.transform("_a", lambda a: F.struct(F.abs(F.col(x) - a["anchor"]).alias("delta"), a["col_index"].alias("col_index"))))
    rows = cells.join(found, group).withColumn("_n", near)
    return rows.withColumn("col_index", F.col("_n.col_index")).withColumn("delta", F.col("_n.delta")).where(F.col("delta") <= drift * 1.75).drop("_a", "_n")
