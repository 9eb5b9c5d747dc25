"""Results as files and API rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import box, distinct_boxes


def api_entities(detections: DataFrame) -> DataFrame:
    """Entities as a service shows them: score within 0 and 1, distinct boxes, pages from 1."""
    boxes = F.transform(distinct_boxes("boxes"), lambda b: box(b["page_number"] + 1, b["x0"], b["y0"], b["x1"], b["y1"]))
    return detections.withColumn("confidence_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence_score")))).withColumn("boxes", boxes)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, nulls kept."""
    df.write.option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """The named columns only, with a header."""
    df.select(*fields).write.option("header", "true").csv(path)


def _shown(c):
    return F.coalesce(F.format_number(F.col(c).cast("double"), 4), F.lit("-"))


def html_report(metrics: DataFrame, title: str = "Report") -> DataFrame:
    """One row with an HTML table of (metric, value) rows; a null shows as a dash."""
    row = F.concat(F.lit("<tr><td>"), "metric", F.lit("</td><td>"), _shown("value"), F.lit("</td></tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("metric", row.alias("row")))), lambda r: r["row"]), "")
    return metrics.agg(F.concat(F.lit(f"<html><head><title>{title}</title></head><body><table>"), body, F.lit("</table></body></html>")).alias("html"))


def _escaped(c):
    """A text as HTML shows it."""
    out = F.coalesce(c, F.lit(""))
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def report(sections: list[tuple[str, DataFrame]], artifacts: DataFrame | None = None, title: str = "Report") -> DataFrame:
    """One row with an HTML page: a table for each (heading, metrics) in order, a null value as a dash, then a list of ``artifacts`` (path).

    ``sections`` are summaries, so that a page holds them; a section without rows has an empty table.
    """
    parts = []
    for heading, metrics in sections:
        row = F.concat(F.lit("<tr><td>"), _escaped(F.col("metric")), F.lit("</td><td>"), _shown("value"), F.lit("</td></tr>"))
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("metric", row.alias("row")))), lambda r: r["row"]), "")
        parts.append(metrics.agg(F.concat(F.lit("<h2>"), _escaped(F.lit(heading)), F.lit("</h2><table>"), body, F.lit("</table>")).alias("part")))
    if artifacts is not None:
        items = F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("<li>"), _escaped(F.col("path")), F.lit("</li>")))), "")
        parts.append(artifacts.agg(F.concat(F.lit("<h2>Files</h2><ul>"), items, F.lit("</ul>")).alias("part")))
    rows = None
    for k, part in enumerate(parts):
        part = part.select(F.lit(k).alias("k"), "part")
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("a report needs a section")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda r: r["part"]), "")
    return rows.agg(F.concat(F.lit("<html><head><title>"), _escaped(F.lit(title)), F.lit("</title></head><body>"), body, F.lit("</body></html>")).alias("html"))
