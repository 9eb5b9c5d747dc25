"""Tables among positioned words: row clustering, cells, columns, regions, and their text."""

from __future__ import annotations

from dataclasses import dataclass, field
from statistics import mean, median
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig


@dataclass
class Cell:
    words: list = field(default_factory=list)

    @property
    def x0(self) -> float:
        return min(w.x0 for w in self.words)

    @property
    def y0(self) -> float:
        return min(w.y0 for w in self.words)

    @property
    def y1(self) -> float:
        return max(w.y1 for w in self.words)

    @property
    def text(self) -> str:
        return " ".join(w.text for w in self.words)


def _heights(words) -> float:
    return median(max(0.1, w.y1 - w.y0) for w in words)


def rows_of(words: list, config: EngineConfig = DEFAULT) -> list[list[Cell]]:
    """Rows of cells: words whose middles lie near the running mean of a row, cut at wide gaps."""
    tolerance = max(config.table_row_tolerance, 0.55 * _heights(words))
    rows: list[tuple[float, list]] = []
    for w in sorted(words, key=lambda w: ((w.y0 + w.y1) / 2, w.x0)):
        middle = (w.y0 + w.y1) / 2
        if rows and abs(middle - rows[-1][0]) <= tolerance:
            centre, members = rows[-1]
            members.append(w)
            rows[-1] = (centre + (middle - centre) / len(members), members)
        else:
            rows.append((middle, [w]))
    out = []
    for _, members in rows:
        members.sort(key=lambda w: w.x0)
        gap = max(config.table_column_gap, 0.9 * _heights(members))
        cells = [Cell([members[0]])]
        for left, right in zip(members, members[1:]):
            if right.x0 - left.x1 >= gap:
                cells.append(Cell())
            cells[-1].words.append(right)
        out.append(cells)
    return out


def group_rows(rows: list[list[Cell]], config: EngineConfig = DEFAULT) -> list[list[list[Cell]]]:
    """Runs of near rows that start with enough cells; rows of one cell may continue a run."""
    top, bottom = (lambda r: min(c.y0 for c in r)), (lambda r: max(c.y1 for c in r))
    limit = max(2.5 * config.table_row_tolerance, config.table_continuation_gap * median(max(0.1, bottom(r) - top(r)) for r in rows))
    groups: list = [[]]
    for row in sorted(rows, key=top):
        wide = len(row) >= config.table_min_cols
        if groups[-1] and (not (wide or len(row) == 1) or max(0.0, top(row) - bottom(groups[-1][-1])) > limit):
            groups.append([])
        if groups[-1] or wide:
            groups[-1].append(row)
    return [g for g in groups if sum(len(r) >= config.table_min_cols for r in g) >= config.table_min_rows]


def column_anchors(positions: list[float], drift: float) -> list[float]:
    """Means of positions, each within ``drift`` of the running mean of its cluster."""
    clusters: list[list[float]] = []
    for x in sorted(positions):
        if clusters and abs(x - mean(clusters[-1])) <= drift:
            clusters[-1].append(x)
        else:
            clusters.append([x])
    return [mean(c) for c in clusters]


def region(rows: list[list[Cell]], config: EngineConfig = DEFAULT) -> dict | None:
    """Columns, confidence and ``grid`` (a row's cells by column) of a run of rows; None if it is no table."""
    anchors = column_anchors([c.x0 for r in rows if len(r) >= config.table_min_cols for c in r], config.table_column_drift)
    if len(anchors) < config.table_min_cols:
        return None
    grid: list[dict[int, Cell]] = []
    errors = []
    for row in rows:
        found: dict[int, Cell] = {}
        for cell in row:
            delta, k = min((abs(cell.x0 - a), k) for k, a in enumerate(anchors))
            if delta <= 1.75 * config.table_column_drift:
                found.setdefault(k, Cell()).words.extend(cell.words)
                errors.append(delta)
        only = next(iter(found)) if len(found) == 1 else 0
        if grid and only > 0 and only in grid[-1]:
            grid[-1][only].words.extend(found[only].words)
        elif found:
            grid.append(found)
    wide = sum(len(r) >= config.table_min_cols for r in grid)
    if wide < config.table_min_rows:
        return None
    align = max(0.0, 1 - mean(errors) / max(config.table_column_drift, 1.0))
    density = mean(len(r) / len(anchors) for r in grid)
    sure = 0.40 * align + 0.25 * density + 0.20 * min(1.0, wide / config.table_min_rows) + 0.15 * min(1.0, len(anchors) / config.table_min_cols)
    return {"columns": len(anchors), "confidence": round(min(1.0, max(0.0, sure)), 4), "grid": grid}


def page_tables(words: list, config: EngineConfig = DEFAULT) -> list[dict]:
    """Tables of a page's words (word_index, text, x0, y0, x1, y1), from top to bottom."""
    words = [w for w in words if w.text.strip()]
    if len(words) < max(4, config.table_min_rows * config.table_min_cols):
        return []
    rows = rows_of(words, config)
    found = [region(g, config) for g in (group_rows(rows, config) if len(rows) >= config.table_min_rows else [])]
    return sorted((r for r in found if r and r["confidence"] >= config.table_min_confidence), key=lambda r: min((c.y0, c.x0) for row in r["grid"] for c in row.values()))


_CELLS = "doc_id long, page_number int, table_no int, confidence double, row_count int, col_count int, row_index int, col_index int, text string, word_indexes array<int>, x0 double, y0 double, x1 double, y1 double"


def detect_tables(words: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Cells of tables in ``words`` (doc_id, page_number, word_index, text, x0, y0, x1, y1), page by page.

    A page's words, which a page bounds, are gathered into one row; batches of pages then
    pass one Python call, since a call for each page would cost more than its tables.
    """
    fields = ["word_index", "text", "x0", "y0", "x1", "y1"]
    pages = words.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("words"))
    names = [c.split()[0] for c in _CELLS.split(", ")]

    def run(frames):
        for frame in frames:
            out = []
            for page in frame.itertuples(index=False):
                for t, r in enumerate(page_tables([SimpleNamespace(**w) for w in page.words], config)):
                    for i, row in enumerate(r["grid"]):
                        for j, c in sorted(row.items()):
                            w = c.words
                            out.append((page.doc_id, page.page_number, t, r["confidence"], len(r["grid"]), r["columns"], i, j, c.text, sorted({x.word_index for x in w}), c.x0, c.y0, max(x.x1 for x in w), c.y1))
            yield pd.DataFrame(out, columns=names)

    return pages.mapInPandas(run, _CELLS)


def table_texts(cells: DataFrame) -> DataFrame:
    """doc_id, page_number, table_no and the table as text: cells joined by `` | ``, rows by line feeds, between markers."""
    keys = ["doc_id", "page_number", "table_no"]
    row = cells.groupBy(*keys, "row_count", "col_count", "row_index").agg(F.map_from_entries(F.collect_list(F.struct("col_index", "text"))).alias("_c"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.col("col_count") - 1), lambda k: F.coalesce(F.try_element_at("_c", k), F.lit(""))), " | ")
    rows = F.array_sort(F.collect_list(F.struct("row_index", "line")))
    body = row.withColumn("line", line).groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("body"))
    return body.select(*keys, F.concat(F.lit("[TABLE]\n"), "body", F.lit("\n[/TABLE]")).alias("text"))


def merge_boxes(boxes: list[tuple], least: float = DEFAULT.box_merge_iou) -> list[tuple]:
    """Boxes (page, x0, y0, x1, y1), largest first, each grown by those of its page that overlap it enough.

    Overlap is that with the grown box, over the areas of the first and the other box.
    """
    area = lambda b: (b[3] - b[1]) * (b[4] - b[2])
    left, out = sorted(boxes, key=area, reverse=True), []
    while left:
        first = grown = left.pop(0)
        rest = []
        for b in left:
            w, h = min(grown[3], b[3]) - max(grown[1], b[1]), min(grown[4], b[4]) - max(grown[2], b[2])
            union = area(first) + area(b) - w * h
            if b[0] == grown[0] and w > 0 and h > 0 and union > 0 and w * h / union >= least:
                grown = (grown[0], min(grown[1], b[1]), min(grown[2], b[2]), max(grown[3], b[3]), max(grown[4], b[4]))
            else:
                rest.append(b)
        out.append(grown)
        left = rest
    return out


def merge_box_rows(rows: DataFrame, least: float = DEFAULT.box_merge_iou) -> DataFrame:
    """``rows`` (doc_id, page_number, x0, y0, x1, y1) with overlapping boxes of a page merged."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        got = merge_boxes(list(page[["page_number", "x0", "y0", "x1", "y1"]].itertuples(index=False, name=None)), least)
        return pd.DataFrame([(page["doc_id"].iloc[0], *b) for b in got], columns=["doc_id", "page_number", "x0", "y0", "x1", "y1"])

    return rows.groupBy("doc_id", "page_number").applyInPandas(run, "doc_id long, page_number int, x0 double, y0 double, x1 double, y1 double")
