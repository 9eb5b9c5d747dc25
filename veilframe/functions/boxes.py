"""Bounding boxes as struct columns (page_number, x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from .text import col


def box(page, x0, y0, x1, y1) -> Column:
    names = ("page_number", "x0", "y0", "x1", "y1")
    kinds = ("int", "double", "double", "double", "double")
    return F.struct(*(col(c).cast(t).alias(n) for c, t, n in zip((page, x0, y0, x1, y1), kinds, names)))


def box_key(b) -> Column:
    """Identity of a box: its page and its edges to two decimals."""
    b = col(b)
    return F.struct(b["page_number"].alias("page_number"), *(F.round(b[e], 2).alias(e) for e in ("x0", "y0", "x1", "y1")))


def distinct_boxes(boxes) -> Column:
    """Boxes of an array without later ones of the same key."""
    return F.aggregate(
        col(boxes),
        F.filter(col(boxes), lambda b: F.lit(False)),
        lambda acc, b: F.when(F.exists(acc, lambda a: box_key(a) == box_key(b)), acc).otherwise(F.concat(acc, F.array(b))),
    )


def merge(boxes) -> Column:
    """Hull of an array of boxes; the page of the first."""
    edge = lambda name: F.transform(col(boxes), lambda b: b[name])
    return box(F.get(col(boxes), 0)["page_number"], F.array_min(edge("x0")), F.array_min(edge("y0")), F.array_max(edge("x1")), F.array_max(edge("y1")))


def clip(b, page_width, page_height) -> Column:
    """Part of a box on the page; null if none."""
    b = col(b)
    x0, y0 = F.greatest(b["x0"], F.lit(0.0)), F.greatest(b["y0"], F.lit(0.0))
    x1, y1 = F.least(b["x1"], col(page_width).cast("double")), F.least(b["y1"], col(page_height).cast("double"))
    return F.when((x1 > x0) & (y1 > y0), box(b["page_number"], x0, y0, x1, y1))


def pad(b, x: float = DEFAULT.padding_x, y: float = DEFAULT.padding_y) -> Column:
    b = col(b)
    return box(b["page_number"], b["x0"] - x, b["y0"] - y, b["x1"] + x, b["y1"] + y)


def tighten(b, config: EngineConfig = DEFAULT, safe_inset: Column | None = None) -> Column:
    """A box shrunk by the configured insets, keeping 32 % of its width and 40 % of its height, then padded."""
    b = col(b)
    width, height = b["x1"] - b["x0"], b["y1"] - b["y0"]
    if not config.tighten:
        return pad(b, config.padding_x, config.padding_y)
    inset_x = F.least(F.lit(config.inset_x_max), width * config.inset_x_ratio)
    inset_y = F.least(F.lit(config.inset_y_max), height * config.inset_y_ratio)
    if safe_inset is not None:
        inset_y = F.least(inset_y, safe_inset)
    most_x = F.greatest(F.lit(0.0), (width - F.greatest(F.lit(0.8), width * 0.32)) / 2)
    most_y = F.greatest(F.lit(0.0), (height - F.greatest(F.lit(0.8), height * 0.40)) / 2)
    inset_x, inset_y = F.least(F.greatest(inset_x, F.lit(0.0)), most_x), F.least(F.greatest(inset_y, F.lit(0.0)), most_y)
    inner = box(b["page_number"], b["x0"] + inset_x, b["y0"] + inset_y, b["x1"] - inset_x, b["y1"] - inset_y)
    flat = (width <= 0) | (height <= 0)
    return F.when(flat, b).otherwise(pad(F.when((inner["x1"] > inner["x0"]) & (inner["y1"] > inner["y0"]), inner).otherwise(b), config.padding_x, config.padding_y))


def box_iou(a, b) -> Column:
    a, b = col(a), col(b)
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda c: (c["x1"] - c["x0"]) * (c["y1"] - c["y0"])
    union = area(a) + area(b) - w * h
    return F.when((a["page_number"] == b["page_number"]) & (union > 0), w * h / union).otherwise(0.0)
