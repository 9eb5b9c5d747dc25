"""Numbers, scores and times as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT
from .text import col, token_count

_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def confidence(c, default: float = 0.85) -> Column:
    """A confidence written as number, percentage or text with a number; above 1 it counts as percent."""
    raw = F.trim(F.coalesce(col(c).cast("string"), F.lit("")))
    percent = F.regexp_extract(raw, rf"({_NUMBER})\s*%", 1)
    number = F.regexp_extract(raw, _NUMBER, 0)
    value = F.when(percent != "", percent.try_cast("double") / 100).when(number != "", number.try_cast("double")).otherwise(F.lit(default))
    return clamp(F.when(value > 1, value / 100).otherwise(value))


def combined_confidence(stated: Column, similarity: Column) -> Column:
    return (stated + similarity / 100) / 2


def adaptive_threshold(normalized, base: Column | int = DEFAULT.fuzzy_threshold) -> Column:
    """Relaxed similarity threshold for a normalized quote: longer quotes may differ more."""
    base = F.lit(base) if isinstance(base, int) else base
    tokens, chars = F.greatest(token_count(normalized), F.lit(1)), F.length(col(normalized))
    return (
        F.when((tokens >= 6) | (chars >= 45), F.greatest(F.lit(80), base - 10))
        .when((tokens >= 4) | (chars >= 28), F.greatest(F.lit(84), base - 8))
        .otherwise(F.greatest(F.lit(88), base - 4))
    )


def span_iou(a0, a1, b0, b1) -> Column:
    """Overlap of two half-open spans over their hull; 0 if they do not meet."""
    a0, a1, b0, b1 = map(col, (a0, a1, b0, b1))
    overlap = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    return F.when(overlap > 0, overlap / (F.greatest(a1, b1) - F.least(a0, b0))).otherwise(F.lit(0.0))


def safe_divide(a, b) -> Column:
    """0 where the denominator is not positive."""
    a, b = col(a), col(b)
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def safe_float(c, default: float = 0.0) -> Column:
    return F.coalesce(col(c).try_cast("double"), F.lit(default))


def ocr_scale(width, height, base: float = 2.0) -> Column:
    """Zoom for OCR: large pages are enlarged less, small ones more; from 1.2 to 2.4."""
    area = col(width) * col(height)
    return clamp(F.when(area > 900_000, base * 0.9).when(area < 300_000, base * 1.12).otherwise(base), 1.2, 2.4)


def iso_utc(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def parse_iso(c) -> Column:
    """Null where the text is no time."""
    return F.try_to_timestamp(F.nullif(F.trim(col(c)), F.lit("")))


def elapsed(start, end) -> Column:
    """Seconds, at least 0; null if either is."""
    s = F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))
    return F.when(s.isNotNull(), F.greatest(s, F.lit(0)) / F.lit(1e6))
