"""Names of embedded fonts, which can tell who made a document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Standard fonts keep their names. Fixed values.
STANDARD = [
    "/Helvetica", "/Times-Roman", "/Courier", "/Symbol", "/ZapfDingbats",
    "/Helvetica-Bold", "/Helvetica-Oblique", "/Helvetica-BoldOblique",
    "/Times-Bold", "/Times-Italic", "/Times-BoldItalic",
    "/Courier-Bold", "/Courier-Oblique", "/Courier-BoldOblique",
]


def scrubbed_font(name, number) -> Column:
    """A neutral name by the object's number; the mark of a subset (before ``+``) stays, and so do standard, empty and null names."""
    x, neutral = col(name), F.concat(F.lit("SanitizedFont"), col(number).cast("string"))
    scrubbed = F.concat(F.when(x.contains("+"), F.concat(F.substring_index(x, "+", 1), F.lit("+"))).otherwise("/"), neutral)
    return F.when(x.isin("", "null", *STANDARD), x).when(x.isNotNull(), scrubbed)
