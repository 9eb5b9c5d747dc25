"""Words with offsets, from text, OCR output and parsers' word lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT
from ..functions.boxes import box
from ..functions.text import alnum_count, is_meaningful

LINE_WORDS = 16


def word_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """White-space separated words: key, word_index, start, end, word, line_key and a box in character units.

    ``line_key`` numbers lines of 16 words. Offsets are half-open, in code points. Only
    words and gap lengths are shuffled.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"\s*\S+"), F.lit(0))
    rows = docs.select(key, F.posexplode(pieces).alias("word_index", "piece"))
    rows = rows.select(key, "word_index", F.length("piece").alias("_n"), F.ltrim("piece", F.lit(" \t\n\x0b\f\r")).alias("word"))
    upto = Window.partitionBy(key).orderBy("word_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("_n").over(upto))
    start = F.col("end") - F.length("word")
    return rows.select(
        key, "word_index", start.alias("start"), "end", "word",
        F.concat(F.lit("text:"), F.floor(F.col("word_index") / LINE_WORDS).cast("string")).alias("line_key"),
        box(F.lit(0), start, F.lit(0), F.col("end"), F.lit(1)).alias("bbox"),
    )


def native_words(rows: DataFrame) -> DataFrame:
    """Words of a parser: trimmed, blanks dropped, ordered by block, line and word; line_key by block and line."""
    rows = rows.withColumn("text", F.trim("text")).where("text != ''")
    order = Window.partitionBy("doc_id", "page_number").orderBy("block_no", "line_no", "word_no")
    return rows.withColumn("word_index", F.row_number().over(order) - 1).withColumn("line_key", F.format_string("native:%d:%d", F.col("block_no").cast("int"), F.col("line_no").cast("int")))


def ocr_words(results: DataFrame, least_confidence: float = 0.0) -> DataFrame:
    """Words of OCR results with parallel arrays text, conf, left, top, width, height, block, par, line.

    ``scale_x, scale_y, shift_x, shift_y`` turn image pixels into page points by
    ``(pixel - shift) / scale``. Blank and unsure words are dropped.
    """
    names = ["text", "conf", "left", "top", "width", "height", "block", "par", "line"]
    others = [c for c in results.columns if c not in names]
    rows = results.select(*others, F.posexplode(F.arrays_zip(*names)).alias("word_index", "w")).select(*others, "word_index", "w.*")
    rows = rows.withColumn("text", F.trim("text")).withColumn("conf", F.col("conf").try_cast("double")).where((F.col("text") != "") & (F.col("conf") >= least_confidence))
    x = lambda c: (c - F.col("shift_x")) / F.col("scale_x")
    y = lambda c: (c - F.col("shift_y")) / F.col("scale_y")
    b = box(F.col("page_number"), x(F.col("left")), y(F.col("top")), x(F.col("left") + F.col("width")), y(F.col("top") + F.col("height")))
    return rows.select(*others, "word_index", "text", "conf", b.alias("bbox"), F.concat_ws(":", F.lit("ocr"), "block", "par", "line").alias("line_key"))


def pass_metrics(words: DataFrame, keys: list[str]) -> DataFrame:
    """Per OCR pass: words, mean confidence, letters and digits, quality, and whether it is strong."""
    m = words.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("conf").alias("mean_conf"), F.sum(alnum_count("text")).alias("alnum"))
    strong = ((F.col("n") >= 16) & (F.col("mean_conf") >= 46)) | ((F.col("n") >= 8) & (F.col("mean_conf") >= 34) & (F.col("alnum") >= 40))
    return m.withColumn("quality", 2 * F.col("n") + 0.45 * F.col("mean_conf") + 0.03 * F.col("alnum")).withColumn("strong", strong)


def best_pass(metrics: DataFrame, keys: list[str], order: str = "pass_no") -> DataFrame:
    """The first strong pass of each group, else the first of the best quality."""
    first = F.min(F.when(F.col("strong"), F.col(order)))
    best = F.min_by(order, F.struct(-F.col("quality"), F.col(order)))
    return metrics.groupBy(*keys).agg(F.coalesce(first, best).alias(order))


def word_quality(words: Column) -> Column:
    """Quality of an array of words: letters and digits, longer words, distinct words."""
    alnum = F.aggregate(words, F.lit(0), lambda a, w: a + alnum_count(w))
    return 0.9 * alnum + 2 * F.size(F.filter(words, lambda w: F.length(w) >= 3)) + 0.6 * F.size(F.array_distinct(F.transform(words, F.lower)))


def choose_words(native: DataFrame, ocr: DataFrame, keys: list[str], factor: float = DEFAULT.native_over_ocr) -> DataFrame:
    """Per page, ``native`` or ``ocr``: native words if meaningful or clearly better, or if OCR found none."""
    gather = lambda df, name: df.groupBy(*keys).agg(F.collect_list("text").alias(name))
    both = gather(native, "_n").join(gather(ocr, "_o"), keys, "full_outer")
    n, o = F.coalesce("_n", F.array().cast("array<string>")), F.coalesce("_o", F.array().cast("array<string>"))
    use_native = is_meaningful(F.array_join(n, " ")) | (F.size(o) == 0) | (word_quality(n) > factor * word_quality(o))
    return both.select(*keys, F.when(use_native, "native").otherwise("ocr").alias("origin"))
