"""Canonical text of pages from words, and offsets across pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def place_words(words: DataFrame, page: str = "bbox.page_number", key: str = "doc_id") -> DataFrame:
    """``words`` with sep, start_char and end_char in the canonical text.

    The separator before a word is a line feed on a new page or line, nothing after a
    hyphen at a line's end, else a space.
    """
    order = Window.partitionBy(key).orderBy("word_index")
    prior = lambda c: F.lag(c).over(order)
    sep = (
        F.when(F.row_number().over(order) == 1, "")
        .when(prior(F.col(page)) != F.col(page), "\n")
        .when((prior("line_key") != F.col("line_key")) & prior("text").endswith("-"), "")
        .when(prior("line_key") != F.col("line_key"), "\n")
        .otherwise(" ")
    )
    end = F.sum(F.length("sep") + F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return words.withColumn("sep", sep).withColumn("end_char", end).withColumn("start_char", F.col("end_char") - F.length("text"))


def canonical_text(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and text, from ``place_words``."""
    parts = F.array_sort(F.collect_list(F.struct("word_index", F.concat("sep", "text").alias("part"))))
    return placed.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("text"))


def page_offsets(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """``pages`` with offset, the absolute start of a page: every page before counts its length and one."""
    before = Window.partitionBy(key).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("offset", F.coalesce(F.sum(F.length(F.coalesce(text, F.lit(""))) + 1).over(before), F.lit(0)))


def gate_pages(pages: DataFrame, max_pages: int = 0, min_chars: int = 0, skip_when_found: int = 0) -> DataFrame:
    """Pages (doc_id, page_number, text, n_found) that an expensive detector should see.

    Blank ones never; with limits above 0 only texts long enough, with too few findings so
    far, and the first ``max_pages`` of these in a document.
    """
    rows = pages.where((F.trim("text") != "") & (F.length("text") >= min_chars))
    if skip_when_found:
        rows = rows.where(F.col("n_found") < skip_when_found)
    rows = rows.withColumn("budget_rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number")))
    return rows.where(F.col("budget_rank") <= max_pages) if max_pages else rows


def word_regions(words: DataFrame, cells: DataFrame) -> DataFrame:
    """``words`` with the table cell they are in (table_no, row_index, col_index, row_count, col_count) or nulls; the first table wins."""
    inside = cells.select("doc_id", "page_number", F.explode("word_indexes").alias("word_index"), F.struct("table_no", "row_index", "col_index", "row_count", "col_count").alias("_c"))
    inside = inside.groupBy("doc_id", "page_number", "word_index").agg(F.min("_c").alias("_c"))
    return words.join(inside, ["doc_id", "page_number", "word_index"], "left").select(*words.columns, "_c.*")


def place_words_and_tables(words: DataFrame, cells: DataFrame) -> DataFrame:
    """``words`` (doc_id, page_number, word_index, text, line_key, x0, y0) with lead, tail, start_char and end_char.

    A table stands where its first word would: between markers, cells joined by `` | `` and
    rows by line feeds. What belongs to no word - markers, separators of empty cells and
    rows - is the lead of the word after it or the tail of a table's last word, so the
    text is all leads, words and tails in the order of the offsets.
    """
    rows = word_regions(words, cells)
    rows = rows.withColumn("_at", F.coalesce(F.min(F.when(F.col("table_no").isNotNull(), F.col("word_index"))).over(Window.partitionBy("doc_id", "page_number", "table_no")), F.col("word_index")))
    order = Window.partitionBy("doc_id").orderBy("page_number", "_at", "row_index", "col_index", F.when(F.col("table_no").isNotNull(), F.col("y0")), F.when(F.col("table_no").isNotNull(), F.col("x0")), "word_index")
    prior = lambda c: F.lag(c).over(order)
    first = F.row_number().over(order) == 1
    table, row, column, width = F.col("table_no"), F.col("row_index"), F.col("col_index"), F.col("col_count")
    bars = lambda n: F.repeat(F.lit(" | "), n.cast("int"))
    blank = lambda n: F.repeat(F.concat(bars(width - 1), F.lit("\n")), n.cast("int"))
    rows = rows.withColumns({"_table": prior("table_no"), "_page": prior("page_number"), "_row": prior("row_index"), "_col": prior("col_index"), "_line": prior("line_key"), "_text": prior("text"), "_first": first})
    same = (F.col("_table") == table) & (F.col("_page") == F.col("page_number"))
    in_table = (
        F.when(~F.coalesce(same, F.lit(False)), F.concat(F.when(F.col("_first"), "").otherwise("\n"), F.lit("[TABLE]\n"), blank(row), bars(column)))
        .when((F.col("_row") == row) & (F.col("_col") == column), " ")
        .when(F.col("_row") == row, bars(column - F.col("_col")))
        .otherwise(F.concat(bars(width - 1 - F.col("_col")), F.lit("\n"), blank(row - F.col("_row") - 1), bars(column)))
    )
    plain = (
        F.when(F.col("_first"), "")
        .when(F.col("_page") != F.col("page_number"), "\n")
        .when((F.col("_line") != F.col("line_key")) & F.col("_text").endswith("-"), "")
        .when(F.col("_line") != F.col("line_key"), "\n")
        .otherwise(" ")
    )
    after = F.lead(F.struct("page_number", "table_no")).over(order)
    last = table.isNotNull() & ~F.coalesce((after["table_no"] == table) & (after["page_number"] == F.col("page_number")), F.lit(False))
    tail = F.concat(bars(width - 1 - column), F.repeat(F.concat(F.lit("\n"), bars(width - 1)), (F.col("row_count") - 1 - row).cast("int")), F.lit("\n[/TABLE]"))
    rows = rows.withColumns({"lead": F.when(table.isNotNull(), in_table).otherwise(plain), "tail": F.when(last, tail).otherwise("")})
    done = F.sum(F.length("lead") + F.length("text") + F.length("tail")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end_char", done - F.length("tail")).withColumn("start_char", F.col("end_char") - F.length("text"))
    return rows.select(*words.columns, "lead", "tail", "start_char", "end_char")


def text_with_tables(placed: DataFrame) -> DataFrame:
    """doc_id and text, from ``place_words_and_tables``."""
    parts = F.array_sort(F.collect_list(F.struct("start_char", F.concat("lead", "text", "tail").alias("part"))))
    return placed.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("text"))
