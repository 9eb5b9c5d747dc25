"""Text functions on columns, and regular expressions with match offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT

#: Key paths, and last segments, whose values are never looked at (fixed values).
IGNORED_KEYS = ["id", "filename", "metadata.item", "input.ke"]
IGNORED_LAST = ["id", "filename"]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def match_spans(df: DataFrame, keys: list[str], pattern: str, text: str = "text", lead: str | None = None) -> DataFrame:
    """Every match with half-open code-point offsets: ``keys``, start, end, match. See ``match_many``."""
    return match_many(df, keys, {"one": (lead, pattern) if lead else pattern}, text).drop("kind")


def match_many(df: DataFrame, keys: list[str], patterns: dict, text: str = "text", possible: dict | None = None) -> DataFrame:
    """Matches of several patterns in one scan: ``keys``, kind (the pattern's name), start, end, match.

    A pattern has no capturing group; a pair (lead, pattern) also takes what must stand
    before the match and is no part of it. A text is cut up only by the patterns that it
    holds at all: at their matches, by lengths of what is between them. Only these lengths
    and the matches, never the text, pass the window, which is per key and kind.
    ``possible``: by name, a cheap condition without which a text holds no match.
    """

    def pieces(name: str, pattern) -> Column:
        lead, value = pattern if isinstance(pattern, tuple) else (None, pattern)
        whole = f"({lead})({value})" if lead else value
        gaps = F.transform(F.split(col(text), whole, -1), F.length)
        found = F.regexp_extract_all(col(text), F.lit(whole), F.lit(0))
        leads = F.transform(F.regexp_extract_all(col(text), F.lit(whole), F.lit(1)), F.length) if lead else F.transform(found, lambda x: F.lit(0))
        held = col(text).rlike(whole) if not possible or name not in possible else possible[name] & col(text).rlike(whole)
        return F.when(held, F.arrays_zip(gaps.alias("gap"), found.alias("whole"), leads.alias("lead")))

    found = F.array(*(F.struct(F.lit(n).alias("kind"), pieces(n, p).alias("pieces")) for n, p in patterns.items()))
    rows = df.select(*keys, F.explode(found).alias("_f")).where("_f.pieces is not null").select(*keys, "_f.kind", F.posexplode("_f.pieces").alias("_pos", "_p"))
    rows = rows.where("_p.whole is not null").select(*keys, "kind", "_pos", "_p.gap", "_p.whole", "_p.lead")
    order = Window.partitionBy(*keys, "kind").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("whole")).over(order))
    match = F.substring(F.col("whole"), F.col("lead") + 1, F.length("whole"))
    return rows.select(*keys, "kind", (F.col("end") - F.length("whole") + F.col("lead")).alias("start"), "end", match.alias("match")).where("length(match) > 0")


def alnum_count(c) -> Column:
    return F.length(F.regexp_replace(col(c), r"[^\p{L}\p{N}]", ""))


def is_meaningful(c, least: int = DEFAULT.native_text_min_alnum) -> Column:
    """Whether a text has enough letters and digits to do without OCR."""
    return F.coalesce(alnum_count(c), F.lit(0)) >= least


def strip(c) -> Column:
    """Without white space at either end; empty for null."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"^\s+|\s+$", "")


def collapse(c) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " "))


def text_key(c) -> Column:
    """Key under which texts count as equal: white space collapsed, lower case."""
    return F.lower(collapse(c))


def normalize_for_fuzzy(c) -> Column:
    """Upper case; O, Q and I, L after a digit and before a digit or the end become 0 and 1; other signs but $ one space."""
    x = F.upper(F.coalesce(col(c), F.lit("")))
    x = F.regexp_replace(x, r"(?<=[0-9])[OQ](?=[0-9]|$)", "0")
    x = F.regexp_replace(x, r"(?<=[0-9])[IL](?=[0-9]|$)", "1")
    return F.trim(F.regexp_replace(x, r"[^A-Z0-9$]+", " "))


def token_count(c) -> Column:
    """White-space separated tokens; none in a blank text."""
    x = collapse(c)
    return F.when(x == "", 0).otherwise(F.size(F.split(x, " ")))


def chunk(df: DataFrame, size: int = DEFAULT.chunk_size, overlap: int = DEFAULT.chunk_overlap, text: str = "text") -> DataFrame:
    """``df`` with one row per overlapping chunk: chunk_no, global_offset, chunk_text.

    The step is ``size - overlap``, at least 1; the last chunk ends with the text. Empty
    and null texts have no chunk.
    """
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("need size > overlap >= 0")
    step = max(1, size - overlap)
    length = F.length(col(text))
    starts = F.sequence(F.lit(0), F.greatest(length - overlap - 1, F.lit(0)), F.lit(step))
    rows = df.where(length > 0).select("*", F.posexplode(starts).alias("chunk_no", "global_offset"))
    return rows.withColumn("chunk_text", F.substring(col(text), F.col("global_offset") + 1, F.lit(size)))


def strip_think(c) -> Column:
    """Without ``<think>`` blocks; an unclosed one reaches to the end."""
    return strip(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?s)<think>.*?(?:</think>|\z)", ""))


def strip_fence(c) -> Column:
    """The inside of a Markdown code fence, if the text is one."""
    x = strip(c)
    inner = F.regexp_replace(F.regexp_replace(x, r"^```[^\n]*\n?", ""), r"```$", "")
    return F.when(x.startswith("```"), strip(inner)).otherwise(x)


def repair_json(c) -> Column:
    """Straight quotes for curly ones, no comma before a closing bracket."""
    x = F.translate(F.coalesce(col(c), F.lit("")), "“”‘’", "\"\"''")
    return F.regexp_replace(x, r",(\s*[}\]])", "$1")


def is_ignored_key(c) -> Column:
    key = F.lower(F.trim(col(c)))
    return key.isin(IGNORED_KEYS) | F.element_at(F.split(key, r"\."), -1).isin(IGNORED_LAST)


def sanitized_name(c) -> Column:
    """Download name of a sanitized file."""
    return F.concat(F.lit("sanitized_"), F.regexp_replace(F.element_at(F.split(col(c), "/"), -1), r"(?i)\.pdf$", ""), F.lit(".pdf"))


def with_psm(c, psm) -> Column:
    """OCR options with this page segmentation mode in place of the one given, or added."""
    x, mode = strip(c), F.concat(F.lit("--psm "), F.lit(psm).cast("string") if isinstance(psm, int) else psm.cast("string"))
    given = x.rlike(r"(?:^|\s)--psm[ =]\s*\d+")
    return F.when(given, F.regexp_replace(x, F.lit(r"(?<!\S)--psm[ =]\s*\d+"), mode)).otherwise(F.trim(F.concat_ws(" ", F.nullif(x, F.lit("")), mode)))


def compact(c, most: int = 400) -> Column:
    """White space collapsed, cut with an ellipsis."""
    x = collapse(c)
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)


#: What an answer of a language model has to be.
CONTRACT = (
    "You find personal and confidential items in documents. Rules for the answer: "
    "it is one JSON array and nothing else, no prose, no Markdown, no reasoning; "
    'every element is an object with exactly the keys "quote", "category" and "confidence"; '
    "a quote is copied character by character from the text, is the whole value and only the value, without its label or sentence; "
    "web and e-mail addresses, numbers and identifiers are quoted as whole tokens; "
    "a category is any fitting name in UPPER_SNAKE_CASE; a confidence is a number from 0 to 1; "
    "no pair of quote and category comes twice; without findings the answer is []."
)


def prompt(text, table_hint: Column | None = None, retry: Column | None = None, limit: int = DEFAULT.llm_text_limit, reason: Column | None = None) -> Column:
    """Messages that ask a language model for quotes as JSON; ``retry`` holds a response that could not be read, ``reason`` says why."""
    nothing = F.lit(None).cast("string")
    table_hint = F.lit(False) if table_hint is None else table_hint
    retry, reason = nothing if retry is None else retry.cast("string"), nothing if reason is None else reason
    table = F.when(table_hint, F.lit(" Rows between [TABLE] and [/TABLE] hold cells separated by |; quote single cells as they stand, wrapped ones too.")).otherwise(F.lit(""))
    why = F.when(reason.isNotNull(), F.concat(F.lit("\n\nWhy you are asked again: "), reason)).otherwise(F.lit(""))
    again = F.when(retry.isNotNull(), F.concat(F.lit("\nThe last answer could not be read: "), F.substring(collapse(retry), 1, 1200), F.lit("\nGive it as a JSON array."))).otherwise(F.lit(""))
    user = F.concat(F.lit("Text:\n"), F.substring(col(text), 1, limit), why, again)
    return F.array(F.struct(F.lit("system").alias("role"), F.concat(F.lit(CONTRACT), table).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
