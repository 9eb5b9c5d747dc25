"""Asking a language model about pages: passes, attempts with feedback, and the union of what the passes name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.labels import is_low_signal, is_oversized, normalize_category
from ..functions.payloads import completion_text, parse_answer
from ..functions.text import collapse, prompt
from ..operators.fuzzy import localize_quotes
from ..sources.providers import provide

PAGE = ["doc_id", "page_number"]


def ask(pages: DataFrame, folder: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """doc_id, page_number, pass_no, attempt, ok, items, raw, error: the last answer of every pass over ``pages`` (doc_id, page_number, text[, has_table]).

    Every attempt asks only for the answers that could not be read so far and is written under
    ``folder``, so neither a lost executor nor a second reader asks again for what is there.
    """
    hint = F.col("has_table") if "has_table" in pages.columns else F.lit(False)
    todo = pages.select(*PAGE, "text", hint.alias("has_table"), F.explode(F.sequence(F.lit(1), F.lit(config.llm_passes))).alias("pass_no"))
    todo = todo.withColumn("last", F.lit(None).cast("string")).withColumn("reason", F.lit(None).cast("string"))
    spark, done = pages.sparkSession, []
    for attempt in range(1, config.llm_attempts + 1):
        place = f"{folder}/attempt={attempt}"
        asked = provide("chat", todo.withColumn("messages", prompt("text", F.col("has_table"), F.col("last"), config.llm_text_limit, F.col("reason"))).drop("text", "last", "reason"))
        answers = asked.withColumn("a", parse_answer(F.coalesce(completion_text(F.col("raw")), F.lit("")), config.llm_raw_limit))
        answers = answers.select(*PAGE, "pass_no", F.lit(attempt).alias("attempt"), (F.col("error").isNull() & F.col("a.ok")).alias("ok"), F.col("a.items").alias("items"), "raw", "error")
        answers.write.mode("overwrite").parquet(place)
        answers = spark.read.parquet(place)
        final = attempt == config.llm_attempts
        done.append(answers if final else answers.where("ok"))
        failed = answers.where("not ok")
        if final or failed.isEmpty():
            break
        again = failed.select(*PAGE, "pass_no", completion_text(F.col("raw")).alias("last"), F.lit("The answer was no JSON array of objects with quote, category and confidence.").alias("reason"))
        todo = todo.drop("last", "reason").join(again, [*PAGE, "pass_no"])
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def candidates(answers: DataFrame) -> DataFrame:
    """doc_id, page_number, quote, category, confidence: of quotes and categories that are equal but for case and white space the surest."""
    rows = answers.where("ok").select(*PAGE, "pass_no", F.posexplode("items").alias("place", "i"))
    best = F.struct(F.col("i.confidence").alias("confidence"), (-F.col("pass_no")).alias("p"), (-F.col("place")).alias("k"), F.col("i.quote").alias("quote"), F.col("i.category").alias("category"))
    rows = rows.groupBy(*PAGE, F.lower(collapse("i.quote")).alias("_q"), F.lower(collapse("i.category")).alias("_c")).agg(F.max(best).alias("b"))
    return rows.select(*PAGE, "b.quote", "b.category", "b.confidence")


def warnings(answers: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """doc_id, page_number, pass_no, message of every pass that was skipped."""
    shown = F.substring(collapse(F.coalesce(completion_text(F.col("raw")), F.lit(""))), 1, 160)
    said = F.when(F.col("error").isNotNull(), F.concat(F.lit("failed after retries: "), "error")).otherwise(F.concat(F.lit("gave no readable answer: "), shown))
    return answers.where("not ok").select(*PAGE, "pass_no", F.concat(F.lit("Pass "), F.col("pass_no").cast("string"), F.lit(f"/{config.llm_passes} "), said).alias("message"))


def triage(pages: DataFrame, words: DataFrame, folder: str, config: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Spans that the model names, found in the pages' words, and warnings."""
    answers = ask(pages, folder, config)
    items = candidates(answers).withColumn("category", normalize_category("category", "quote")).where(~is_low_signal("quote", "category"))
    found = localize_quotes(items, words, config).where(F.col("score") >= config.min_entity_confidence)
    return found.where(~is_oversized("quote", config.max_span_tokens, config.max_span_chars)), warnings(answers, config)
