"""Finding quotes in words that may differ from them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.numbers import adaptive_threshold, combined_confidence
from ..functions.similarity import window_similarity
from ..functions.text import normalize_for_fuzzy, token_count

_FOLD = ((re.compile(r"(?<=[0-9])[OQ](?=[0-9]|$)"), "0"), (re.compile(r"(?<=[0-9])[IL](?=[0-9]|$)"), "1"), (re.compile(r"[^A-Z0-9$]+"), " "))


def fold(text: str) -> str:
    """The normalization of the column function, for text joined from words."""
    text = text.upper()
    for pattern, by in _FOLD:
        text = pattern.sub(by, text)
    return text.strip()


def non_overlapping(found: list[tuple], least: float) -> list[tuple]:
    """Greedy choice by similarity of (similarity, fit, start, end) that meet nothing chosen before."""
    out: list = []
    for similarity, fit, start, end in sorted((f for f in found if f[0] >= least), key=lambda f: (-f[0], f[1], f[2], f[3])):
        if all(end <= a or start >= b for _, _, a, b in out):
            out.append((similarity, fit, start, end))
    return out


def find_quote(quote: str, sizes: range, words: list[tuple[str, int, int]], threshold: float, relaxed: float, config: EngineConfig = DEFAULT, compat: bool = False) -> list[tuple[int, int, float]]:
    """(start, end, similarity) of windows of one page's words that match a normalized quote.

    Among windows of equal similarity the one whose length fits the quote best comes
    first; ``compat`` takes the shortest instead. The relaxed threshold counts only if
    nothing reaches the other.
    """
    found, seen = [], {}
    length = len(quote.split())
    for i in range(len(words)):
        for size in sizes:
            if i + size > len(words):
                break
            text = fold(" ".join(w[0] for w in words[i : i + size]))
            if not text:
                continue
            if text not in seen:
                seen[text] = window_similarity(quote, text, config.fuzzy_penalty, config.fuzzy_penalty_cap, min(threshold, relaxed))
            fit = 0 if compat else (text != quote, abs(len(text.split()) - length), -size)
            found.append((seen[text], fit, words[i][1], words[i + size - 1][2]))
    chosen = non_overlapping(found, threshold)
    if not chosen and relaxed < threshold:
        chosen = non_overlapping(found, relaxed)
    return [(start, end, similarity) for similarity, _, start, end in chosen]


def localize_quotes(quotes: DataFrame, words: DataFrame, config: EngineConfig = DEFAULT, compat: bool = False) -> DataFrame:
    """Spans of ``quotes`` (doc_id, page_number, quote, category, confidence) among the words of their page.

    Words are gathered by page, whose size a page bounds; every quote then meets its own
    page only. Adds start, end, similarity and the mean of both confidences as score.
    """
    pages = words.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "text"))).alias("_words"))
    size = F.greatest(F.lit(1), F.least(token_count("quote"), token_count("_q")))
    rows = quotes.withColumn("_q", normalize_for_fuzzy("quote")).where("_q != ''")
    rows = rows.withColumns({"_n": size, "_relaxed": adaptive_threshold("_q", config.fuzzy_threshold)}).join(pages, ["doc_id", "page_number"])

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                sizes = range(max(1, r.n_ - config.fuzzy_min_padding), r.n_ + config.fuzzy_max_padding + 1)
                places = find_quote(r.q_, sizes, [(w["text"], w["start_char"], w["end_char"]) for w in r.words_], config.fuzzy_threshold, r.relaxed_, config, compat)
                out += [(r.doc_id, r.page_number, r.quote, r.category, r.confidence, a, b, s) for a, b, s in places]
            yield pd.DataFrame(out, columns=["doc_id", "page_number", "quote", "category", "confidence", "start", "end", "similarity"])

    rows = rows.select("doc_id", "page_number", "quote", "category", "confidence", F.col("_q").alias("q_"), F.col("_n").alias("n_"), F.col("_relaxed").alias("relaxed_"), F.col("_words").alias("words_"))
    out = rows.mapInPandas(run, "doc_id long, page_number int, quote string, category string, confidence double, start long, end long, similarity double")
    return out.withColumn("score", combined_confidence(F.col("confidence"), F.col("similarity")))
