"""String similarities from 0 to 100, after the published indel (longest common subsequence) distance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """200 * LCS / total length; two empty strings are equal."""
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the common tokens and the common tokens with each side's rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    if not common:
        return ratio(" ".join(sorted(x)), " ".join(sorted(y)))
    if x <= y or y <= x:
        return 100.0
    first, second = ((common + " " + " ".join(sorted(s - (x & y)))).strip() for s in (x, y))
    return max(ratio(first, second), ratio(common, first), ratio(common, second))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer one of its length, or a shorter one at an end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    n, best = len(a), 0.0
    for start in range(1 - n, len(b)):
        best = max(best, ratio(a, b[max(0, start) : start + n]))
    return best


def best_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The best of the ratios; one below ``least`` may come out lower.

    No part of the longer string has a longer common subsequence with the shorter one
    than the whole has. That bounds the partial ratio, which is costly.
    """
    common, shorter = lcs(a, b), min(len(a), len(b))
    best = max(200.0 * common / (len(a) + len(b)) if a or b else 100.0, token_sort_ratio(a, b), token_set_ratio(a, b))
    bound = 200.0 * common / (shorter + common) if shorter else 100.0
    return best if bound <= best or bound < least else max(best, partial_ratio(a, b))


def window_similarity(quote: str, window: str, penalty: float = 2.0, cap: float = 14.0, least: float = 0.0) -> float:
    """Similarity of a normalized quote and window: longer windows lose, containment within two tokens counts 96.

    One below ``least`` may come out lower.
    """
    score = best_ratio(quote, window, least)
    extra = max(0, len(window.split()) - len(quote.split()))
    if extra:
        score -= min(cap, extra * penalty)
    if extra <= 2 and (quote in window or window in quote):
        score = max(score, 96.0)
    return score


def _udf(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else float(f(x, y)) for x, y in zip(a, b)], dtype="float64")

    return run


def ratio_column(a, b):
    return _udf(ratio)(a, b)


def token_sort_column(a, b):
    return _udf(token_sort_ratio)(a, b)


def token_set_column(a, b):
    return _udf(token_set_ratio)(a, b)


def partial_column(a, b):
    return _udf(partial_ratio)(a, b)


def window_similarity_column(a, b):
    return _udf(window_similarity)(a, b)
