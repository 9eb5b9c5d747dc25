"""Detectors of sensitive spans: pattern recognizers and contextual rules."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.labels import promote, reclassify
from ..functions.text import match_many


@dataclass(frozen=True)
class Recognizer:
    """A pattern without capturing groups, its base score, an optional test of the match, and a piece of text in every match."""

    entity_type: str
    pattern: str
    score: float
    check: str | None = None
    holds: str = ""


#: Patterns use ASCII classes only, so that every regular-expression engine agrees on them.
RECOGNIZERS = {
    r.entity_type: r
    for r in (
        Recognizer("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 1.0, holds="@"),
        Recognizer("URL", r"https?://[^ \t\r\n\"<>]+", 0.85, holds="://"),
        Recognizer("IP_ADDRESS", r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}", 0.95),
        Recognizer("CREDIT_CARD", r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", 0.9, "luhn"),
        Recognizer("PHONE_NUMBER", r"\+[0-9]{1,3} \([0-9]{2,4}\) [0-9]{3}-[0-9]{4}", 0.75, holds="+"),
        Recognizer("IBAN_CODE", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?", 0.8, "iban"),
        Recognizer("US_SSN", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.85),
        Recognizer("DATE_TIME", r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?", 0.85),
        Recognizer("PASSWORD", r"(?:token|password|secret|api_key) ?[=:] ?\"[^\" \n]{8,}\"", 0.9, holds="\""),
    )
}

#: Values said after a word for an identifier or a code: (type, lead, value, score). The longer words come first.
#: The words are fixed values.
CONTEXT_RULES = [
    ("CUSTOMER_IDENTIFIER", r"(?i:\b(?:customer|client|member|user|policy|account|receipt|transaction|order)\s*(?:identifier|id|number|no\.?|#)\s*(?:is\b|:|=)?\s*)", r"(?=[A-Za-z-]{0,23}[0-9])[A-Za-z0-9][A-Za-z0-9-]{3,23}(?![A-Za-z0-9-])", 0.9),
    ("SECURITY_CODE", r"(?i:\b(?:pin|otp|one[-\s]*time\s*(?:password|pin)|passcode|security\s*code|verification\s*code)\s*(?:is\b|:|=)?\s*)", r"[0-9]{4,8}(?![0-9A-Za-z])", 0.92),
]


def iban_valid(c: Column) -> Column:
    """Checksum 97 of an IBAN: letters count from 10, the first four characters go last."""
    x = F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    digits = F.transform(F.split(F.concat(F.substring(x, 5, 40), F.substring(x, 1, 4)), ""), lambda ch: F.when(ch.rlike("[A-Z]"), F.ascii(ch) - 55).otherwise(ch.try_cast("int")))
    rest = F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0), lambda a, d: F.when(d > 9, a * 100 + d).otherwise(a * 10 + d) % 97)
    return rest == 1


def _valid(kind: str | None, c: Column) -> Column:
    if kind == "luhn":
        return F.call_function("luhn_check", F.regexp_replace(c, "[^0-9]", ""))
    return iban_valid(c) if kind == "iban" else F.lit(True)


def _patterns(types: list[str] | None, context: bool) -> dict:
    out: dict = {t: RECOGNIZERS[t].pattern for t in (RECOGNIZERS if types is None else types)}
    return out | ({t: (lead, value) for t, lead, value, _ in CONTEXT_RULES} if context else {})


#: Shapes within every match of a type that are cheaper to look for than the match.
_SHAPES = {"IP_ADDRESS": r"[0-9]\.[0-9]", "CUSTOMER_IDENTIFIER": "[0-9]", "SECURITY_CODE": "[0-9]{4}"}


def _possible(text: str) -> dict[str, Column]:
    out = {t: F.col(text).contains(r.holds) for t, r in RECOGNIZERS.items() if r.holds}
    return out | {t: F.col(text).rlike(p) for t, p in _SHAPES.items()}


def holds_any(text: str = "text", types: list[str] | None = None, context: bool = True) -> Column:
    """Whether a text can have spans at all; it needs no spans to be known."""
    possible = _possible(text)
    whole = {t: f"{p[0]}{p[1]}" if isinstance(p, tuple) else p for t, p in _patterns(types, context).items()}
    return reduce(lambda a, b: a | b, (possible.get(t, F.lit(True)) & F.col(text).rlike(p) for t, p in whole.items()))


def _scan(docs: DataFrame, key: str, text: str, types: list[str] | None, context: bool) -> DataFrame:
    """Valid matches of recognizers and, with ``context``, of the contextual rules, in one scan."""
    spans = match_many(docs, [key], _patterns(types, context), text, _possible(text))
    kind, valid, score = F.col("kind"), F.lit(True), F.lit(None).cast("double")
    for t in RECOGNIZERS if types is None else types:
        r = RECOGNIZERS[t]
        score = F.when(kind == t, F.lit(r.score)).otherwise(score)
        if r.check:
            valid = F.when(kind == t, _valid(r.check, F.col("match"))).otherwise(valid)
    for t, _, _, sure in CONTEXT_RULES if context else ():
        score = F.when(kind == t, F.lit(sure)).otherwise(score)
        if t == "CUSTOMER_IDENTIFIER":
            valid = F.when(kind == t, (F.length("match") >= 6) | (F.length(F.regexp_replace("match", "[^0-9]", "")) >= 6)).otherwise(valid)
    return spans.where(valid).select(key, "start", "end", kind.alias("entity_type"), score.alias("score"), "match")


def recognize(docs: DataFrame, types: list[str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, entity_type, score, match of every recognizer's valid matches, in one scan."""
    return _scan(docs, key, text, types, context=False)


def contextual(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Identifiers and codes that a phrase before them gives away.

    An identifier needs a digit, and six characters of any kind or six digits.
    """
    return _scan(docs, key, text, [], context=True)


def refine(spans: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = DEFAULT.min_entity_confidence, lowest: float = 0.0) -> DataFrame:
    """Reclassify by name, promote by context, then keep scores of at least ``least``.

    ``lowest``: what no score is below. If that is enough already, no text is looked at.
    """
    spans = spans.withColumn("entity_type", reclassify("entity_type", "match"))
    if lowest >= least:
        return spans
    context = F.substring(F.col(text), F.greatest(F.col("start") - 48, F.lit(0)) + 1, F.least(F.col("start"), F.lit(48)) + F.col("end") - F.col("start") + 24)
    sure, unsure = spans.where(F.col("score") >= least), spans.where(F.col("score") < least)
    unsure = unsure.join(docs.select(key, text), key).withColumn("_p", promote("entity_type", "score", "match", context))
    unsure = unsure.withColumn("entity_type", F.col("_p.entity_type")).withColumn("score", F.col("_p.score")).select(*spans.columns)
    return sure.unionByName(unsure.where(F.col("score") >= least))


def dedupe_spans(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of spans with equal place, type and text (case aside) the surest."""
    rows = spans.withColumn("_t", F.lower("match"))
    return rows.groupBy(key, "start", "end", "entity_type", "_t").agg(F.max("score").alias("score"), F.max_by("match", F.struct("score", "match")).alias("match")).drop("_t")


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", types: list[str] | None = None) -> DataFrame:
    """All text detectors, refined and without repeats, in one scan of ``docs``."""
    lowest = min([RECOGNIZERS[t].score for t in (RECOGNIZERS if types is None else types)] + [r[3] for r in CONTEXT_RULES])
    return dedupe_spans(refine(_scan(docs, key, text, types, context=True), docs, key, text, lowest=lowest), key)


def face_detections(boxes: DataFrame) -> DataFrame:
    """One detection a page from merged face boxes (doc_id, page_number, x0, y0, x1, y1)."""
    gathered = boxes.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("page_number", "x0", "y0", "x1", "y1"))).alias("boxes"))
    return gathered.select(
        "doc_id", F.col("page_number").cast("long").alias("seq"), F.lit("[FACE - REDACTED]").alias("entity_text"), F.lit("FACE").alias("entity_type"), F.lit(0.99).alias("confidence_score"),
        F.lit("Vision").alias("source"), "boxes", F.array(F.lit("Vision")).alias("supporting_sources"), F.lit(None).cast("string").alias("decision_reason"),
    )
