"""Host rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col


def host(url) -> Column:
    return F.lower(F.try_parse_url(col(url), F.lit("HOST")))


def valid_rule(rule) -> Column:
    """A host name, or ``*.`` and one, with at least two labels."""
    return F.lower(F.trim(col(rule))).rlike(r"^(\*\.)?([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$")


def allowed(pages: DataFrame, rules: DataFrame, url: str = "url", rule: str = "rule") -> DataFrame:
    """``pages`` whose host equals a rule, or is the base of a ``*.`` rule or below it; without rules none.

    The host's suffixes, at most as many as its labels, meet the rules in an equi-join.
    """
    clean = F.lower(F.trim(rule))
    rows = rules.where(valid_rule(rule)).select(F.regexp_replace(clean, r"^\*\.", "").alias("_base"), clean.startswith("*.").alias("_wild"))
    rows = rows.groupBy("_base").agg(F.bool_or("_wild").alias("_wild"))
    labels = F.split(host(url), r"\.")
    parts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct(F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("base"), (k == 1).alias("whole")))
    found = pages.where(host(url).isNotNull()).select("*", F.explode(parts).alias("_p")).join(rows, F.col("_p.base") == F.col("_base"))
    return found.where(F.col("_p.whole") | F.col("_wild")).select(*pages.columns).distinct()
