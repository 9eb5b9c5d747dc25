"""Quality rules with risk-controlled cutoffs.

Each rule rejects a text whose measure reaches a cutoff. Per stratum (a band of text
lengths) a path of levels tightens all rules together; one part of the labelled good
rows, by a hash, lays it out, and the others, the holdout, are tested along it. At every
level an exact binomial test must show that all rules together reject less than ``RISK``
of the good texts; the first failure ends the sequence, so that one test level covers it,
and ``ERROR`` is divided by the number of strata. With probability ``1 - ERROR`` the rules
in force keep that limit in every stratum.

With S strata the holdout needs log(ERROR / S) / log(1 - RISK) good rows in each (149 for
one stratum, 203 for three). Strata with fewer are united with a neighbour before any
measure is looked at; where all rows together are too few, no rule is in force.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_worker, slices, staged
from .neardup import _mixed, _WordHashes

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Largest share of good texts that the rules may reject in a stratum; chance that any claim is wrong.
RISK, ERROR = 0.02, 0.05
#: Of ``FOLDS`` parts of the labelled good rows one lays out the paths, the others are the holdout.
FOLDS = 3
#: Levels: cutoffs by how many steps of their list each rule stays below its first cutoff that rejects a good row,
#: then cutoffs that reject this share of ``RISK`` at most.
MARGINS, SHARES = (16, 12, 9, 7, 5, 4, 3, 2, 1, 0), (1 / 80, 1 / 40)
#: Lower ends of the strata, in words, where the labels allow so many.
STRATA = (0, 100, 1000)
#: Cutoffs by rule, from lenient to strict.
RULES = {
    "symbols": [2.0 * 0.85**k for k in range(28)],
    "duplicate_lines": [1 - 0.04 * k for k in range(24)],
    "repeated_words": [1 - 0.04 * k for k in range(24)],
    "long_words": [40.0 * 0.93**k for k in range(28)],
    "short_words": [1 / (1 + 0.15 * k) for k in range(28)],
    "upper_case": [1 - 0.04 * k for k in range(24)],
    "exclamations": [1.0 * 0.85**k for k in range(28)],
}
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclamations"]


def text_stats(text: str | None, hashes: dict) -> tuple[int, ...]:
    """The counts named in ``_STATS``, over a whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    repeated = 0
    if len(words) > WINDOW:
        h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        n = len(words) - WINDOW + 1
        key = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            key = _mixed(key * np.uint64(0x165667B19E3779F9) + h[k : k + n])
        _, at, times = np.unique(key, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[at] > 1)
        if len(twice):
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, twice, 1)
            np.add.at(edge, twice + WINDOW, -1)
            repeated = int(np.count_nonzero(np.cumsum(edge)))
    spaces = sum(map(text.count, " \t\n\r\x0b\x0c"))
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    return len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), upper, text.count("!")


def measures() -> dict:
    """Rule -> its measure as a column; 0 for texts without words."""
    c = F.col
    words, chars = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("word_chars"), F.lit(1))
    return {
        "symbols": c("n_symbols") / words,
        "duplicate_lines": c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
        "repeated_words": c("n_repeat_words") / words,
        "long_words": c("word_chars") / words,
        "short_words": F.when(c("n_words") > 0, c("n_words") / chars).otherwise(0.0),
        "upper_case": c("n_upper") / chars,
        "exclamations": c("n_exclamations") / words,
    }


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable, summed exactly."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def least_rows(risk: float, level: float) -> int:
    """Holdout rows without which no test can succeed."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def strata(sizes: dict[int, int], risk: float = RISK, error: float = ERROR) -> list[int]:
    """Lower ends of the strata that have holdout rows enough; ``sizes``: holdout rows by number in ``STRATA``."""
    ends, n = list(STRATA), [sizes.get(k, 0) for k in range(len(STRATA))]
    while len(n) > 1 and min(n) < least_rows(risk, error / len(n)):
        k = n.index(min(n))
        near = max(0, k - 1) if k == len(n) - 1 or k and n[k - 1] <= n[k + 1] else k
        n[near : near + 2] = [sum(n[near : near + 2])]
        del ends[near + 1]
    return ends


def path(reached: dict, risk: float = RISK, rules: dict | None = None) -> list[dict]:
    """Levels, each rule -> cutoff, from lenient to strict.

    ``reached``: rule -> good rows by how many cutoffs, from the strictest on, their
    measure reaches.
    """
    rules, out = rules or RULES, []
    for margin, share in [(m, 0.0) for m in MARGINS] + [(0, x * risk) for x in SHARES]:
        level = {}
        for rule, cutoffs in rules.items():
            counts = reached.get(rule, {})
            n = sum(counts.values())
            # Good rows that cutoff k rejects: those whose measure reaches at least as many as there are from k on.
            fine = [k for k in range(len(cutoffs)) if sum(v for j, v in counts.items() if j >= len(cutoffs) - k) <= share * n]
            k = (fine[-1] if fine else -1) - margin
            if n and k >= 0:
                level[rule] = cutoffs[k]
        out.append(level)
    return out


def accepted(rejected: list[int], n: int, risk: float, level: float) -> int:
    """Levels that hold, of those that reject so many of ``n`` holdout rows; the first failure ends the sequence."""
    for k, x in enumerate(rejected):
        if binomial_cdf(x, n, risk) > level:
            return k
    return len(rejected)


def _stratum(ends: list[int]):
    out = F.lit(0)
    for k, least in enumerate(ends):
        out = F.when(F.col("n_words") >= least, F.lit(k)).otherwise(out)
    return out


def stats(docs: DataFrame) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, T.LongType()) for n in _STATS)])

    def run(batches):
        hashes = per_worker(("rule_words",), _WordHashes)
        for batch in slices(batches):
            got = [text_stats(t, hashes) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([g[k] for g in got], pa.int64()) for k in range(len(_STATS)))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


_BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def fit(rows: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> tuple[list[int], dict]:
    """Lower ends of the strata and, by (stratum, rule), the cutoffs in force.

    From ``rows`` (of ``stats``) that pass the base rule and that ``labels(doc_id,
    quality)`` calls good and never bad. Only counts by stratum, rule, cutoff and level
    reach the driver.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("r")).where("q = 1 and r = 1").select("doc_id")
    mine = rows.where(f"not ({_BASE_FAILED})").join(good, "doc_id")
    lays_out = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0
    sizes = {r["s"]: r["n"] for r in mine.where(~lays_out).groupBy(_stratum(list(STRATA)).alias("s")).agg(F.count("*").alias("n")).collect()}
    ends = strata(sizes, risk, error)
    level = error / len(ends)

    def reached(cutoffs, measure):
        return F.size(F.filter(F.array(*map(F.lit, cutoffs)), lambda c: c <= measure)) if cutoffs else F.lit(0)

    by_rule = F.array(*(F.struct(F.lit(rule).alias("rule"), reached(RULES[rule], m).alias("k")) for rule, m in measures().items()))
    counts = mine.where(lays_out).select(_stratum(ends).alias("s"), F.explode(by_rule).alias("x")).groupBy("s", "x.rule", "x.k").agg(F.count("*").alias("n"))
    found: dict = {}
    for r in counts.collect():
        found.setdefault(r["s"], {}).setdefault(r["rule"], {})[r["k"]] = r["n"]
    paths = {s: path(x, risk) for s, x in found.items()}

    # Levels, from the strictest on, at which some rule rejects a row. A rule not in force has a cutoff out of reach.
    strictness = F.lit(0)
    for s, levels in paths.items():
        joint = F.greatest(*(reached([x.get(rule, float("inf")) for x in levels], m) for rule, m in measures().items()))
        strictness = F.when(_stratum(ends) == s, joint).otherwise(strictness)
    counts = mine.where(~lays_out).select(_stratum(ends).alias("s"), strictness.alias("k")).groupBy("s", "k").agg(F.count("*").alias("n"))
    held: dict = {}
    for r in counts.collect():
        held.setdefault(r["s"], {})[r["k"]] = r["n"]
    out = {}
    for s, levels in paths.items():
        rejected = [sum(v for j, v in held.get(s, {}).items() if j >= len(levels) - k) for k in range(len(levels))]
        if k := accepted(rejected, sum(held.get(s, {}).values()), risk, level):
            out |= {(s, rule): cutoff for rule, cutoff in levels[k - 1].items()}
    return ends, out


def judge(rows: DataFrame, ends: list[int], cutoffs: dict) -> DataFrame:
    """``rows`` of ``stats`` with base_failed, failed_rules and kept."""
    failed = []
    for rule, m in measures().items():
        cutoff = F.lit(None).cast("double")
        for k in range(len(ends)):
            if (k, rule) in cutoffs:
                cutoff = F.when(_stratum(ends) == k, F.lit(cutoffs[k, rule])).otherwise(cutoff)
        failed.append(F.when(m >= cutoff, F.lit(rule)))
    rows = rows.withColumn("base_failed", F.expr(_BASE_FAILED))
    rows = rows.withColumn("failed_rules", F.array_compact(F.array(*failed)))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept and failed_rules of each row.

    A null text has no words and fails the base rule. Rows with null doc_id are judged but
    never labelled; a doc_id that is labelled both good and bad counts as neither; repeated
    rows are judged alike; other columns are ignored. Where too few good rows are labelled
    to prove the limit, and on an empty label table, the rules reject nothing. An empty
    table gives no rows.
    """
    rows = staged(stats(docs), "stats")
    out = judge(rows, *fit(rows, labels, risk, error))
    return out.select("doc_id", *_STATS[:5], "base_failed", "kept", "failed_rules")
