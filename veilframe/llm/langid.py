"""Language identification by inferring each document's mixture of languages.

A language is a distribution over hashed letter n-grams. A document is a mixture of
them: expectation-maximisation finds the proportions, and languages are dropped from the
set while that raises the penalised likelihood.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import nothing, slices

#: Letters in an n-gram; log2 of the number of hash buckets.
GRAM, BITS = 3, 15
#: Labelled rows a language that the model is fitted on, on average.
SAMPLE_ROWS = 4000
#: Overlapping n-grams repeat evidence: so many count as one.
OVERLAP = GRAM
#: A language with a smaller share than this is tried without.
LEAST_SHARE = 0.03
UNKNOWN = "und"

_LETTERS: list = []


def letters() -> np.ndarray:
    """Per code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), np.bool_, sys.maxunicode + 1))
    return _LETTERS[0]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter n-grams of a text, and how often each occurs."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[c]
    if not is_letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.where(is_letter, c, 32)
    c = np.concatenate([[32], c, [32]]).astype(np.uint32)
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    h = c[: len(c) - GRAM + 1].copy()
    for k in range(1, GRAM):
        h = h * np.uint32(0x9E3779B1) + c[k : len(c) - GRAM + 1 + k]
    h = (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)
    counts = np.bincount(h, minlength=1 << BITS)
    found = np.flatnonzero(counts)
    return found, counts[found]


class Mixture:
    """languages: sorted names; logs: log-probability by bucket and language."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = 0.5):
        self.languages = languages
        p = counts + smoothing
        self.p = (p / p.sum(axis=0)).astype(np.float64)
        self.logs = np.log(self.p)

    @staticmethod
    def shares(p: np.ndarray, w: np.ndarray, start: np.ndarray, rounds: int = 25) -> np.ndarray:
        """Proportions by expectation-maximisation; w sums to 1."""
        for _ in range(rounds):
            mix = p @ start
            new = start * ((w / mix) @ p)
            if np.abs(new - start).max() < 2e-3:
                return new
            start = new
        return start

    def infer(self, text: str | None) -> tuple[str, float, list[float]]:
        """Most likely main language, a score from 0 to 1 and the proportions."""
        buckets, n = gram_counts(text)
        if not len(buckets) or not self.languages:
            return UNKNOWN, 0.0, [0.0] * len(self.languages)
        total = n.sum()
        alone = (n @ self.logs[buckets]) / OVERLAP
        weight = total / OVERLAP
        w = n / total
        keep = np.arange(len(self.languages))
        p = self.p[buckets]
        share = self.shares(p, w, np.full(len(keep), 1 / len(keep)))
        cost = 0.5 * np.log(weight + 1) + 1
        value = weight * (w @ np.log(p[:, keep] @ share)) - cost * (len(keep) - 1)
        while len(keep) > 1:
            out = share < LEAST_SHARE
            if not out.any() or out.all():
                out = np.arange(len(keep)) == share.argmin()
            less = keep[~out]
            if len(less) == 1:
                new, better = np.ones(1), alone[less[0]]
            else:
                new = share[~out] / share[~out].sum()
                new = self.shares(p[:, less], w, new)
                better = weight * (w @ np.log(p[:, less] @ new)) - cost * (len(less) - 1)
            if better < value:
                break
            keep, share, value = less, new, better
        every = np.zeros(len(self.languages))
        every[keep] = share
        best = int(every.argmax())
        # In one language alone, how much likelier it is than the others.
        sure = 1 / np.exp(np.minimum(alone - alone[best], 50)).sum() if len(keep) == 1 else 1.0
        return self.languages[best], float(min(1.0, max(0.0, every[best] * sure))), every.tolist()


def fit(docs: DataFrame, labelled, sample_rows: int = SAMPLE_ROWS) -> Mixture:
    """Fit on the whole texts of about ``sample_rows`` rows a language, chosen by a hash.

    ``labelled``: condition on the rows that may be used. Rows without lang or text are
    not. Only gram counts, at most 2^BITS a language, reach the driver.
    """
    rows = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", F.length("text")).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & (F.pmod("h", F.lit(1 << 30)) < int(min(1.0, sample_rows / n) * (1 << 30))))

    def run(batches):
        nothing()
        sums: dict = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                b, n = gram_counts(text)
                if len(b):
                    if lang not in sums:
                        sums[lang] = np.zeros(1 << BITS, np.int64)
                    sums[lang][b] += n
        for lang, counts in sums.items():
            b = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b)), pa.array(b, pa.int64()), pa.array(counts[b])], names=["lang", "bucket", "n"])

    found = rows.where(chosen).select("lang", "text").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    languages = sorted(set(found["lang"]))
    at = {x: k for k, x in enumerate(languages)}
    counts = np.zeros((1 << BITS, len(languages)))
    counts[found["bucket"], [at[x] for x in found["lang"]]] = found["n"]
    return Mixture(languages, counts)


def identify(docs: DataFrame, model: Mixture) -> DataFrame:
    """``docs`` with lang_pred and score, from the text alone.

    ``und`` and 0 for null text, a text without letters, or a model without languages.
    Columns of these two names are replaced; an empty table stays empty.
    """
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        nothing()
        for batch in slices(batches):
            got = [model.infer(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)
