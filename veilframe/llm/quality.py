"""Quality scores by compression with dictionaries of good and of bad text.

A text is compressed in pieces with a zstandard dictionary built from text labelled good
and with one built from text labelled bad. The difference of the compressed sizes, over
the uncompressed size and a constant, becomes a probability by a logistic fit on other
labelled rows. The constant draws texts too short for a difference to the base rate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_fold, slices

#: Bytes of a piece: short, so that the dictionary and not the text's own past is what helps.
PIECE = 1024
LEVEL = 5
#: Bytes added to a text's size, so that a few bytes tell little.
SHORT = 50
DICTIONARY_BYTES = 256 * 1024
#: Labelled rows a class for the dictionaries, pieces a class taken from them, and rows a class for the calibration.
SAMPLE_ROWS, SAMPLE_PIECES, CALIBRATION_ROWS = 3000, 6000, 3000


class Model:
    def __init__(self, good: bytes, bad: bytes, weights=(0.0, 0.0)):
        self.dictionaries = (good, bad)
        self.weights = weights
        self._ready = None

    def __getstate__(self):
        return self.dictionaries, self.weights

    def __setstate__(self, state):
        self.dictionaries, self.weights = state
        self._ready = None

    def feature(self, text: str | None) -> float:
        """(size with the bad dictionary - size with the good one) / (size + SHORT); 0 for an empty text."""
        if self._ready is None:
            self._ready = []
            for data in self.dictionaries:
                d = zstandard.ZstdCompressionDict(data or b"\n" * 8)
                d.precompute_compress(level=LEVEL)
                self._ready.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        good, bad = self._ready
        raw = (text or "").encode("utf-8", "surrogatepass")
        diff = 0
        for k in range(0, len(raw), PIECE):
            part = raw[k : k + PIECE]
            diff += len(bad(part)) - len(good(part))
        return diff / (len(raw) + SHORT)

    def score(self, text: str | None) -> float:
        z = self.weights[0] + self.weights[1] * self.feature(text)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _sample(labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` label rows of each class: a bounded table, so it may be broadcast."""
    parts = [labels.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for q in (0, 1)]
    return F.broadcast(parts[0].union(parts[1]))


def _logistic(features: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Intercept and weights, by Newton steps with a slight ridge; all 0 without both classes."""
    if not len(y) or y.min() == y.max():
        return (0.0,) * (features.shape[1] + 1)
    scale = np.where(features.std(axis=0) > 0, features.std(axis=0), 1.0)
    x = np.column_stack([np.ones(len(y)), features / scale])
    ridge = np.full(x.shape[1], 1e-2)
    ridge[0] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), *(w[1:] / scale).tolist()


def fit(docs: DataFrame, labels: DataFrame, may_use, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled rows for which ``may_use`` (a condition on doc_id) holds.

    Half of them, by a hash, feed the dictionaries, the others the calibration; each is a
    bounded sample. Null labels are left out, and doc_ids with both labels. Without both
    classes every score is 0.5.
    """
    labels = labels.where(may_use & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    labels = labels.where("quality = most").select("doc_id", "quality")
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    texts = docs.select("doc_id", "text").where("text is not null")

    rows = texts.join(_sample(labels.where(half == 0), sample_rows), "doc_id")
    pieces = rows.select("doc_id", "quality", F.explode(F.expr(f"transform(sequence(0, greatest(length(text) - 1, 0), {PIECE}), k -> struct(k, substring(text, k + 1, {PIECE}) as piece))")).alias("p"))
    sets = []
    for q in (1, 0):
        mine = pieces.where(F.col("quality") == q).select("p.piece", F.xxhash64("doc_id", "p.k").alias("h"), "doc_id", "p.k")
        sets.append([r["piece"].encode("utf-8", "surrogatepass") for r in mine.orderBy("h", "doc_id", "k").limit(SAMPLE_PIECES).collect()])
    size = min(DICTIONARY_BYTES, *(sum(map(len, x)) // 2 for x in sets))
    model = Model(*(dictionary(x, size) for x in sets))

    held = texts.join(_sample(labels.where(half == 1), CALIBRATION_ROWS), "doc_id")

    def run(batches):
        for batch in slices(batches):
            found = [model.feature(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column("quality").cast(pa.int32())], names=["x", "y"])

    found = held.mapInArrow(run, "x double, y int").toArrow()
    y = np.array(found["y"], float)
    counts = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if all(sets) and len(counts) == 2 and len(set(y)) == 2:
        w = _logistic(np.array(found["x"], float)[:, None], y)
        # The sample is balanced, the labels are not: weigh the intercept back.
        w0 = w[0] + float(np.log(counts[1] / counts[0]) - np.log((y == 1).sum() / (y == 0).sum()))
        model.weights = (w0, *w[1:])
    return model


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or raw content where there is too little text to train one."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of each row, from its whole text alone.

    A null or empty text gets the rate of texts without a difference. Repeated rows and null doc_ids
    are scored like others; other columns are ignored; an empty table gives no rows.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for batch in slices(batches):
            got = [model.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64()), pa.array([int(g >= threshold) for g in got], pa.int32())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def held_out(doc_id):
    return crc_fold(doc_id, 5) == 0
