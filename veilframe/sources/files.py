"""Files as tables: uploads, manifests, labelled rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT
from ..functions.labels import normalize_label
from ..functions.payloads import load


def read_binary(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length and content of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def validate_uploads(files: DataFrame, max_mb: int = DEFAULT.max_upload_mb) -> DataFrame:
    """``files`` with status and reason: the first test that a file fails, else 200."""
    answer = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))
    reject = (
        F.when(~F.lower("path").endswith(".pdf"), answer(400, "not a .pdf file"))
        .when(F.col("length") == 0, answer(400, "empty file"))
        .when(F.col("length") > max_mb * 1024 * 1024, answer(413, "too large"))
        .when(F.substring("content", 1, 4) != F.lit(b"%PDF"), answer(400, "no PDF signature"))
        .otherwise(answer(200, None))
    )
    return files.withColumn("_r", reject).select(*files.columns, F.col("_r.status").alias("status"), F.col("_r.reason").alias("reason"))


def manifest(files: DataFrame, most: int | None = None) -> DataFrame:
    """filename, absolute_path, size_bytes and sha256, by name."""
    out = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("path").alias("absolute_path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    out = out.orderBy("filename", "absolute_path")
    return out if most is None else out.limit(most)


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = "id", language: str | None = None) -> DataFrame:
    """``n`` rows that a seeded hash puts first, whatever the partitioning; optionally English only."""
    if language:
        df = df.where(F.lower(F.trim(language)).isin("en", "english"))
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("value", T.StringType())]))


def _int(x):
    try:
        return int(x)
    except (TypeError, ValueError):
        return None


def _first(item: dict, *names):
    return next((item[n] for n in names if item.get(n) is not None), None)


def _gold(mask, labels):
    out = []
    for value, is_mask in ((mask, True), (labels, False)):
        found = load(value) if isinstance(value, str) and value.strip() else None
        for item in found if isinstance(found, list) else []:
            if isinstance(item, dict):
                start, end = _int(_first(item, "start", "begin", "from")), _int(_first(item, "end", "stop", "to"))
                label, text = _first(item, "label", "entity", "type"), _first(item, "value") if is_mask else None
            elif isinstance(item, (list, tuple)) and len(item) >= 3 and not is_mask:
                start, end, label, text = _int(item[0]), _int(item[1]), item[2], None
            else:
                continue
            if start is not None and end is not None and end > start:
                out.append((start, end, None if label is None else str(label), None if text is None else str(text)))
        if out:
            break
    return out


def _gold_batch(mask: pd.Series, labels: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("start", "end", "label", "value"), x)) for x in _gold(a, b)] for a, b in zip(mask, labels)], dtype=object)


def gold_spans(rows: DataFrame) -> DataFrame:
    """Labelled spans of rows (id, source_text, privacy_mask, span_labels): the mask's if it has any, else the labels'.

    Both are JSON or Python literals. Offsets are clamped to the text; a start of 0 is one.
    """
    rows = rows.select("id", "source_text", F.explode(F.pandas_udf(_gold_batch, _SPANS)("privacy_mask", "span_labels")).alias("g"))
    start, end = F.greatest(F.lit(0), F.col("g.start")), F.least(F.length("source_text"), F.col("g.end"))
    rows = rows.select("id", start.alias("start"), end.alias("end"), normalize_label("g.label").alias("label"), F.coalesce(F.nullif(F.trim("g.value"), F.lit("")), F.substring("source_text", start + 1, end - start)).alias("text"))
    return rows.where("end > start").dropDuplicates(["id", "start", "end", "label"]).withColumn("confidence", F.lit(1.0)).withColumn("source", F.lit("gold"))
