import random

import pytest
from pyspark.sql import functions as F

from veilframe.operators import evaluate

NAMES = {"median": 0.5, "p90": 0.9, "p95": 0.95}


def brute(values, p):
    """Linear interpolation between the neighbours of a rank."""
    values = sorted(v for v in values if v is not None)
    if not values:
        return None
    at = p * (len(values) - 1)
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


def same(got, values):
    known = [v for v in values if v is not None]
    assert got["count"] == len(known)
    assert (got["min"], got["max"]) == ((min(known), max(known)) if known else (None, None))
    for name, p in NAMES.items():
        want = brute(values, p)
        assert got[name] == (want if want is None else pytest.approx(want, rel=1e-12, abs=1e-9))


def test_summary_equals_brute_force(spark):
    r = random.Random(2)
    groups = {
        "one": [4.5],
        "two": [1.0, 2.0],
        "none": [None, None],
        "ties": [7.0] * 3000 + [8.0] * 2,
        "tail": [r.paretovariate(0.5) for _ in range(5000)],
        "signs": [r.gauss(0, 1) for _ in range(1500)] + [None] * 20,
        None: [float(k) for k in range(700)],
    }
    rows = [(k, 1, v) for k, values in groups.items() for v in values] + [("one", 2, 9.0)]
    df = spark.createDataFrame(rows, "a string, count int, v double").repartition(7)
    got = {(x["a"], x[1]): x for x in evaluate.numeric_summary(df.withColumnRenamed("count", "b"), "v", ["a", "b"]).collect()}
    assert set(got) == {(k, 1) for k in groups} | {("one", 2)}
    for k, values in groups.items():
        same(got[k, 1], values)


def test_summary_without_keys_and_of_whole_numbers(spark):
    values = [k * k % 1009 for k in range(2000)]
    same(evaluate.numeric_summary(spark.createDataFrame([(v,) for v in values], "v long"), "v").first(), values)
    empty = spark.range(0).select(F.col("id").cast("double").alias("v"))
    same(evaluate.numeric_summary(empty, "v").first(), [])
    assert evaluate.numeric_summary(empty.withColumn("g", F.lit(1)), "v", ["g"]).count() == 0
