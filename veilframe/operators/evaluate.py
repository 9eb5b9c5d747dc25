"""Measuring detections against labelled spans, and summaries of numbers and jobs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT
from ..functions.labels import capability_label, normalize_label
from ..functions.numbers import elapsed, safe_divide, span_iou

#: Percentiles of a summary, and the binary logarithm of the ranges that a group is cut into to find them.
PERCENTILES = {"median": 0.5, "p90": 0.9, "p95": 0.95}
CUT_LEVELS = 8


def iou_pairs(predicted: DataFrame, gold: DataFrame, least: float = DEFAULT.match_iou, key: str = "doc_id") -> DataFrame:
    """Predicted and gold spans of one document and label with at least this overlap: pred_index, gold_index, iou, score.

    Spans of IoU above 0 overlap, so both sides are bucketed as in the interval join.
    """
    bucket = 256
    cut = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor((F.col(b) - 1) / bucket)))
    p = predicted.where("end > start").select(key, normalize_label("label").alias("label"), "pred_index", "start", "end", "score").withColumn("_b", cut("start", "end"))
    g = gold.where("end > start").select(key, normalize_label("label").alias("label"), "gold_index", F.col("start").alias("g0"), F.col("end").alias("g1")).withColumn("_b", cut("g0", "g1"))
    both = p.join(g, [key, "label", "_b"]).withColumn("iou", span_iou("start", "end", "g0", "g1"))
    return both.where((F.col("iou") >= least) & (F.col("iou") > 0)).select(key, "label", "pred_index", "gold_index", "iou", "score").distinct()


def match_spans(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One-to-one matches, greedily by IoU, score, prediction and gold index, in each document.

    A document's pairs are in order in one row, and the rows are taken in batches.
    """
    kinds = {f.name: f for f in pairs.schema}
    others = [c for c in pairs.columns if c != key]
    order = F.struct((-F.col("iou")).alias("_1"), (-F.col("score")).alias("_2"), F.col("pred_index").alias("_3"), F.col("gold_index").alias("_4"), *(F.col(c).alias(f"o_{c}") for c in others))
    rows = pairs.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("_p"))

    def taken(preds: pd.Series, golds: pd.Series) -> pd.Series:
        out = []
        for p, g in zip(preds, golds):
            seen_p, seen_g, keep = set(), set(), []
            for k, (a, b) in enumerate(zip(p, g)):
                if a not in seen_p and b not in seen_g:
                    seen_p.add(a)
                    seen_g.add(b)
                    keep.append(k)
            out.append(keep)
        return pd.Series(out, dtype=object)

    at = F.explode(F.pandas_udf(taken, "array<int>")(F.col("_p._3"), F.col("_p._4")))
    rows = rows.select(key, "_p", at.alias("_k")).select(key, F.get("_p", F.col("_k")).alias("_m"))
    return rows.select(*(F.col(key) if c == key else F.col("_m")[f"o_{c}"].cast(kinds[c].dataType).alias(c) for c in pairs.columns))


def capability_slice(spans: DataFrame) -> DataFrame:
    """Spans whose label the engine claims, under that label."""
    return spans.withColumn("label", capability_label("label")).where("label is not null")


def prf(counts: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 of summed tp, fp and fn; 0 where undefined."""
    sums = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    out = sums.withColumn("precision", safe_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", safe_divide("tp", F.col("tp") + F.col("fn")))
    return out.withColumn("f1", safe_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(predicted: DataFrame, gold: DataFrame, matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """tp, fp and fn of each document."""
    n = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    rows = n(predicted, "p").join(n(gold, "g"), key, "full_outer").join(n(matches, "tp"), key, "full_outer").na.fill(0)
    return rows.select(key, "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))


def numeric_summary(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """count, min, max, mean, median, p90 and p95, exact and linearly interpolated; nulls without values.

    The ranks that are asked for are found by narrowing, so that no group is ever held in one
    buffer: equal values are counted first, a sketch of fixed size cuts each group into
    ``2 ** CUT_LEVELS`` ranges, their counts tell which ranges hold the ranks, and only the
    values of those (six at most) are put in order. The sketch moves the borders of the ranges, never the result.
    """
    keys, x = keys or [], F.col(value)
    rows = df.select(F.struct(*keys).alias("_k") if keys else F.struct(F.lit(0).alias("_0")).alias("_k"), x.alias("_x"), x.cast("double").alias("_v"))
    shares = [k / 2**CUT_LEVELS for k in range(1, 2**CUT_LEVELS)]
    sums = (rows.groupBy("_k") if keys else rows).agg(
        F.count("_x").alias("count"), F.min("_x").alias("min"), F.max("_x").alias("max"), F.avg("_x").alias("mean"),
        F.percentile_approx("_v", shares, 10000).alias("_cuts"), *([] if keys else [F.struct(F.lit(0).alias("_0")).alias("_k")]),
    )
    at = {name: F.lit(p) * (F.col("count") - 1) for name, p in PERCENTILES.items()}
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(c), F.ceil(c)) for c in at.values()))))
    cuts, wanted = (sums.where("count > 0").select("_k", c) for c in ("_cuts", ranks.alias("_ranks")))
    cut = rows.where("_v is not null").groupBy("_k", "_v").agg(F.count("*").alias("_n")).join(cuts, "_k").withColumn("_bin", F.lit(0))
    for level in reversed(range(CUT_LEVELS)):  # binary search for the number of cuts below the value
        cut = cut.withColumn("_bin", F.col("_bin") + F.when(F.get("_cuts", F.col("_bin") + (2**level - 1)) < F.col("_v"), 2**level).otherwise(0))
    within = lambda low, high: F.exists("_ranks", lambda r: (r >= F.col(low)) & (r < F.col(high)))
    bins = cut.groupBy("_k", "_bin").agg(F.sum("_n").alias("_m")).join(wanted, "_k")
    bins = bins.withColumn("_to", F.sum("_m").over(Window.partitionBy("_k").orderBy("_bin"))).withColumn("_from", F.col("_to") - F.col("_m"))
    held = cut.drop("_cuts").join(bins.where(within("_from", "_to")).select("_k", "_bin", "_from", "_ranks"), ["_k", "_bin"])
    held = held.withColumn("_to", F.col("_from") + F.sum("_n").over(Window.partitionBy("_k", "_bin").orderBy("_v"))).withColumn("_low", F.col("_to") - F.col("_n"))
    found = held.where(within("_low", "_to")).groupBy("_k").agg(F.collect_list(F.struct("_low", "_to", "_v")).alias("_found"))
    value_at = lambda rank: F.get(F.filter("_found", lambda f: (f["_low"] <= rank) & (rank < f["_to"])), 0)["_v"]
    between = lambda c: F.when(F.floor(c) == c, value_at(F.floor(c))).otherwise(value_at(F.floor(c)) * (F.ceil(c) - c) + value_at(F.ceil(c)) * (c - F.floor(c)))
    out = sums.join(found, "_k", "left")
    return out.select(*(F.col("_k")[k].alias(k) for k in keys), "count", "min", "max", "mean", *(between(c).alias(name) for name, c in at.items()))


def job_latency(jobs: DataFrame) -> DataFrame:
    """``jobs`` with queue_wait_sec, processing_sec, total_sec and end_to_end_sec, the last up to the download if there was one."""
    return jobs.withColumns(
        {
            "queue_wait_sec": elapsed("submitted_at", "processing_started_at"),
            "processing_sec": elapsed("processing_started_at", "completed_at"),
            "total_sec": elapsed("submitted_at", "completed_at"),
            "end_to_end_sec": elapsed("submitted_at", F.coalesce("downloaded_at", "completed_at")),
        }
    )


def throughput(jobs: DataFrame) -> DataFrame:
    """completed, failed, failure_rate and completed jobs an hour, over the time from the first submission to the last completion."""
    done = F.col("final_status") == "completed"
    rows = jobs.agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(F.col("final_status") == "failed").alias("failed"),
        F.min("submitted_at").alias("_a"), F.max("completed_at").alias("_b"),
    ).withColumn("window_sec", elapsed("_a", "_b"))
    return rows.select("total", "completed", "failed", safe_divide("failed", "total").alias("failure_rate"), "window_sec", safe_divide(F.col("completed") * 3600, "window_sec").alias("per_hour"))
