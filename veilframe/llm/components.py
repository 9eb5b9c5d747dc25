"""Connected components by alternating large-star and small-star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, staged


def _stars(df: DataFrame) -> DataFrame:
    return df.where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of u to the least of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return _stars(both.where("v > u").join(least, "u").select("v", "m"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links u and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    found = edges.join(least, "u")
    return _stars(found.select("v", "m").union(least.select(F.col("u").alias("v"), "m")))


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 24)), F.sum(h.bitwiseAND((1 << 24) - 1))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node in ``edges(u, v)``; component is its least node.

    Self-links, repeated and reversed links are allowed; null ends are ignored. A node of
    high degree is never gathered into one row: neighbours are only compared with a
    per-node minimum. The number of rounds is about the logarithm of the largest
    component. An empty table gives an empty result.
    """
    links = edges.where("u is not null and v is not null")
    nodes = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    now, state = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v"), None
    while True:
        before, now = now, staged(_small_star(_large_star(now)), "links")
        drop(before)
        if (new := _state(now)) == state or not new[0]:
            break
        state = new
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
