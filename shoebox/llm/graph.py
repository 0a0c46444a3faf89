"""Connected components of a table of links, in alternating star steps on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import durable


def _toward_least(pairs: DataFrame) -> DataFrame:
    """(u, v) with the least of u and its partners in pairs as low."""
    low = pairs.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("k"), "low")
    return pairs.join(low, pairs["u"] == low["k"]).select("u", "v", F.least("low", "u").alias("low"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b) that isn't its component's least node.

    Each round links every node's larger partners to its least partner, then its smaller ones;
    rounds grow with the logarithm of the longest path. Links may repeat and point either way.
    """
    now = durable(links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(20,0)"))).first()
        if state == seen or not state[0]:
            return now
        seen = state
        both = now.select(F.col("node").alias("u"), F.col("root").alias("v")).union(now.select(F.col("root").alias("u"), F.col("node").alias("v")))
        large = _toward_least(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        large = durable(large, "large-star")
        small = _toward_least(large)
        now = small.select(F.col("v").alias("node"), F.col("low").alias("root")).union(small.select(F.col("u").alias("node"), F.col("low").alias("root")))
        now = durable(now.where("node <> root").distinct(), "small-star")
