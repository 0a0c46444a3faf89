"""Thumbnail tiers and caches: totals, presence, eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: All tiers; a tier is trimmed when it is this much over its budget.
TIERS = ("js", "j", "jm", "jh")
HYSTERESIS = 1.25


def totals(tiers: DataFrame) -> DataFrame:
    """Bytes of every tier, 0 for empty ones."""
    names = tiers.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    sums = tiers.groupBy("tier").agg(F.sum("byte_len").alias("bytes"))
    return names.join(sums, "tier", "left").select("tier", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def presence(tiers: DataFrame, path: str) -> DataFrame:
    names = tiers.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    mine = tiers.filter(F.col("path") == path).select("tier", "byte_len")
    return names.join(mine, "tier", "left").select("tier", F.col("byte_len").isNotNull().alias("present"), F.coalesce("byte_len", F.lit(0)).alias("byte_len"))


def evicted(tiers: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """(tier, path) of thumbnails to drop, the least recently used first; tiers without a budget are never trimmed.

    Nothing goes until a tier is HYSTERESIS times its budget; then it is trimmed to the budget itself.
    """
    budget = F.lit(None).cast("bigint")
    for name, size in budgets.items():
        budget = F.when(F.col("tier") == name, F.lit(size)).otherwise(budget)
    newest = Window.partitionBy("tier").orderBy(F.desc("accessed_at"), F.desc("path")).rowsBetween(Window.unboundedPreceding, 0)
    rows = tiers.withColumn("budget", budget).filter("budget is not null")
    over = rows.groupBy("tier").agg(F.sum("byte_len").alias("total"), F.max("budget").alias("b")).filter(F.col("total") > F.col("b") * HYSTERESIS).select("tier")
    rows = rows.join(F.broadcast(over), "tier", "left_semi")  # a row for each tier
    return rows.withColumn("running", F.sum("byte_len").over(newest)).filter("running > budget").select("tier", "path")


def touched(tiers: DataFrame, marks: DataFrame) -> DataFrame:
    """Tiers after buffered reads (tier, path, ts): the latest access counts."""
    last = marks.groupBy("tier", "path").agg(F.max("ts").alias("ts"))
    return tiers.join(last, ["tier", "path"], "left").withColumn("accessed_at", F.greatest("accessed_at", F.coalesce("ts", F.col("accessed_at")))).drop("ts")


def survey(listing: DataFrame) -> DataFrame:
    """Bytes of each gallery's cache (gallery, bytes, last_opened), the last opened first."""
    return listing.groupBy("gallery").agg(F.sum("bytes").alias("bytes"), F.max("last_opened").alias("last_opened")).orderBy(F.desc("last_opened"), "gallery")


def pruned(galleries: DataFrame, ceiling: int, keep: str | None = None) -> DataFrame:
    """Galleries (gallery, bytes, last_opened, locked) to remove, the coldest first, until all together are within the ceiling.

    The one to keep and locked ones are passed over.
    """
    may_go = ~F.col("locked") if keep is None else ~F.col("locked") & (F.col("gallery") != keep)
    total = galleries.agg(F.sum("bytes").alias("total"))
    coldest = Window.orderBy("last_opened", F.desc("gallery")).rowsBetween(Window.unboundedPreceding, -1)
    freed = galleries.filter(may_go).withColumn("freed", F.coalesce(F.sum("bytes").over(coldest), F.lit(0)))
    return freed.crossJoin(F.broadcast(total)).filter(F.col("total") - F.col("freed") > ceiling).select("gallery", "bytes")
