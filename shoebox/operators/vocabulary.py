"""Tag counts, lists, suggestions and lookups by tag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions.scalars import fuzzy_score

#: How many suggestions, and preview paths, a client gets unless it says otherwise.
SUGGESTIONS, PREVIEW = 20, 120
NAMESPACE_BOOST = 50


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("namespace", "tag").agg(F.count("*").alias("count"))


def changed(old: DataFrame, new: DataFrame) -> bool:
    """Whether two vocabularies differ in any row."""
    return bool(old.exceptAll(new).take(1) or new.exceptAll(old).take(1))


def tag_list(counts: DataFrame, namespace: str) -> DataFrame:
    """A namespace's tags, the most frequent first."""
    return counts.filter(F.col("namespace") == namespace).orderBy(F.desc("count"), "tag")


def namespace_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("namespace").agg(F.sum("count").alias("count"))


def suggest(counts: DataFrame, text: str, namespace: str | None = None, limit: int = SUGGESTIONS) -> DataFrame:
    """The best matches for typed text: tags summed over namespaces with their best score, and namespaces themselves.

    Order: score, count, then tag and namespace, which breaks ties.
    """
    if namespace is not None:
        counts = counts.filter(F.col("namespace") == namespace)
    scored = counts.withColumn("score", fuzzy_score(F.lower("tag"), text)).filter("score is not null")
    found = scored.groupBy("tag").agg(F.sum("count").alias("count"), F.max("score").alias("score")).select(F.lit("").alias("namespace"), "tag", "count", "score")
    if namespace is None:
        spaces = namespace_totals(counts).withColumn("score", fuzzy_score(F.lower("namespace"), text) + NAMESPACE_BOOST).filter("score is not null")
        found = found.union(spaces.select(F.lit("_namespace").alias("namespace"), F.col("namespace").alias("tag"), "count", "score"))
    return found.orderBy(F.desc("score"), F.desc("count"), "tag", "namespace").limit(limit)


def filtered_list(counts: DataFrame, text: str, by: str = "count") -> DataFrame:
    """The tag manager's list: tags that hold the text in any case, by count or name."""
    found = counts.filter(F.lower("tag").contains(text.lower()))
    return found.orderBy(F.desc("count"), "tag") if by == "count" else found.orderBy(F.lower("tag"), "tag")


def most_count(counts: DataFrame) -> DataFrame:
    """The largest count, 1 at least."""
    return counts.agg(F.greatest(F.coalesce(F.max("count"), F.lit(1)), F.lit(1)).alias("most"))


def tags_of(tags: DataFrame, path: str) -> DataFrame:
    return tags.filter(F.col("path") == path).select("namespace", "tag").orderBy("namespace", "tag")


def paths_with_tag(tags: DataFrame, namespace: str, tag: str) -> DataFrame:
    return tags.filter((F.col("namespace") == namespace) & (F.col("tag") == tag)).select("path")


def paths_with_tags(tags: DataFrame, wanted: list[str], namespace: str, limit: int = PREVIEW) -> DataFrame:
    """Paths with any of the tags, in the order of the first of them that they have, then by path."""
    place = F.array_position(F.array(*[F.lit(t) for t in wanted]), F.col("tag"))
    found = tags.filter((F.col("namespace") == namespace) & F.col("tag").isin(wanted)).groupBy("path").agg(F.min(place).alias("place"))
    return found.orderBy("place", "path").limit(limit)


def by_namespace(tags: DataFrame) -> DataFrame:
    """A file's tags as lists by namespace, the user's first."""
    found = tags.groupBy("path", "namespace").agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    return found.withColumn("place", F.when(F.col("namespace") == "user", 0).otherwise(1)).orderBy("path", "place", "namespace")


def set_membership(tags: DataFrame) -> DataFrame:
    return tags.filter(F.col("namespace") == "set").select("path", "tag")
