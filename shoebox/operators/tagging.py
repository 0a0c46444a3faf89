"""Edits of tag lists, orders of sets, and merging the lists of duplicates.

A file's list of a namespace is an array of entries; a set entry may carry a position, name::N,
and is known by its name. Edits are array expressions, so they run in one pass over the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.functions.scalars import set_entry, set_name, set_position


class InvalidSetName(ValueError):
    """A set's name may not end in '::' and digits."""


def checked(namespace: str, *names: str) -> tuple[str, ...]:
    """The names, if they may be written in the namespace."""
    for n in names:
        head, _, digits = n.rpartition("::")
        if namespace == "set" and head and digits.isascii() and digits.isdigit() and int(digits) < 1 << 32:
            raise InvalidSetName(n)
    return names


def name_of(namespace: str, entry: Column) -> Column:
    return set_name(entry) if namespace == "set" else entry


def added(entries: Column, namespace: str, names: list[str]) -> Column:
    """The list with each name appended that no entry has."""
    out = entries
    for n in checked(namespace, *names):
        out = F.when(_holds(out, namespace, n), out).otherwise(F.concat(out, F.array(F.lit(n))))
    return out


def _holds(entries: Column, namespace: str, name: str) -> Column:
    return F.exists(entries, lambda e: name_of(namespace, e) == F.lit(name))


def removed(entries: Column, namespace: str, names: list[str]) -> Column:
    gone = checked(namespace, *names)
    return F.filter(entries, lambda e: ~name_of(namespace, e).isin(*gone))


def folded(entries: Column, namespace: str, sources: list[str], target: str, keep_positions: bool) -> Column:
    """The list with the sources turned into the target, in the place of the first of them.

    An entry that the target already has wins, further sources go, and a position is kept only
    on request.
    """
    sources = [s for s in checked(namespace, *sources) if s != target]
    checked(namespace, target)
    is_source = lambda e: name_of(namespace, e).isin(*sources) if sources else F.lit(False)
    first = F.array_position(F.transform(entries, is_source), True)
    kept = set_entry(F.lit(target), set_position(F.get(entries, first - 1))) if namespace == "set" and keep_positions else F.lit(target)
    has = _holds(entries, namespace, target)
    place = lambda e, k: F.when(is_source(e) & ~has & (k == first - 1), kept).when(~is_source(e), e)
    return F.filter(F.transform(entries, place), lambda e: e.isNotNull())


def edit(lists: DataFrame, change: Column, column: str = "entries") -> DataFrame:
    """lists with the change applied, and whether it changed a file's list."""
    return lists.withColumn("after", change).withColumn("changed", ~F.col("after").eqNullSafe(F.col(column)))


def order_set(members: DataFrame, order: DataFrame, name: str) -> DataFrame:
    """(path, entry, changed) for the members of a set (path, position) after ordering (path, ord).

    Listed members get 1, 2, ... by the first place they are listed at; paths that are no
    members are ignored, and members that aren't listed lose their position.
    """
    checked("set", name)
    listed = order.groupBy("path").agg(F.min("ord").alias("ord")).join(members.select("path"), "path", "left_semi")
    ranks = listed.withColumn("rank", F.row_number().over(Window.orderBy("ord")).cast("bigint")).select("path", "rank")
    found = members.join(ranks, "path", "left")
    return found.select("path", set_entry(F.lit(name), F.col("rank")).alias("entry"), (~F.col("rank").eqNullSafe(F.col("position").cast("bigint"))).alias("changed"))


def reordered(items: DataFrame, ranks: DataFrame) -> DataFrame:
    """Items (path, pos) in a client's new order (path, rank): unknown ones last, ties as before."""
    return items.join(ranks, "path", "left").withColumn("new_pos", F.row_number().over(Window.orderBy(F.col("rank").asc_nulls_last(), "pos")).cast("bigint") - 1)


def moved_block(items: DataFrame, moving: DataFrame, before: int) -> DataFrame:
    """Items (path, pos) after pulling the moving paths out and putting them, in their order, before position before."""
    mine = moving.select("path").distinct().withColumn("__moves", F.lit(True))
    part = F.when(F.col("__moves").isNotNull(), 1).when(F.col("pos") < before, 0).otherwise(2)
    found = items.join(mine, "path", "left").withColumn("__part", part)
    return found.withColumn("new_pos", F.row_number().over(Window.orderBy("__part", "pos")).cast("bigint") - 1).drop("__part", "__moves")


def is_permutation(a: DataFrame, b: DataFrame) -> bool:
    """Whether two lists of paths have the same length, and all of b is in a."""
    return a.count() == b.count() and not b.join(a, "path", "left_anti").take(1)


def merged_lists(members: DataFrame, namespace: str) -> DataFrame:
    """(group_id, entries): the union of a group's lists (group_id, path, keeper, entry, ord), sorted; by name, the keeper's entry first."""
    named = members.withColumn("name", name_of(namespace, F.col("entry")))
    first = Window.partitionBy("group_id", "name").orderBy(F.desc("keeper"), "path", "ord")
    one = named.withColumn("k", F.row_number().over(first)).filter("k = 1")
    return one.groupBy("group_id").agg(F.sort_array(F.collect_list("entry")).alias("entries"))


def merged_buckets(members: DataFrame) -> DataFrame:
    """(group_id, plugin, version, tags): the keeper's bucket of each plugin, else the one of the greatest version, compared as text."""
    best = Window.partitionBy("group_id", "plugin").orderBy(F.desc("keeper"), F.desc("version"), "path")
    return members.withColumn("k", F.row_number().over(best)).filter("k = 1").select("group_id", "plugin", "version", "tags")


def merge_defaults(members: DataFrame) -> DataFrame:
    """What a merge dialog proposes for a group: the keeper's value, else the first that isn't null; the earliest capture."""
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(~F.col("keeper"), F.col("ord")))).alias(c)
    return members.groupBy("group_id").agg(*[first(c) for c in ("rating", "color_label")], F.min("date_taken").alias("date_taken"))


def merge_choices(members: DataFrame) -> DataFrame:
    """What a merge dialog lets a user choose from: a group's different places, and its user tags (group_id, ord, lat, lon, tags) in the order first seen."""
    place = F.when(F.col("lat").isNotNull(), F.concat_ws(" ", F.col("lat").cast("string"), F.col("lon").cast("string")))
    rows = members.select("group_id", "ord", place.alias("place"), "tags")
    places = rows.filter("place is not null").groupBy("group_id", "place").agg(F.min("ord").alias("at"))
    tags = rows.select("group_id", "ord", F.posexplode("tags").alias("k", "tag")).groupBy("group_id", "tag").agg(F.min(F.struct("ord", "k")).alias("at"))
    listed = lambda df, c, name: df.groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", c))), lambda x: x[c]).alias(name))
    none = F.array().cast("array<string>")
    out = rows.select("group_id").distinct().join(listed(places, "place", "places"), "group_id", "left").join(listed(tags, "tag", "tags"), "group_id", "left")
    return out.select("group_id", F.coalesce("places", none).alias("places"), F.coalesce("tags", none).alias("tags"))


def one_entry_per_set(entries: Column) -> Column:
    """The list with the first entry of each set, as a sidecar is written."""
    names = F.transform(entries, set_name)
    return F.filter(entries, lambda e, k: F.array_position(names, F.get(names, k)) == k + 1)
