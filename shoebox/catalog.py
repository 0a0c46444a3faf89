"""A catalog as named DataFrames, with the commands a client has.

Reading commands return DataFrames. Changing ones return a new Catalog, whose tables are plans
over the old ones; commit() writes them. Tag lists live in the tag index: an entry's position
is a column, so edits are joins and filters on (path, namespace, tag).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.operators import duplicates, filtering, maintenance, tagging, tiers, views, vocabulary
from shoebox.plans.expressions import Expression
from shoebox.streaming import ingest


@dataclass(frozen=True)
class Catalog:
    """media and tags as in the schema; tiers and notes may be missing."""

    media: DataFrame
    tags: DataFrame
    tiers: DataFrame | None = None
    hashes: DataFrame | None = None
    extras: dict[str, DataFrame] = field(default_factory=dict)

    # reading

    def get_items(self, request: views.Request) -> tuple[DataFrame, DataFrame, str | None]:
        """Items with positions, their group headers, and the set whose order they are in; a set view has no headers."""
        rows = views.view(self.media, self.tags, request)
        members = self._set_of(request)
        return rows, views.headers(rows, "none" if members is not None else request.group), members

    def _set_of(self, request: views.Request) -> str | None:
        from shoebox.plans.parser import parse

        return parse(request.filter).sole_set() if request.filter.strip() else None

    def select_paths(self, text: str | Expression) -> DataFrame:
        return filtering.apply(self.media, self.tags, text).select("path").orderBy("path")

    def get_media_meta(self, path: str) -> tuple[DataFrame, DataFrame]:
        """One file's row, if there is one, and its tags."""
        return views.items(self.media.filter(F.col("path") == path)), vocabulary.tags_of(self.tags, path)

    def get_merge_candidates(self, paths: list[str]) -> DataFrame:
        return maintenance.in_request_order(self.media, paths)

    def get_all_thumbnail_tiers(self, path: str) -> DataFrame:
        return tiers.presence(self.tiers, path)

    def get_tier_totals(self) -> DataFrame:
        return tiers.totals(self.tiers)

    def counts(self) -> DataFrame:
        return vocabulary.tag_counts(self.tags)

    def autocomplete(self, text: str, namespace: str | None = None, limit: int = vocabulary.SUGGESTIONS) -> DataFrame:
        return vocabulary.suggest(self.counts(), text, namespace, limit)

    def list_tags(self, namespace: str) -> DataFrame:
        return vocabulary.tag_list(self.counts(), namespace)

    def paths_with_tags(self, wanted: list[str], namespace: str, limit: int = vocabulary.PREVIEW) -> DataFrame:
        return vocabulary.paths_with_tags(self.tags, wanted, namespace, limit)

    def find_duplicates(self, threshold: int = 8) -> DataFrame:
        return duplicates.groups(self.hashes, vocabulary.set_membership(self.tags), threshold)

    # tags

    def _members(self, namespace: str, *names: str) -> Column:
        return (F.col("namespace") == namespace) & F.col("tag").isin(*names)

    def add_tags(self, paths: DataFrame, names: list[str], namespace: str = "user") -> Catalog:
        """Every name to every path that the catalog has and that lacks it."""
        tagging.checked(namespace, *names)
        known = paths.select("path").distinct().join(self.media.select("path"), "path", "left_semi")
        rows = known.select("path", F.lit(namespace).alias("namespace"), F.explode(F.array_distinct(F.array(*[F.lit(n) for n in names]))).alias("tag"))
        fresh = rows.join(self.tags.select("path", "namespace", "tag"), ["path", "namespace", "tag"], "left_anti")
        return replace(self, tags=self.tags.unionByName(fresh.withColumn("position", F.lit(None).cast("int"))))

    def remove_tags(self, paths: DataFrame, names: list[str], namespace: str = "user") -> Catalog:
        tagging.checked(namespace, *names)
        gone = self.tags.filter(self._members(namespace, *names)).join(paths.select("path"), "path", "left_semi").select("path", "namespace", "tag")
        return replace(self, tags=self.tags.join(gone, ["path", "namespace", "tag"], "left_anti"))

    def delete_tag(self, name: str, namespace: str = "user") -> Catalog:
        tagging.checked(namespace, name)
        return replace(self, tags=self.tags.filter(~self._members(namespace, name)))

    def rename_tag(self, old: str, new: str, namespace: str = "user") -> Catalog:
        """Positions stay only if no file had the new name before."""
        taken = bool(self.tags.filter(self._members(namespace, new)).take(1))
        return self._folded([old], new, namespace, not taken)

    def merge_tags(self, sources: list[str], target: str, namespace: str = "user") -> Catalog:
        return self._folded(sources, target, namespace, False)

    def _folded(self, sources: list[str], target: str, namespace: str, keep: bool) -> Catalog:
        tagging.checked(namespace, *sources, target)
        sources = [s for s in sources if s != target]
        if not sources:
            return self
        mine = self._members(namespace, *sources)
        turned = self.tags.filter(mine).groupBy("path", "namespace").agg(F.min_by("position", "tag").alias("position")).withColumn("tag", F.lit(target))
        if not keep:
            turned = turned.withColumn("position", F.lit(None).cast("int"))
        rest = self.tags.filter(~mine)
        fresh = turned.join(rest.select("path", "namespace", "tag"), ["path", "namespace", "tag"], "left_anti")
        return replace(self, tags=rest.unionByName(fresh.select(*rest.columns)))

    def order_set(self, name: str, order: DataFrame) -> Catalog:
        """order: (path, ord). Members that it lists get places from 1 on, others lose theirs."""
        tagging.checked("set", name)
        mine = self._members("set", name)
        members = self.tags.filter(mine)
        listed = order.groupBy("path").agg(F.min("ord").alias("ord")).join(members.select("path"), "path", "left_semi")
        ranks = listed.select("path", F.row_number().over(Window.orderBy("ord")).alias("rank"))
        placed = members.drop("position").join(ranks, "path", "left").withColumnRenamed("rank", "position")
        return replace(self, tags=self.tags.filter(~mine).unionByName(placed.select(*self.tags.columns)))

    # values

    def set_rating(self, paths: DataFrame, rating: int | None, now: int) -> Catalog:
        return replace(self, media=maintenance.set_values(self.media, paths, {"rating": F.lit(rating).cast("int")}, now))

    def set_color_label(self, paths: DataFrame, label: str | None) -> Catalog:
        return replace(self, media=maintenance.set_values(self.media, paths, {"color_label": F.lit(label).cast("string")}))

    def record_view(self, paths: DataFrame, now: int) -> Catalog:
        return replace(self, media=maintenance.set_values(self.media, paths, {"last_viewed": F.lit(now).cast("bigint")}))

    def set_notes(self, path: str, text: str | None) -> Catalog:
        """Notes are a table (path, notes) of their own; blank ones are none."""
        clean = (text or "").strip() or None
        spark = self.media.sparkSession
        old = self.extras.get("notes", spark.createDataFrame([], "path string, notes string"))
        new = spark.createDataFrame([(path, clean)], "path string, notes string")
        return replace(self, extras=self.extras | {"notes": maintenance.last_wins(old, new).filter("notes is not null")})

    # files

    def _by_path(self) -> dict[str, DataFrame]:
        known = {"media": self.media, "tags": self.tags, "tiers": self.tiers, "hashes": self.hashes}
        return {k: v for k, v in known.items() if v is not None} | {f"extras.{k}": v for k, v in self.extras.items()}

    def _with(self, tables: dict[str, DataFrame]) -> Catalog:
        extras = {k.removeprefix("extras."): v for k, v in tables.items() if k.startswith("extras.")}
        return replace(self, **{k: v for k, v in tables.items() if not k.startswith("extras.")}, extras=extras)

    def scanned(self, scan: DataFrame, now: int) -> Catalog:
        """After a whole scan: files of it upserted, all others forgotten."""
        pruned = self._with(maintenance.prune_missing(self._by_path(), scan))
        return replace(pruned, media=maintenance.scan_upsert(pruned.media, scan, now))

    def trash_files(self, paths: DataFrame) -> Catalog:
        return self._with(maintenance.forget(self._by_path(), paths))

    def regenerate_thumbnail(self, paths: DataFrame) -> Catalog:
        """No tier keeps the paths, and their placeholders go."""
        media = maintenance.set_values(self.media, paths, {"thumbhash": F.lit(None).cast("binary")}) if "thumbhash" in self.media.columns else self.media
        return replace(self, media=media, tiers=self.tiers.join(paths.select("path"), "path", "left_anti"))

    def indexed(self, documents: DataFrame) -> Catalog:
        """After reading sidecar documents (path, doc): tags replaced, values mirrored."""
        from shoebox.sources import files

        read = documents.filter("doc is not null")
        mirrored = maintenance.mirror_companions(self.media, files.companions(read)).select(*self.media.columns)
        return replace(self, media=mirrored, tags=maintenance.replace_tags(self.tags, read, files.sidecar_tags(read)))

    def flushed(self, changes: DataFrame, scan: DataFrame, documents: DataFrame, now: int) -> Catalog:
        """After a burst of file changes (target, action): removals forgotten, additions upserted, sidecars read again."""
        of = lambda a: changes.filter(F.col("action") == a).select(F.col("target").alias("path"))
        kept = self._with(maintenance.forget(self._by_path(), of("remove")))
        added = replace(kept, media=maintenance.scan_upsert(kept.media, scan.join(of("add"), "path", "left_semi"), now))
        touched = of("sidecar").union(of("add")).distinct()
        return added.indexed(documents.join(touched, "path", "left_semi"))

    def commit(self, folder: str) -> None:
        """All tables as Parquet below a new folder; readers switch to it when it is whole."""
        for name, table in self._by_path().items():
            table.write.parquet(f"{folder}/{name}")

    classify = staticmethod(ingest.classify)
