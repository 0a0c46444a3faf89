"""Catalog maintenance: every change is a function from old and new DataFrames to the table after it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.functions.scalars import rfc3339_seconds


class EmptyScan(ValueError):
    """A scan without files would remove a whole catalog; its folder is more likely to be away."""


def scan_upsert(media: DataFrame, scanned: DataFrame, now: int) -> DataFrame:
    """New files get date_added = now; known ones take type, size and time of the scan and keep everything else."""
    fresh = scanned.select("path", *[F.col(c).alias(f"__{c}") for c in ("media_type", "file_size", "mtime")], F.lit(True).alias("__seen"))
    old = media.withColumn("__known", F.lit(True))
    joined = old.join(fresh, "path", "full_outer")
    out = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in ("media_type", "file_size", "mtime")}
    out["date_added"] = F.when(F.col("__known").isNull(), F.lit(now).cast("bigint")).otherwise(F.col("date_added"))
    if "exif_read" in media.columns:
        out["exif_read"] = F.coalesce(F.col("exif_read"), F.lit(False))
    return joined.withColumns(out).select(*media.columns)


def prune_missing(tables: dict[str, DataFrame], scanned: DataFrame) -> dict[str, DataFrame]:
    """All tables by path without files that the scan didn't see; an empty scan of a catalog with files is refused."""
    if not scanned.take(1) and any(t.take(1) for t in tables.values()):
        raise EmptyScan
    return {name: t.join(scanned.select("path"), "path", "left_semi") for name, t in tables.items()}


def forget(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    return {name: t.join(gone.select("path"), "path", "left_anti") for name, t in tables.items()}


def probe_merge(media: DataFrame, probed: DataFrame) -> DataFrame:
    """What a header told wins where it told something; nothing is cleared. Every probed file counts as read."""
    facts = [c for c in probed.columns if c != "path"]
    new = probed.select("path", *[F.col(c).alias(f"__{c}") for c in facts], F.lit(True).alias("__read"))
    out: dict[str, Column] = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in facts}
    if "exif_read" in media.columns:
        out["exif_read"] = F.coalesce(F.col("__read"), F.col("exif_read"))
    return media.join(new, "path", "left").withColumns(out).select(*media.columns)


def mirror_companions(media: DataFrame, companions: DataFrame) -> DataFrame:
    """The catalog after reading companions (path, rating, color_label, date_rated, date_added, last_viewed, lat, lon), with what they lack.

    Rating and colour are the companion's, null clears; other values are its own where it has
    them. owes_* are values that only the catalog has; owed is whether to write back, which a
    lone date of rating doesn't cause.
    """
    own = companions.select(
        "path", F.lit(True).alias("__has"), F.col("rating").cast("int").alias("__rating"), F.lower(F.trim("color_label")).alias("__color"),
        rfc3339_seconds(F.col("date_rated")).alias("__rated"), rfc3339_seconds(F.col("date_added")).alias("__added"), rfc3339_seconds(F.col("last_viewed")).alias("__viewed"),
        F.col("lat").cast("double").alias("__lat"), F.col("lon").cast("double").alias("__lon"),
    )
    joined = media.join(own, "path", "left")
    has = F.col("__has").isNotNull()
    owes = {f"owes_{c}": F.when(has & F.col(f"__{k}").isNull(), F.col(c)) for c, k in (("last_rated", "rated"), ("date_added", "added"), ("last_viewed", "viewed"))}
    joined = joined.withColumns(owes)
    out = {c: F.when(has, F.col(f"__{k}")).otherwise(F.col(c)) for c, k in (("rating", "rating"), ("color_label", "color"))}
    out |= {c: F.coalesce(F.col(f"__{k}"), F.col(c)) for c, k in (("last_rated", "rated"), ("date_added", "added"), ("last_viewed", "viewed"), ("gps_lat", "lat"), ("gps_lon", "lon"))}
    out["owed"] = F.col("owes_date_added").isNotNull() | F.col("owes_last_viewed").isNotNull()
    return joined.withColumns(out).select(*media.columns, *owes, "owed")


def replace_tags(tags: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """The tag rows after files were indexed anew: all old rows of a changed path go."""
    return tags.join(changed.select("path"), "path", "left_anti").unionByName(fresh.select(*tags.columns))


def last_wins(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """Rows of new replace those of old with their key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the first in order."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("__k = 1").drop("__k")


def stale(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files whose fingerprint (mtime_ns, size) isn't the one they were indexed with."""
    known = indexed.select("path", F.struct("mtime_ns", "size").alias("__known"))
    return files.join(known, "path", "left").filter(~F.struct("mtime_ns", "size").eqNullSafe(F.col("__known"))).drop("__known")


def reprobe(media: DataFrame, reader_changed: bool) -> DataFrame:
    """After a new reader version, videos count as unread."""
    return media.withColumn("exif_read", F.when(F.col("media_type") == "video", F.lit(False)).otherwise(F.col("exif_read"))) if reader_changed else media


def pending_reads(media: DataFrame) -> DataFrame:
    return media.filter(~F.col("exif_read")).select("path")


def set_values(media: DataFrame, paths: DataFrame, values: dict[str, Column], now: int | None = None) -> DataFrame:
    """media with values set for the paths; a rating, cleared ones too, also stamps last_rated with now."""
    if "rating" in values and now is not None:
        values = values | {"last_rated": F.lit(now).cast("bigint")}
    if "color_label" in values:
        label = F.lower(F.trim(values["color_label"]))
        values = values | {"color_label": F.when(label != "", label)}
    mine = paths.select("path").distinct().withColumn("__mine", F.lit(True))
    out = {c: F.when(F.col("__mine").isNotNull(), v).otherwise(F.col(c)) for c, v in values.items()}
    return media.join(mine, "path", "left").withColumns(out).select(*media.columns)


def in_request_order(table: DataFrame, requested: list[str]) -> DataFrame:
    """The rows of requested paths with their place; paths that aren't there are skipped."""
    spark = table.sparkSession
    wanted = spark.createDataFrame([(p, k) for k, p in enumerate(requested)], "path string, ord bigint")
    return wanted.join(table, "path").orderBy("ord")


def lacking(media: DataFrame, tiers: DataFrame, tier: str, limit: int = 16) -> DataFrame:
    """The newest files without a thumbnail in a tier."""
    have = tiers.filter(F.col("tier") == tier).select("path")
    date = F.coalesce("date_taken", "mtime")
    return media.join(have, "path", "left_anti").select("path", date.alias("date")).orderBy(F.desc("date"), F.desc("path")).limit(limit)


def purge_expired(trash: DataFrame, now_ms: int, retention_s: int) -> DataFrame:
    """Trash entries (entry, ms, ...) that stay; no retention keeps all."""
    return trash if retention_s <= 0 else trash.filter(F.col("ms") >= now_ms - retention_s * 1000)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
