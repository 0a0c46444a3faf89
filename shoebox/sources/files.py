"""Sources and sinks: folders of media, sidecar documents, the trash, settings."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions.scalars import capture_clock, file_name, iso6709, media_type, parent, positive_number, set_name, set_position, shown_size, trash_ms

#: Where sidecars lie beside their files, and the version that is understood.
SIDECAR_FOLDER, SIDECAR_SUFFIX, SCHEMA_VERSION = ".sidecars", ".json", 1
SIDECAR = """schema_version INT, file STRING, media_type STRING, created STRING, modified STRING,
 tags STRUCT<user: ARRAY<STRING>, set: ARRAY<STRING>, plugins: MAP<STRING, STRUCT<version: STRING, tags: ARRAY<STRING>>>>,
 meta STRUCT<core: STRUCT<rating: INT, date_rated: STRING, color_label: STRING, notes: STRING,
   media: STRUCT<width: INT, height: INT, duration_seconds: DOUBLE, codec: STRING, has_audio: BOOLEAN, fps: DOUBLE>,
   location: STRUCT<lat: DOUBLE, lon: DOUBLE, alt: DOUBLE>, date_added: STRING, last_viewed: STRING>, plugins: MAP<STRING, STRING>>"""
SETTINGS = {"default_filter": "", "companion_location": "beside"}


def relative(path: Column, root: str) -> Column:
    """A listed file's path below the root, whatever the scheme's spelling."""
    tail = "/" + root.split("://")[-1].strip("/") + "/"
    return F.substring(path, F.locate(tail, path) + len(tail), F.length(path))


def scan_media(spark: SparkSession, root: str) -> DataFrame:
    """path, media_type, file_size, mtime and mtime_ns of the media files below a folder, by lower-cased name.

    Contents are never read. Files in dot-folders and of unknown extensions are left out; a
    folder that can't be listed fails the scan, as a partial one would look like removals.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    rel = found.withColumn("rel", F.url_decode(F.regexp_replace(relative(F.col("path"), root), r"\+", "%2B")))
    kind = media_type(F.col("rel"))
    # micros since 1970 don't depend on the session's time zone
    kept = rel.filter(kind.isNotNull() & ~F.col("rel").rlike(r"(^|/)\.[^/]*/"))
    out = kept.select(F.col("rel").alias("path"), kind.alias("media_type"), F.col("length").alias("file_size"), F.unix_seconds("modificationTime").alias("mtime"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    return out.orderBy(F.lower(file_name(F.col("path"))), "path")


def sidecar_path(path: Column) -> Column:
    folder = F.coalesce(F.concat(parent(path), F.lit("/")), F.lit(""))
    return F.concat(folder, F.lit(f"{SIDECAR_FOLDER}/"), file_name(path), F.lit(SIDECAR_SUFFIX))


def media_of_sidecar(path: Column) -> Column:
    """The file that a sidecar belongs to; null for other paths."""
    match = F.regexp_extract(path, rf"^(.*?)\.sidecars/([^/]+)\{SIDECAR_SUFFIX}$", 0)
    return F.when(match != "", F.concat(F.regexp_extract(path, r"^(.*?)\.sidecars/", 1), F.regexp_extract(path, rf"\.sidecars/([^/]+)\{SIDECAR_SUFFIX}$", 1)))


def _depth(spark: SparkSession, root: str) -> int:
    """How many folders lie below each other in root, or more; only listings are read."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system, depth = path(root).getFileSystem(spark._jsc.hadoopConfiguration()), 0
    while system.globStatus(path(root.rstrip("/") + "/*" * (depth + 1))):
        depth += 1
    return depth


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(path, json) of all sidecars below root; the raw text keeps keys that aren't modelled.

    Sidecar folders are hidden ones, which Spark lists only where they are named.
    """
    levels = ",".join("*/" * k + SIDECAR_FOLDER for k in range(_depth(spark, root) + 1))
    try:
        found = spark.read.option("wholetext", "true").text(f"{root.rstrip('/')}/{{{levels}}}/*{SIDECAR_SUFFIX}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, json string")
    rows = found.select(media_of_sidecar(F.url_decode(F.regexp_replace(relative(F.col("_metadata.file_path"), root), r"\+", "%2B"))).alias("path"), F.col("value").alias("json"))
    return rows.filter("path is not null")


def parsed(sidecars: DataFrame) -> DataFrame:
    """(path, doc, bad): documents of (path, json); malformed or newer ones are marked bad and have no document."""
    doc = F.from_json("json", SIDECAR + ", malformed STRING", {"columnNameOfCorruptRecord": "malformed"})
    rows = sidecars.withColumn("doc", doc)
    bad = F.col("doc").isNull() | F.col("doc.malformed").isNotNull() | (F.coalesce(F.col("doc.schema_version"), F.lit(SCHEMA_VERSION)) > SCHEMA_VERSION)
    return rows.select("path", F.when(~bad, F.col("doc").dropFields("malformed")).alias("doc"), bad.alias("bad"))


def sidecar_tags(documents: DataFrame) -> DataFrame:
    """Tag rows (path, namespace, tag, position) of documents: user, set, then plugins; the first row of a key stays."""
    none = F.array().cast("array<string>")
    row = lambda space, tag, place: F.struct(space.alias("namespace"), tag.alias("tag"), place.cast("int").alias("position"))
    null = F.lit(None).cast("int")
    user = F.transform(F.coalesce("doc.tags.user", none), lambda t: row(F.lit("user"), t, null))
    sets = F.transform(F.coalesce("doc.tags.set", none), lambda t: row(F.lit("set"), set_name(t), set_position(t)))
    buckets = F.map_entries(F.coalesce("doc.tags.plugins", F.create_map().cast("map<string,struct<version:string,tags:array<string>>>")))
    plugins = F.flatten(F.transform(buckets, lambda b: F.transform(F.coalesce(b["value"]["tags"], none), lambda t: row(F.concat(F.lit("plugin."), b["key"]), t, null))))
    # all rows of a key come from one document, so nothing is shuffled
    rows = documents.filter("doc is not null").select("path", F.concat(user, sets, plugins).alias("all"))
    key = lambda t: F.struct(t["namespace"].alias("namespace"), t["tag"].alias("tag"))
    rows = rows.withColumn("keys", F.transform("all", key))
    first = F.filter("all", lambda t, k: F.array_position(F.col("keys"), key(t)) == k + 1)
    return rows.select("path", F.explode(first).alias("t")).select("path", "t.namespace", "t.tag", "t.position")


def companions(documents: DataFrame) -> DataFrame:
    """The values that the catalog mirrors from documents, one row a file."""
    core = "doc.meta.core."
    return documents.filter("doc is not null").select(
        "path", F.col(core + "rating").alias("rating"), F.col(core + "color_label").alias("color_label"), F.col(core + "date_rated").alias("date_rated"),
        F.col(core + "date_added").alias("date_added"), F.col(core + "last_viewed").alias("last_viewed"), F.col(core + "location.lat").alias("lat"), F.col(core + "location.lon").alias("lon"),
    )


def with_lists(sidecars: DataFrame, lists: DataFrame) -> DataFrame:
    """(path, json): sidecars with their user and set lists (path, namespace, entries) replaced and everything else as it was.

    Values are held as variants, so unknown keys and every type survive. Malformed sidecars stay as they are.
    """
    kind = "map<string,variant>"
    top = sidecars.withColumn("top", F.from_json("json", kind))
    top = top.withColumn("inner", F.coalesce(F.from_json(F.to_json(F.col("top")["tags"]), kind), F.create_map().cast(kind)))
    new = lists.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("namespace", F.parse_json(F.to_json("entries"))))).alias("new"))
    joined = top.join(new, "path", "left")
    inner = F.map_concat(F.map_filter("inner", lambda k, v: ~F.map_contains_key(F.col("new"), k)), F.col("new"))
    done = F.map_concat(F.map_filter("top", lambda k, v: k != "tags"), F.create_map(F.lit("tags"), F.parse_json(F.to_json(inner))))
    return joined.select("path", F.when(F.col("new").isNull() | F.col("top").isNull(), F.col("json")).otherwise(F.to_json(done)).alias("json"))


def write_sidecars(sidecars: DataFrame, folder: str) -> None:
    """Sidecars as JSON lines (path, json), committed as a whole by Spark."""
    sidecars.write.mode("overwrite").json(folder)


def trash_entries(listing: DataFrame) -> DataFrame:
    """(id, path, ms, size) of trashed files listed as '<ms>_<seq>/<path>', the newest first."""
    entry = F.substring_index("path", "/", 1)
    rows = listing.select(entry.alias("id"), F.regexp_replace("path", r"^[^/]*/", "").alias("path"), trash_ms(entry).alias("ms"), "size")
    return rows.filter("ms is not null").orderBy(F.desc("ms"), "path")


def load_settings(text: str | None) -> dict:
    """Two known keys; text that can't be read gives the defaults."""
    try:
        found = json.loads(text or "{}")
        return SETTINGS | {k: v for k, v in found.items() if k in SETTINGS and isinstance(v, str)}
    except (ValueError, AttributeError):
        return dict(SETTINGS)


_CONTAINER = """streams ARRAY<STRUCT<width: INT, height: INT, duration: STRING, tags: MAP<STRING, STRING>, side_data_list: ARRAY<STRUCT<rotation: STRING>>>>,
 format STRUCT<duration: STRING, tags: MAP<STRING, STRING>>"""


def container_facts(prober: DataFrame, zone: str = "UTC") -> DataFrame:
    """Facts (path, width, height, duration, taken, gps_lat, gps_lon) from a prober's JSON (path, json), of documents with a first stream that has a size.

    The turn is the first of the stream's side data, else its tag; the duration the stream's,
    else the container's; the place the first in order of keys that name a location and hold one.
    """
    rows = prober.withColumn("d", F.from_json("json", _CONTAINER)).withColumn("s", F.get("d.streams", F.lit(0))).filter("s.width > 0 AND s.height > 0")
    number = lambda c: F.trim(c).try_cast("double")
    turns = F.filter(F.transform(F.coalesce("s.side_data_list", F.array().cast("array<struct<rotation:string>>")), lambda x: number(x["rotation"])), lambda x: x.isNotNull())
    size = shown_size(F.col("s.width"), F.col("s.height"), F.coalesce(F.get(turns, F.lit(0)), number(F.element_at("s.tags", F.lit("rotate"))), F.lit(0.0)))
    tags = F.coalesce("d.format.tags", F.create_map().cast("map<string,string>"))
    named = F.array_sort(F.map_entries(F.map_filter(tags, lambda k, v: F.lower(k).contains("location"))))
    place = F.get(F.filter(F.transform(named, lambda e: iso6709(e["value"])), lambda x: x.isNotNull()), F.lit(0))
    taken = capture_clock(F.element_at(tags, F.lit("com.apple.quicktime.creationdate")), F.element_at(tags, F.lit("creation_time")), zone)
    return rows.select(
        "path", size["width"].alias("width"), size["height"].alias("height"), F.coalesce(positive_number(F.col("s.duration")), positive_number(F.col("d.format.duration"))).alias("duration"),
        taken.alias("taken"), place["lat"].alias("gps_lat"), place["lon"].alias("gps_lon"),
    )
