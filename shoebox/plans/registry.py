"""The media-catalog queries by name, each beside its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.catalog import Catalog
from shoebox.fixtures import table, with_tables
from shoebox.functions import scalars as X
from shoebox.operators import answers, duplicates, filtering, layout, maintenance, places, tagging, tiers, views, vocabulary
from shoebox.plans import fixed
from shoebox.plans.parser import parse
from shoebox.sources import files
from shoebox.streaming import ingest

_Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, _Query] = {}
_ORACLE: dict[str, str] = {}
NOW = 1_700_000_000


def _add(name: str, query: _Query, sql: str | None = None, *tables: str) -> None:
    _QUERIES[name] = query
    if sql is not None:
        _ORACLE[name] = with_tables(sql, *tables) if tables else sql


def queries() -> dict[str, _Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest well-rated pictures with their place in the view and their month."""
    return _QUERIES["items_flagship"](spark, sf_dir)


# filters

FILTERS = {
    "tag_ns": "user::3-medium",
    "tag_any": "1-urgent",
    "tag_quoted": 'user::"4-not specified"',
    "tag_not": "NOT plugin.flags::A",
    "bool_mix": "(user::5-low OR plugin.flags::R) AND rating>=2",
    "nested_not": "NOT (user::5-low AND plugin.flags::N) OR type:gif",
    "rating_gte": "rating>=4",
    "not_rating_3vl": "NOT rating>=4",
    "not_color_3vl": "NOT color:red",
    "not_width_3vl": "NOT width>=1920",
    "not_date_3vl": "NOT date=1997",
    "color": "color:Green",
    "color_none": "color:none",
    "type": "type:Video",
    "date_year": "date=1997",
    "date_month_lte": "date<=1996-03",
    "date_day_gte": "added>=1998-07-15",
    "viewed": "viewed=1996-02",
    "size_units": "size>=1.5mb AND filesize<=300MB",
    "height": "height<=1080 AND width>=3000",
    "has_ns": "has::plugin.location",
    "has_any": "has::nothing",
    "bare_namespace": "set",
    "has_geo": "has:geo",
    "missing_geo": "missing:geo AND rating=5",
    "unknown_namespace": "nowhere::3-medium",
    "precedence": "type:gif OR type:video AND NOT rating<=2",
    "lower_keywords": "type:image and not (rating=1 or rating=2)",
}


def _filter(text: str) -> _Query:
    return lambda s, d: filtering.apply(table(s, d, "media"), table(s, d, "tags"), text).select("path", "rating", "color_label", "width", "file_size")


for _name, _text in FILTERS.items():
    _add(f"filter_{_name}", _filter(_text), f"SELECT path, rating, color_label, width, file_size FROM media m WHERE {filtering.sql(parse(_text))}", "media", "tags")

# views: positions make the order part of the result

_ITEM = "path, media_type, file_size, date, rating, width, height, duration, last_viewed, date_added, last_rated, color_label"
_ITEMS = "SELECT *, coalesce(date_taken, mtime) AS date FROM media"


def _view_sql(text: str, order: str, join: str = "", place: str = "") -> str:
    where = f" WHERE {filtering.sql(parse(text))}" if text else ""
    return f"SELECT {_ITEM.replace('path', 'm.path', 1)}, cast(row_number() OVER (ORDER BY {place}{order}, m.path) - 1 AS bigint) AS pos FROM ({_ITEMS}) m{join}{where}"


def _view(request: views.Request) -> _Query:
    return lambda s, d: views.view(table(s, d, "media"), table(s, d, "tags"), request).select(*views.ITEM_COLUMNS, "pos")


for _field, _column in views.SORT_COLUMNS.items():
    for _dir in ("asc", "desc"):
        _add(f"items_sort_{_field}_{_dir}", _view(views.Request(sort=_field, order=_dir)), _view_sql("", f"{_column if _column != 'path' else 'm.path'} {_dir} NULLS LAST"), "media", "tags")
_add("items_subsort", _view(views.Request("type:image", "rating", "desc", "size", "asc")), _view_sql("type:image", "rating DESC NULLS LAST, file_size ASC"), "media", "tags")
_add("items_set_view", _view(views.Request("(set::strip-6)", "size", "asc")), _view_sql("(set::strip-6)", "file_size ASC", " LEFT JOIN (SELECT path, position FROM tags WHERE namespace = 'set' AND tag = 'strip-6') p ON p.path = m.path", "position ASC NULLS LAST, "), "media", "tags")
_FLAGSHIP = views.Request("rating>=3 AND type:image", "date", "desc", group="month")


def _flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.view(table(spark, sf_dir, "media"), table(spark, sf_dir, "tags"), _FLAGSHIP)
    return rows.select("path", "media_type", "file_size", "date", "rating", "pos", views.period_label(F.col("date"), "month").alias("group_label"))


def _duck_label(seconds: str, unit: str) -> str:
    day = f"(date '1970-01-01' + cast(floor({seconds} / 86400.0) AS int))"
    text = {"day": f"monthname({day}) || ' ' || lpad(cast(day({day}) AS varchar), 2, ' ') || ', ' || year({day})", "month": f"monthname({day}) || ' ' || year({day})", "year": f"cast(year({day}) AS varchar)"}[unit]
    return f"CASE WHEN {seconds} IS NULL THEN 'Unknown date' ELSE {text} END"


_add("items_flagship", _flagship, f"SELECT path, media_type, file_size, date, rating, pos, {_duck_label('date', 'month')} AS group_label FROM ({_view_sql('rating>=3 AND type:image', 'date DESC')})", "media", "tags")

# group headers


def _headers(group: str, request: views.Request) -> _Query:
    return lambda s, d: views.headers(views.view(table(s, d, "media"), table(s, d, "tags"), request), group)


def _runs_sql(key: str, label: str, view: str) -> str:
    return (
        f"SELECT any_value({label}) AS label, min(pos) AS start_index, count(*) AS count FROM (SELECT *, sum(opens) OVER (ORDER BY pos) AS run FROM "
        f"(SELECT *, CASE WHEN pos = 0 OR ({key}) IS DISTINCT FROM lag({key}) OVER (ORDER BY pos) THEN 1 ELSE 0 END AS opens FROM ({view}))) GROUP BY run"
    )


_BY_DATE, _BY_SIZE = _view_sql("", "date DESC"), _view_sql("", "file_size DESC")
_DAY = "(date '1970-01-01' + cast(floor(date / 86400.0) AS int))"
for _unit, _key in (("day", _DAY), ("month", f"year({_DAY}) * 12 + month({_DAY})"), ("year", f"year({_DAY})")):
    _add(f"group_{_unit}", _headers(_unit, views.Request()), _runs_sql(_key, _duck_label("date", _unit), _BY_DATE), "media", "tags")
_add("group_day_by_size", _headers("day", views.Request(sort="size")), _runs_sql(_DAY, _duck_label("date", "day"), _BY_SIZE), "media", "tags")
_add("group_media_type", _headers("mediatype", views.Request()), _runs_sql("media_type", "CASE media_type WHEN 'image' THEN 'Images' WHEN 'video' THEN 'Videos' WHEN 'gif' THEN 'GIFs' ELSE media_type END", _BY_DATE), "media", "tags")
_SIZES = "CASE WHEN file_size < 1000000 THEN '< 1 MB' WHEN file_size < 10000000 THEN '1 - 10 MB' WHEN file_size < 100000000 THEN '10 - 100 MB' WHEN file_size < 1000000000 THEN '100 MB - 1 GB' ELSE '> 1 GB' END"
_add("group_size_range", _headers("size", views.Request()), f"SELECT {_SIZES} AS label, min(pos) AS start_index, count(*) AS count FROM ({_BY_DATE}) GROUP BY 1", "media", "tags")
_add("group_tag", _headers("tag", views.Request()), "SELECT '' AS label, cast(0 AS bigint) AS start_index, cast(0 AS bigint) AS count WHERE false")

# scroll markers


def _markers(field: str, order: str) -> _Query:
    return lambda s, d: views.markers(views.view(table(s, d, "media"), table(s, d, "tags"), views.Request(sort=field, order=order)), field)


def _thin(marks: str) -> str:
    return f"SELECT \"at\", label FROM (SELECT *, row_number() OVER (ORDER BY \"at\") - 1 AS k, count(*) OVER () AS n FROM ({marks})) WHERE k % greatest(1, cast(ceil(n / 15.0) AS bigint)) = 0"


def _change_sql(view: str, key: str, label: str, where: str = "true") -> str:
    return f"SELECT pos AS \"at\", {label} AS label FROM (SELECT *, lag({key}) OVER (ORDER BY pos) AS before, row_number() OVER (ORDER BY pos) AS nth FROM ({view}) WHERE {where}) WHERE nth = 1 OR before IS DISTINCT FROM ({key})"


_add("scroll_markers_date", _markers("date", "desc"), _thin(_change_sql(_BY_DATE, f"year({_DAY}) * 12 + month({_DAY})", f"strftime({_DAY}, '%b %Y')", "date <> 0")), "media", "tags")
_LETTER = "upper(substr(split_part(path, '/', -1), 1, 1))"
_add("scroll_markers_name", _markers("name", "asc"), _thin(_change_sql(_view_sql("", "m.path"), _LETTER, _LETTER, f"{_LETTER} <> ''")), "media", "tags")
_add("scroll_markers_rating", _markers("rating", "desc"), _thin(_change_sql(_view_sql("", "rating DESC NULLS LAST"), "coalesce(rating, 0)", "CASE WHEN coalesce(rating, 0) = 0 THEN 'Unrated' ELSE repeat('★', rating) END")), "media", "tags")
_STEPS = ", ".join(f"({k}, {s}, '{label}')" for k, (s, label) in enumerate(zip(views.SIZE_STEPS, ("100 KB", "500 KB", "1.0 MB", "5.0 MB", "10.0 MB", "50.0 MB", "100.0 MB"))))
_add(
    "scroll_markers_size",
    _markers("size", "asc"),
    f"WITH v AS ({_view_sql('', 'file_size ASC')}), f AS (SELECT k, label, min(pos) AS first FROM (VALUES {_STEPS}) s(k, size, label) JOIN v ON file_size >= size GROUP BY k, label) "
    'SELECT "at", label FROM (SELECT max(first - k) OVER (ORDER BY k) + k AS "at", label FROM f) WHERE "at" < (SELECT count(*) FROM v)',
    "media", "tags",
)



def _justified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.view(table(spark, sf_dir, "media"), table(spark, sf_dir, "tags"), views.Request("type:image"))
    return layout.rows(rows, views.headers(rows, "month"), 1200.0, 180.0)


_add("justified_rows", _justified)  # each row depends on the one before it, which SQL doesn't express well

# vocabulary

_COUNTS = "SELECT namespace, tag, count(*) AS count FROM tags GROUP BY ALL"
_counts = lambda s, d: vocabulary.tag_counts(table(s, d, "tags"))
_add("tag_counts", _counts, _COUNTS, "tags")
_add("tag_list", lambda s, d: vocabulary.tag_list(_counts(s, d), "user"), f"SELECT * FROM ({_COUNTS}) WHERE namespace = 'user'", "tags")
_add("namespace_totals", lambda s, d: vocabulary.namespace_totals(_counts(s, d)), "SELECT namespace, count(*) AS count FROM tags GROUP BY ALL", "tags")
_add("tag_list_filtered", lambda s, d: vocabulary.filtered_list(_counts(s, d), "STRIP-1", "name"), f"SELECT * FROM ({_COUNTS}) WHERE contains(lower(tag), 'strip-1')", "tags")
_add("most_count", lambda s, d: vocabulary.most_count(_counts(s, d)), f"SELECT greatest(coalesce(max(count), 1), 1) AS most FROM ({_COUNTS})", "tags")


def _score_sql(column: str, needle: str) -> str:
    if not needle:
        return "cast(0 AS bigint)"
    chars = ".*".join(c if c.isalnum() else f"\\{c}" for c in needle)
    return (
        f"cast(CASE WHEN {column} = '{needle}' THEN 1000 WHEN starts_with({column}, '{needle}') THEN 600 - least(strlen({column}), 100) "
        f"WHEN contains({column}, '{needle}') THEN 200 - least(strlen(substr({column}, 1, strpos({column}, '{needle}') - 1)), 200) "
        f"WHEN regexp_matches({column}, '{chars}', 's') THEN 50 END AS bigint)"
    )


def _suggest_sql(needle: str, limit: int) -> str:
    return (
        f"WITH c AS ({_COUNTS}), s AS (SELECT *, {_score_sql('lower(tag)', needle)} AS score FROM c), "
        f"t AS (SELECT namespace, cast(sum(count) AS bigint) AS count, {_score_sql('lower(namespace)', needle)} + 50 AS score FROM c GROUP BY namespace) "
        "SELECT * FROM (SELECT '' AS namespace, tag, cast(sum(count) AS bigint) AS count, max(score) AS score FROM s WHERE score IS NOT NULL GROUP BY tag "
        f"UNION ALL SELECT '_namespace', namespace, count, score FROM t WHERE score IS NOT NULL) ORDER BY score DESC, count DESC, tag, namespace LIMIT {limit}"
    )


for _case, _needle, _limit in (("prefix", "st", 20), ("substring", "rip-1", 20), ("subsequence", "sp3", 20), ("exact", "a", 5), ("empty", "", 20), ("namespace", "plu", 20), ("case", "Uni", 20)):
    _add(f"suggest_{_case}", lambda s, d, n=_needle, k=_limit: vocabulary.suggest(_counts(s, d), n, None, k), _suggest_sql(_needle.lower(), _limit), "tags")
_add(
    "paths_with_tags_capped",
    lambda s, d: vocabulary.paths_with_tags(table(s, d, "tags"), ["5-low", "1-urgent"], "user", 120),
    "SELECT path, place FROM (SELECT path, min(CASE tag WHEN '5-low' THEN 1 ELSE 2 END)::bigint AS place FROM tags WHERE namespace = 'user' AND tag IN ('5-low', '1-urgent') GROUP BY path) ORDER BY place, path LIMIT 120",
    "tags",
)
_add("paths_with_tag", lambda s, d: vocabulary.paths_with_tag(table(s, d, "tags"), "set", "strip-6"), "SELECT path FROM tags WHERE namespace = 'set' AND tag = 'strip-6'", "tags")
_PATH = "(SELECT min(path) FROM tags WHERE namespace = 'set')"


def _one_path(spark: SparkSession, sf_dir: str) -> str:
    return table(spark, sf_dir, "tags").filter("namespace = 'set'").agg(F.min("path")).first()[0]


_add("tags_of_file", lambda s, d: vocabulary.tags_of(table(s, d, "tags"), _one_path(s, d)), f"SELECT namespace, tag FROM tags WHERE path = {_PATH}", "tags")
_add("set_membership", lambda s, d: vocabulary.set_membership(table(s, d, "tags")), "SELECT path, tag FROM tags WHERE namespace = 'set'", "tags")
_add(
    "tags_by_namespace",
    lambda s, d: vocabulary.by_namespace(table(s, d, "tags")).select("path", "namespace", "place", F.array_join("tags", ",").alias("tags")),
    "SELECT path, namespace, cast(CASE WHEN namespace = 'user' THEN 0 ELSE 1 END AS int) AS place, string_agg(tag, ',' ORDER BY tag) AS tags FROM tags GROUP BY ALL",
    "tags",
)


def _detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _one_path(spark, sf_dir)
    tags = vocabulary.tags_of(table(spark, sf_dir, "tags"), path).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("::", "namespace", "tag"))), ",").alias("tags"))
    return views.items(table(spark, sf_dir, "media").filter(F.col("path") == path)).select("path", "date", "rating", "file_size").crossJoin(tags)


_add("media_detail", _detail, f"SELECT m.path, coalesce(date_taken, mtime) AS date, rating, file_size, (SELECT string_agg(namespace || '::' || tag, ',' ORDER BY namespace || '::' || tag) FROM tags t WHERE t.path = m.path) AS tags FROM media m WHERE path = {_PATH}", "media", "tags")
_ASKED = ["album3/7.mp4", "nowhere.jpg", "album1/1.jpg", *[f"album{k % 12}/{k}.jpg" for k in range(0, 400, 10)]]
_add(
    "merge_candidates",
    lambda s, d: maintenance.in_request_order(table(s, d, "media").select("path", "rating", "file_size"), _ASKED),
    "SELECT m.path, ord, rating, file_size FROM media m JOIN (SELECT unnest(" + repr(_ASKED) + f") AS path, cast(unnest(range({len(_ASKED)})) AS bigint) AS ord) r ON r.path = m.path",
    "media",
)

# maintenance

_SCAN = "SELECT path, media_type, file_size + 7 AS file_size, mtime + 1 AS mtime FROM media WHERE file_size % 4 <> 0 UNION ALL SELECT 'new/' || path, media_type, file_size, mtime FROM media WHERE file_size % 10 = 0"


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = table(spark, sf_dir, "media")
    kept = media.filter("file_size % 4 <> 0").select("path", "media_type", (F.col("file_size") + 7).alias("file_size"), (F.col("mtime") + 1).alias("mtime"))
    return kept.union(media.filter("file_size % 10 = 0").select(F.concat(F.lit("new/"), "path"), "media_type", "file_size", "mtime"))


_add(
    "scan_upsert",
    lambda s, d: maintenance.scan_upsert(table(s, d, "media"), _scan(s, d), NOW).select("path", "media_type", "file_size", "mtime", "date_added", "rating"),
    f"WITH sc AS ({_SCAN}) SELECT coalesce(sc.path, m.path) AS path, coalesce(sc.media_type, m.media_type) AS media_type, coalesce(sc.file_size, m.file_size) AS file_size, coalesce(sc.mtime, m.mtime) AS mtime, CASE WHEN m.path IS NULL THEN {NOW} ELSE m.date_added END AS date_added, m.rating FROM media m FULL JOIN sc ON sc.path = m.path",
    "media",
)
_add("prune_missing", lambda s, d: maintenance.prune_missing({"tags": table(s, d, "tags")}, _scan(s, d))["tags"], f"WITH sc AS ({_SCAN}) SELECT * FROM tags WHERE path IN (SELECT path FROM sc)", "media", "tags")
_add("forget_paths", lambda s, d: maintenance.forget({"tags": table(s, d, "tags")}, table(s, d, "media").filter("media_type = 'gif'"))["tags"], "SELECT * FROM tags WHERE path NOT IN (SELECT path FROM media WHERE media_type = 'gif')", "media", "tags")


def _probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "media").filter("file_size % 3 = 0").selectExpr("path", "CASE WHEN file_size % 2 = 0 THEN 111 END AS width", "CASE WHEN file_size % 5 = 0 THEN 222 END AS height", "cast(NULL AS double) AS duration")


_add(
    "probe_merge",
    lambda s, d: maintenance.probe_merge(table(s, d, "media"), _probed(s, d)).select("path", "width", "height", "duration", "exif_read"),
    "SELECT path, CASE WHEN file_size % 3 = 0 AND file_size % 2 = 0 THEN 111 ELSE width END AS width, CASE WHEN file_size % 3 = 0 AND file_size % 5 = 0 THEN 222 ELSE height END AS height, duration, file_size % 3 = 0 OR exif_read AS exif_read FROM media",
    "media",
)
_documents = lambda s, d: files.parsed(table(s, d, "sidecars"))
_CORE = "SELECT path, cast(json_extract_string(json, '$.meta.core.rating') AS int) AS rating, lower(trim(json_extract_string(json, '$.meta.core.color_label'))) AS color, epoch(cast(json_extract_string(json, '$.meta.core.date_rated') AS timestamptz))::bigint AS rated, epoch(cast(json_extract_string(json, '$.meta.core.date_added') AS timestamptz))::bigint AS added FROM sidecars WHERE path NOT LIKE 'album3/%'"
_add(
    "mirror_companion",
    lambda s, d: maintenance.mirror_companions(table(s, d, "media"), files.companions(_documents(s, d)).filter("path NOT LIKE 'album3/%'")).select("path", "rating", "color_label", "last_rated", "date_added", "last_viewed", "owes_date_added", "owes_last_viewed", "owed"),
    f"WITH c AS ({_CORE}) SELECT m.path, CASE WHEN c.path IS NULL THEN m.rating ELSE c.rating END AS rating, CASE WHEN c.path IS NULL THEN m.color_label ELSE c.color END AS color_label, coalesce(c.rated, m.last_rated) AS last_rated, coalesce(c.added, m.date_added) AS date_added, m.last_viewed, "
    "CASE WHEN c.path IS NOT NULL AND c.added IS NULL THEN m.date_added END AS owes_date_added, CASE WHEN c.path IS NOT NULL THEN m.last_viewed END AS owes_last_viewed, "
    "(c.path IS NOT NULL AND c.added IS NULL AND m.date_added IS NOT NULL) OR (c.path IS NOT NULL AND m.last_viewed IS NOT NULL) AS owed FROM media m LEFT JOIN c ON c.path = m.path",
    "media", "sidecars",
)
_EXPLODED = (
    "SELECT path, 'user' AS namespace, unnest(CAST(json_extract(json, '$.tags.user') AS varchar[])) AS tag, cast(NULL AS int) AS position FROM sidecars "
    "UNION ALL SELECT path, 'set', regexp_extract(e, '^(.*?)(::[0-9]+)?$', 1), try_cast(regexp_extract(e, '::([0-9]+)$', 1) AS int) FROM (SELECT path, unnest(CAST(json_extract(json, '$.tags.set') AS varchar[])) AS e FROM sidecars) "
    "UNION ALL SELECT path, 'plugin.flags', unnest(CAST(json_extract(json, '$.tags.plugins.flags.tags') AS varchar[])), cast(NULL AS int) FROM sidecars"
)
_SPOILED = "CASE length(path) % 5 WHEN 0 THEN substr(json, 1, length(json) - 1) WHEN 1 THEN '{not json' ELSE json END"
_add(
    "sidecar_bad",
    lambda s, d: files.parsed(table(s, d, "sidecars").withColumn("json", F.expr(_SPOILED))).select("path", "bad", F.col("doc").isNull().alias("skipped"), F.col("doc.meta.core.rating").alias("rating")),
    "SELECT path, length(path) % 5 < 2 AS bad, length(path) % 5 < 2 AS skipped, CASE WHEN length(path) % 5 >= 2 THEN cast(json_extract_string(json, '$.meta.core.rating') AS int) END AS rating FROM sidecars",
    "sidecars",
)
_EXTENDED = """concat('{"created":"2024-02-03T04:05:06Z","file":"2024.jpg","odd":"true [x] \\\\"q\\\\"","own":{"k":[1,2.5,null]},', substr(json, 2))"""
_add(
    "sidecar_rewrite",
    lambda s, d: files.with_lists(table(s, d, "sidecars").withColumn("json", F.expr(_EXTENDED)), table(s, d, "sidecars").select("path", F.lit("user").alias("namespace"), F.array(F.lit("new"), F.col("path")).alias("entries"))).select(
        "path", *[F.get_json_object("json", f"$.{k}").alias(n) for k, n in (("created", "created"), ("file", "file"), ("odd", "odd"), ("own", "own"), ("meta.core.rating", "rating"), ("tags.user[1]", "second"), ("tags.set[0]", "first_set"))]
    ),
    "SELECT path, '2024-02-03T04:05:06Z' AS created, '2024.jpg' AS file, 'true [x] \"q\"' AS odd, '{\"k\":[1,2.5,null]}' AS own, json_extract_string(json, '$.meta.core.rating') AS rating, path AS second, json_extract_string(json, '$.tags.set[0]') AS first_set FROM sidecars",
    "sidecars",
)
_add("sidecar_explode", lambda s, d: files.sidecar_tags(_documents(s, d)), _EXPLODED, "sidecars")
_add(
    "replace_tags",
    lambda s, d: maintenance.replace_tags(table(s, d, "tags"), table(s, d, "sidecars").filter("path LIKE 'album1/%'"), files.sidecar_tags(_documents(s, d).filter("path LIKE 'album1/%'"))),
    f"SELECT * FROM tags WHERE path NOT LIKE 'album1/%' UNION ALL SELECT * FROM ({_EXPLODED}) WHERE path LIKE 'album1/%'",
    "tags", "sidecars",
)
_add(
    "stale_fingerprints",
    lambda s, d: maintenance.stale(table(s, d, "media").selectExpr("path", "mtime * 1000 AS mtime_ns", "file_size AS size"), table(s, d, "media").filter("file_size % 5 <> 0").selectExpr("path", "mtime * 1000 AS mtime_ns", "file_size - file_size % 2 AS size")),
    "SELECT path, mtime * 1000 AS mtime_ns, file_size AS size FROM media WHERE file_size % 5 = 0 OR file_size % 2 <> 0",
    "media",
)
_add("pending_reads", lambda s, d: maintenance.pending_reads(table(s, d, "media")), "SELECT path FROM media WHERE NOT exif_read", "media")
_add("reprobe_videos", lambda s, d: maintenance.reprobe(table(s, d, "media"), True).select("path", "exif_read"), "SELECT path, exif_read AND media_type <> 'video' AS exif_read FROM media", "media")
_add(
    "set_rating",
    lambda s, d: maintenance.set_values(table(s, d, "media"), table(s, d, "media").filter("media_type = 'gif'"), {"rating": F.lit(None).cast("int"), "color_label": F.lit("  Blue ")}, NOW).select("path", "rating", "color_label", "last_rated"),
    f"SELECT path, CASE WHEN media_type <> 'gif' THEN rating END AS rating, CASE WHEN media_type = 'gif' THEN 'blue' ELSE color_label END AS color_label, CASE WHEN media_type = 'gif' THEN {NOW} ELSE last_rated END AS last_rated FROM media",
    "media",
)
_add("geotagged", lambda s, d: table(s, d, "media").filter("gps_lat IS NOT NULL").select("path", "gps_lat", "gps_lon"), "SELECT path, gps_lat, gps_lon FROM media WHERE gps_lat IS NOT NULL", "media")

# edits of tag lists

_LISTS = "SELECT path, list(CASE WHEN position IS NULL THEN tag ELSE tag || '::' || position END ORDER BY tag) AS entries FROM (SELECT path, tag, position FROM tags WHERE namespace = 'set' UNION ALL SELECT path, 'second' AS tag, cast(file_size % 9 AS int) FROM media WHERE file_size % 2 = 0) GROUP BY path"


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "tags").filter("namespace = 'set'").select("path", "tag", "position")
    rows = rows.union(table(spark, sf_dir, "media").filter("file_size % 2 = 0").selectExpr("path", "'second'", "cast(file_size % 9 AS int)"))
    entry = F.struct("tag", X.set_entry(F.col("tag"), F.col("position")).alias("entry"))
    return rows.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["entry"]).alias("entries"))


def _edited(change: Callable) -> _Query:
    return lambda s, d: tagging.edit(_lists(s, d), change(F.col("entries"))).select("path", F.array_join("after", "|").alias("after"), "changed")


def _edit_sql(after: str) -> str:
    return f"WITH l AS ({_LISTS}), e AS (SELECT path, entries, {after} AS done FROM l) SELECT path, array_to_string(done, '|') AS after, done IS DISTINCT FROM entries AS changed FROM e"


_NAME = "regexp_extract({}, '^(.*?)(::[0-9]+)?$', 1)"
_HAS = f"len(list_filter(entries, lambda e: {_NAME.format('e')} = '{{}}')) > 0"
_add("tag_add", _edited(lambda e: tagging.added(e, "set", ["second", "third"])), _edit_sql(f"list_concat(CASE WHEN {_HAS.format('second')} THEN entries ELSE list_append(entries, 'second') END, ['third'])"), "tags", "media")
_add("tag_remove", _edited(lambda e: tagging.removed(e, "set", ["second"])), _edit_sql(f"list_filter(entries, lambda e: {_NAME.format('e')} <> 'second')"), "tags", "media")
_add("tag_rename", _edited(lambda e: tagging.folded(e, "set", ["second"], "other", True)), _edit_sql("list_transform(entries, lambda e: regexp_replace(e, '^second(::|$)', 'other\\1'))"), "tags", "media")
_add("tag_merge", _edited(lambda e: tagging.folded(e, "set", ["second"], "strip-6", False)), _edit_sql(f"CASE WHEN {_HAS.format('strip-6')} THEN list_filter(entries, lambda e: {_NAME.format('e')} <> 'second') ELSE list_transform(entries, lambda e: CASE WHEN {_NAME.format('e')} = 'second' THEN 'strip-6' ELSE e END) END"), "tags", "media")


def _order_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "tags").filter("namespace = 'set' AND tag = 'strip-6'").select("path", "position")
    order = table(spark, sf_dir, "media").filter("file_size % 3 <> 0").selectExpr("path", "file_size * 1000 + mtime % 1000 AS ord")
    return tagging.order_set(members, order, "strip-6")


_add(
    "order_set",
    _order_set,
    "WITH mem AS (SELECT path, position FROM tags WHERE namespace = 'set' AND tag = 'strip-6'), r AS (SELECT m.path, row_number() OVER (ORDER BY file_size * 1000 + mtime % 1000) AS k FROM media m JOIN mem ON mem.path = m.path WHERE file_size % 3 <> 0) "
    "SELECT mem.path, CASE WHEN k IS NULL THEN 'strip-6' ELSE 'strip-6::' || k END AS entry, k IS DISTINCT FROM position AS changed FROM mem LEFT JOIN r ON r.path = mem.path",
    "tags", "media",
)


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.view(table(spark, sf_dir, "media"), table(spark, sf_dir, "tags"), views.Request("type:gif", "size", "asc")).select("path", "pos", "file_size")


_GIFS = _view_sql("type:gif", "file_size ASC")
_add(
    "move_block",
    lambda s, d: tagging.moved_block(_listed(s, d), _listed(s, d).filter("file_size % 3 = 0"), 10).select("path", "pos", "new_pos"),
    f"SELECT path, pos, cast(row_number() OVER (ORDER BY CASE WHEN file_size % 3 = 0 THEN 1 WHEN pos < 10 THEN 0 ELSE 2 END, pos) - 1 AS bigint) AS new_pos FROM ({_GIFS})",
    "media", "tags",
)
_add(
    "client_reorder",
    lambda s, d: tagging.reordered(_listed(s, d), _listed(s, d).filter("file_size % 2 = 0").selectExpr("path", "file_size % 7 AS rank")).select("path", "pos", "new_pos"),
    f"SELECT path, pos, cast(row_number() OVER (ORDER BY CASE WHEN file_size % 2 = 0 THEN file_size % 7 END NULLS LAST, pos) - 1 AS bigint) AS new_pos FROM ({_GIFS})",
    "media", "tags",
)

# thumbnails and caches

_BUDGETS = {"j": 1000, "jm": 40_000_000, "jh": 20_000}
_add("tier_totals", lambda s, d: tiers.totals(table(s, d, "tiers")), "SELECT t.tier, cast(coalesce(sum(byte_len), 0) AS bigint) AS bytes FROM (VALUES ('js'), ('j'), ('jm'), ('jh')) t(tier) LEFT JOIN tiers ON tiers.tier = t.tier GROUP BY t.tier", "tiers")
_add(
    "tier_evict",
    lambda s, d: tiers.evicted(table(s, d, "tiers"), _BUDGETS),
    "WITH b(tier, budget) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _BUDGETS.items()) + "), r AS (SELECT t.tier, path, budget, sum(byte_len) OVER (PARTITION BY t.tier ORDER BY accessed_at DESC, path DESC ROWS UNBOUNDED PRECEDING) AS running, sum(byte_len) OVER (PARTITION BY t.tier) AS total FROM tiers t JOIN b ON b.tier = t.tier) SELECT tier, path FROM r WHERE running > budget AND total > 1.25 * budget",
    "tiers",
)
_add("tier_missing_topk", lambda s, d: maintenance.lacking(table(s, d, "media"), table(s, d, "tiers"), "j"), "SELECT path, coalesce(date_taken, mtime) AS date FROM media WHERE path NOT IN (SELECT path FROM tiers WHERE tier = 'j') ORDER BY date DESC, path DESC LIMIT 16", "media", "tiers")
_add(
    "tier_touch",
    lambda s, d: tiers.touched(table(s, d, "tiers"), table(s, d, "tiers").filter("byte_len % 2 = 0").selectExpr("tier", "path", "accessed_at + byte_len % 50 - 20 AS ts")).select("tier", "path", "accessed_at"),
    "SELECT tier, path, CASE WHEN byte_len % 2 = 0 THEN greatest(accessed_at, accessed_at + byte_len % 50 - 20) ELSE accessed_at END AS accessed_at FROM tiers",
    "tiers",
)
_ONE_THUMB = "SELECT min(path) FROM tiers WHERE tier = 'jm'"
_add(
    "tier_presence",
    lambda s, d: tiers.presence(table(s, d, "tiers"), table(s, d, "tiers").filter("tier = 'jm'").agg(F.min("path")).first()[0]),
    f"SELECT t.tier, byte_len IS NOT NULL AS present, coalesce(byte_len, 0) AS byte_len FROM (VALUES ('js'), ('j'), ('jm'), ('jh')) t(tier) LEFT JOIN (SELECT * FROM tiers WHERE path = ({_ONE_THUMB})) p ON p.tier = t.tier",
    "tiers",
)
_GALLERIES = "SELECT split_part(path, '/', 1) AS gallery, sum(byte_len)::bigint AS bytes, max(accessed_at) AS last_opened, split_part(path, '/', 1) = 'album4' AS locked FROM tiers GROUP BY 1"
_galleries = lambda s, d: tiers.survey(table(s, d, "tiers").selectExpr("substring_index(path, '/', 1) AS gallery", "byte_len AS bytes", "accessed_at AS last_opened")).withColumn("locked", F.col("gallery") == "album4")
_add("cache_survey", lambda s, d: _galleries(s, d).select("gallery", "bytes", "last_opened"), f"SELECT gallery, bytes, last_opened FROM ({_GALLERIES})", "tiers")
_add(
    "cold_gallery_evict",
    lambda s, d: tiers.pruned(_galleries(s, d), 60_000, "album2"),
    f"WITH g AS ({_GALLERIES}) SELECT gallery, bytes FROM (SELECT *, (SELECT sum(bytes) FROM g) - coalesce(sum(bytes) OVER (ORDER BY last_opened, gallery DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g WHERE NOT locked AND gallery <> 'album2') WHERE before > 60000",
    "tiers",
)

# duplicates

_PAIRS = "SELECT a.path AS a, b.path AS b, cast(bit_count(xor(a.{c}, b.{c})) AS int) AS distance FROM phashes a JOIN phashes b ON a.ord < b.ord WHERE bit_count(xor(a.{c}, b.{c})) <= {t}"
_APART = " AND NOT EXISTS (SELECT 1 FROM phash_sets x JOIN phash_sets y ON x.tag = y.tag WHERE x.path = a.path AND y.path = b.path)"
for _t in (0, 3):
    _add(f"dup_edges_{_t}", lambda s, d, t=_t: duplicates.edges(table(s, d, "phashes"), None, t, "coarse", 16), _PAIRS.format(c="coarse", t=_t), "phashes")
for _t in (8, 14):
    _add(f"dup_edges_{_t}", lambda s, d, t=_t: duplicates.edges(table(s, d, "phashes"), None, t, "phash", 60), _PAIRS.format(c="phash", t=_t), "phashes")
_add("dup_edges_sets", lambda s, d: duplicates.edges(table(s, d, "phashes"), table(s, d, "phash_sets"), 1, "coarse", 16), _PAIRS.format(c="coarse", t=1) + _APART, "phashes", "phash_sets")
_REACHED = (
    f"WITH RECURSIVE p AS ({_PAIRS.format(c='coarse', t=1)}{_APART}), e AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p), "
    "reach(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u), g AS (SELECT u AS path, least(u, min(v)) AS group_id FROM reach GROUP BY u) "
)
_groups = lambda s, d: duplicates.groups(table(s, d, "phashes"), table(s, d, "phash_sets"), 1, "coarse", 16)
_ORDERED = "row_number() OVER (PARTITION BY group_id ORDER BY coalesce(cast(width AS bigint) * height, 0) DESC, file_size, ord DESC) = 1 AS best"
_add("dup_groups", lambda s, d: _groups(s, d).drop("ord"), _REACHED + f"SELECT group_id, g.path, arg_min(coarse, ord) OVER (PARTITION BY group_id) AS hash, {_ORDERED} FROM g JOIN phashes p ON p.path = g.path", "phashes", "phash_sets")
_add("dup_best", lambda s, d: _groups(s, d).filter("best").select("group_id", "path"), _REACHED + f"SELECT group_id, path FROM (SELECT group_id, g.path, {_ORDERED} FROM g JOIN phashes p ON p.path = g.path) WHERE best", "phashes", "phash_sets")
_add("unhashed", lambda s, d: duplicates.unhashed(table(s, d, "phashes").selectExpr("path", "CASE WHEN ord % 4 <> 0 THEN phash END AS phash"), 16), "SELECT path FROM phashes WHERE ord % 4 = 0 ORDER BY path LIMIT 16", "phashes")

_MEMBERS = "SELECT o_custkey AS group_id, {p} AS path, o_orderkey % 7 = 0 AS keeper, o_orderkey AS ord".replace("{p}", "'f' || cast(o_orderkey AS string)")


def _merge_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.selectExpr("o_custkey AS group_id", "'f' || o_orderkey AS path", "o_orderkey % 7 = 0 AS keeper", "o_orderkey AS ord", "'set-' || (o_orderkey % 4) || CASE WHEN o_orderkey % 3 = 0 THEN '::' || (o_orderkey % 50) ELSE '' END AS entry", "'plug' || (o_orderkey % 2) AS plugin", "'1.' || (o_orderkey % 12) AS version", "o_orderstatus AS tags")


_ENTRY = "'set-' || cast(o_orderkey % 4 AS string) || CASE WHEN o_orderkey % 3 = 0 THEN '::' || cast(o_orderkey % 50 AS string) ELSE '' END"
_add(
    "dup_merge_tags",
    lambda s, d: tagging.merged_lists(_merge_members(s, d), "set").select("group_id", F.array_join("entries", ",").alias("entries")),
    f"SELECT group_id, string_agg(entry, ',' ORDER BY entry) AS entries FROM (SELECT *, row_number() OVER (PARTITION BY group_id, split_part(entry, '::', 1) ORDER BY keeper DESC, path, ord) AS k FROM ({_MEMBERS}, {_ENTRY} AS entry FROM orders)) WHERE k = 1 GROUP BY group_id",
)
_add(
    "dup_merge_buckets",
    lambda s, d: tagging.merged_buckets(_merge_members(s, d)),
    f"SELECT group_id, plugin, version, tags FROM (SELECT *, row_number() OVER (PARTITION BY group_id, plugin ORDER BY keeper DESC, version DESC, path) AS k FROM ({_MEMBERS}, 'plug' || cast(o_orderkey % 2 AS string) AS plugin, '1.' || cast(o_orderkey % 12 AS string) AS version, o_orderstatus AS tags FROM orders)) WHERE k = 1",
)


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = table(spark, sf_dir, "media").selectExpr("split_part(path, '/', 1) || '-' || (file_size % 50) AS group_id", "path", "file_size % 7 = 0 AS keeper", "file_size * 100000 + mtime % 100000 AS ord", "rating", "color_label", "date_taken")
    return tagging.merge_defaults(media)


_FIRST = "first({c} ORDER BY CASE WHEN {c} IS NULL THEN 1 ELSE 0 END, CASE WHEN file_size % 7 = 0 THEN 0 ELSE 1 END, file_size * 100000 + mtime % 100000) AS {c}"
_add("merge_defaults", _plan, "SELECT split_part(path, '/', 1) || '-' || (file_size % 50) AS group_id, " + ", ".join(_FIRST.format(c=c) for c in ("rating", "color_label")) + ", min(date_taken) AS date_taken FROM media GROUP BY 1", "media")

_add(
    "merge_choices",
    lambda s, d: tagging.merge_choices(
        table(s, d, "media").selectExpr("split_part(path, '/', 1) || '-' || (file_size % 50) AS group_id", "file_size * 100000 + mtime % 100000 AS ord", "CASE WHEN rating IS NOT NULL THEN file_size % 3 END AS lat", "file_size % 2 AS lon", "array(coalesce(color_label, 'plain'), media_type) AS tags")
    ).select("group_id", F.array_join("places", ",").alias("places"), F.array_join("tags", ",").alias("tags")),
    "WITH m AS (SELECT split_part(path, '/', 1) || '-' || (file_size % 50) AS group_id, file_size * 100000 + mtime % 100000 AS ord, CASE WHEN rating IS NOT NULL THEN (file_size % 3) || ' ' || (file_size % 2) END AS place, [coalesce(color_label, 'plain'), media_type] AS tags FROM media), "
    "p AS (SELECT group_id, string_agg(place, ',' ORDER BY at0) AS places FROM (SELECT group_id, place, min(ord) AS at0 FROM m WHERE place IS NOT NULL GROUP BY ALL) GROUP BY group_id), "
    "t AS (SELECT group_id, string_agg(tag, ',' ORDER BY at0) AS tags FROM (SELECT group_id, tag, min(ord * 2 + k) AS at0 FROM (SELECT group_id, ord, unnest(tags) AS tag, unnest([0, 1]) AS k FROM m) GROUP BY ALL) GROUP BY group_id) "
    "SELECT t.group_id, coalesce(places, '') AS places, tags FROM t LEFT JOIN p ON p.group_id = t.group_id",
    "media",
)
_TWICE = "list_concat(entries, ['second', 'third', 'strip-6'])"
_add(
    "one_entry_per_set",
    _edited(lambda e: tagging.one_entry_per_set(F.concat(e, F.array(F.lit("second"), F.lit("third"), F.lit("strip-6"))))),
    _edit_sql(f"list_filter({_TWICE}, lambda e, k: list_position(list_transform({_TWICE}, lambda y: {_NAME.format('y')}), {_NAME.format('e')}) = k)"),
    "tags", "media",
)

# taggers' answers


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "answers")
    return rows.groupBy("item", "part").agg(F.flatten(F.collect_list(F.array_compact(F.array("tag", "choice")))).alias("tags"), F.first("meta").alias("meta"), F.first("error").alias("error"))


_UNIQUE = "WITH a AS (SELECT DISTINCT ON (item, part) * FROM answers ORDER BY item, part, tag, choice, meta), "
_add("answer_merge", lambda s, d: _merged(_one_answer(s, d)), _UNIQUE + (
    "t AS (SELECT item, string_agg(tag, ',' ORDER BY p) AS plain FROM (SELECT item, tag, min(part) AS p FROM a WHERE tag IS NOT NULL GROUP BY ALL) GROUP BY item), "
    "c AS (SELECT item, first(choice ORDER BY n DESC, p) AS choice FROM (SELECT item, choice, count(*) AS n, min(part) AS p FROM a WHERE choice IS NOT NULL GROUP BY ALL) GROUP BY item), "
    "f AS (SELECT item, bool_and(error IS NOT NULL) AS failed, first(error ORDER BY part) FILTER (error IS NOT NULL) AS error, first(meta ORDER BY part) FILTER (meta IS NOT NULL) AS meta FROM a GROUP BY item) "
    "SELECT f.item, CASE WHEN failed THEN '' ELSE plain || ',' || choice END AS tags, CASE WHEN NOT failed THEN meta END AS meta, CASE WHEN failed THEN error END AS error FROM f LEFT JOIN t ON t.item = f.item LEFT JOIN c ON c.item = f.item"
), "answers")


def _one_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table may hold a part twice; the least row stands."""
    key = F.struct(F.col("tag").isNull(), "tag", F.col("choice").isNull(), "choice", F.col("meta").isNull(), "meta")
    one = table(spark, sf_dir, "answers").groupBy("item", "part").agg(F.min_by(F.struct("tag", "choice", "meta", "error"), key).alias("r"))
    return one.select("item", "part", F.array_compact(F.array("r.tag", "r.choice")).alias("tags"), "r.meta", "r.error")


def _merged(parts: DataFrame) -> DataFrame:
    return answers.merged(parts).select("item", F.array_join("tags", ",").alias("tags"), "meta", "error")


_TAGGER = answers.Tagger("flags", "1.1", ("true",))
_add(
    "plugin_skip",
    lambda s, d: answers.to_send(table(s, d, "media"), _documents(s, d).select("path", F.lit("flags").alias("plugin"), F.col("doc.tags.plugins")["flags"]["version"].alias("version")), _TAGGER),
    "SELECT path FROM media WHERE path NOT IN (SELECT path FROM sidecars WHERE cast(split_part(json_extract_string(json, '$.tags.plugins.flags.version'), '.', 2) AS int) >= 1)",
    "media", "sidecars",
)
_add("run_report", lambda s, d: answers.report(table(s, d, "answers"), 3), "SELECT count(*) FILTER (error IS NULL) AS tagged, cast(3 AS bigint) AS skipped, count(*) FILTER (error IS NOT NULL) AS failed FROM answers", "answers")

# places

_KM = (
    "2 * asin(least(1.0, sqrt(greatest(0.0, power(cos(radians(gps_lat)) * cos(radians(gps_lon)) - cos(radians(lat)) * cos(radians(lon)), 2) + "
    "power(cos(radians(gps_lat)) * sin(radians(gps_lon)) - cos(radians(lat)) * sin(radians(lon)), 2) + power(sin(radians(gps_lat)) - sin(radians(lat)), 2))) / 2)) * 6371.0"
)
_add(
    "geocode",
    lambda s, d: places.geocode(table(s, d, "media").select("path", "gps_lat", "gps_lon"), table(s, d, "gazetteer"), table(s, d, "gazetteer").where("cc <> 'FR'").select("cc", F.concat(F.lit("Land of "), "cc").alias("country")).distinct()).select("path", "cc", "name", F.round("km", 3).alias("km"), F.array_join("tags", ",").alias("tags")),
    f"WITH n AS (SELECT path, cc, name, admin1, {_KM} AS km FROM media JOIN gazetteer ON gps_lat IS NOT NULL) SELECT path, cc, name, round(km, 3) AS km, CASE WHEN cc <> 'FR' THEN 'Land_of_' || cc || ',' ELSE '' END || replace(admin1, ' ', '_') || CASE WHEN km <= 25 THEN ',' || replace(name, ' ', '_') ELSE '' END AS tags FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY km, cc, name) AS k FROM n WHERE km <= 100) WHERE k = 1",
    "media", "gazetteer",
)

# scalar functions over the tables, and over fixed values where the tables have none


def _select(name: str, *columns: tuple) -> _Query:
    return lambda s, d: table(s, d, name).select("path", *[f().alias(n) for n, f, _ in columns])


def _scalars(name: str, source: str, *columns: tuple) -> None:
    _add(name, _select(source, *columns), "SELECT path, " + ", ".join(f"{q} AS {n}" for n, _, q in columns) + f" FROM {source}", source)


_c = F.col
_scalars(
    "path_parts", "media",
    ("type", lambda: X.media_type(_c("path")), "media_type"),
    ("file", lambda: X.file_name(_c("path")), "split_part(path, '/', -1)"),
    ("folder", lambda: X.parent(_c("path")), "regexp_replace(path, '/[^/]*$', '')"),
    ("valid", lambda: X.valid_path(F.concat(_c("path"), F.when(_c("file_size") % 3 == 0, "/..").otherwise(""))), "file_size % 3 <> 0"),
)
_scalars(
    "fit_dims", "media",
    ("fit_w", lambda: X.fitted(_c("width"), _c("height"), 512)["width"], "cast(greatest(1, round(width * least(1.0::double, 512::double / greatest(width, height)))) AS int)" if False else "CASE WHEN width IS NOT NULL THEN cast(greatest(1, round(width * least(1::double, 512::double / greatest(width, height)))) AS int) ELSE 1 END"),
    ("cover_h", lambda: X.covering(_c("width"), _c("height"), 128)["height"], "CASE WHEN width IS NOT NULL THEN cast(greatest(1, round(height * least(1::double, 128::double / least(width, height)))) AS int) ELSE 1 END"),
    ("tier", lambda: X.tier_for(_c("width")), "CASE WHEN width <= 128 THEN 'js' WHEN width <= 512 THEN 'j' WHEN width <= 1280 THEN 'jm' WHEN width <= 2560 THEN 'jh' END"),
)
_scalars("tier_budget", "media", ("budget", lambda: X.tier_budget(_c("file_size") * 1000), "cast(least(greatest(floor(file_size * 1000 / 10), least(536870912, floor(file_size * 1000 / 4))), 8589934592) AS bigint)"))
_scalars("rfc3339", "media", ("text", lambda: X.seconds_rfc3339(_c("mtime")), "strftime(to_timestamp(mtime) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00')"), ("back", lambda: X.rfc3339_seconds(X.seconds_rfc3339(_c("mtime"))), "mtime"))
_scalars(
    "sample_times", "media",
    ("n", lambda: F.size(X.sample_times(_c("duration"), F.lit(4))), "CASE WHEN duration IS NULL OR duration <= 0 THEN 0 WHEN duration < 1 THEN 1 ELSE 4 END"),
    ("last", lambda: F.round(F.get(X.sample_times(_c("duration"), F.lit(4)), F.lit(3)), 6), "CASE WHEN duration >= 1 THEN round(duration * 0.95, 6) END"),
)
_scalars("set_entries", "sidecars", ("entry", lambda: F.get_json_object("json", "$.tags.set[0]"), "json_extract_string(json, '$.tags.set[0]')"), ("name", lambda: X.set_name(F.get_json_object("json", "$.tags.set[0]")), "split_part(json_extract_string(json, '$.tags.set[0]'), '::', 1)"), ("place", lambda: X.set_position(F.get_json_object("json", "$.tags.set[0]")), "try_cast(nullif(split_part(json_extract_string(json, '$.tags.set[0]'), '::', 2), '') AS bigint)"))
_scalars("size_labels", "media", ("label", lambda: views.size_label(_c("file_size") % 3000), "CASE WHEN file_size % 3000 < 1024 THEN (file_size % 3000) || ' B' ELSE cast(cast(round(file_size % 3000 / 1024.0) AS bigint) AS varchar) || ' KB' END"))
_scalars("hamming", "phashes", ("bits", lambda: X.hamming(_c("phash"), _c("coarse")), "cast(bit_count(xor(phash, coarse)) AS int)"))
for _name, (_rows, _expression) in fixed.CASES.items():
    _add(_name, lambda s, d, r=_rows, e=_expression: fixed.evaluate(s, r, e), fixed.expected(_rows))

# more of the sources and of bookkeeping

_add(
    "index_state_upsert",
    lambda s, d: maintenance.last_wins(table(s, d, "media").filter("file_size % 3 <> 0").selectExpr("path", "mtime AS mtime_ns", "file_size AS size"), table(s, d, "media").filter("file_size % 2 = 0").selectExpr("path", "mtime + 5 AS mtime_ns", "file_size AS size")),
    "SELECT path, CASE WHEN file_size % 2 = 0 THEN mtime + 5 ELSE mtime END AS mtime_ns, file_size AS size FROM media WHERE file_size % 3 <> 0 OR file_size % 2 = 0",
    "media",
)
_TRASH = "SELECT cast(1700000000000 + p_partkey * 1000 AS string) || '_' || cast(p_partkey % 3 AS string) || '/dir/f' || cast(p_partkey AS string) || '.jpg' AS path, cast(p_partkey AS bigint) AS size"
_trash = lambda s, d: files.trash_entries(s.read.parquet(f"{d}/part.parquet").selectExpr(*[x.strip() for x in (_TRASH.removeprefix("SELECT ").rsplit(", ", 1))]))
_TRASHED = f"SELECT split_part(path, '/', 1) AS id, regexp_replace(path, '^[^/]*/', '') AS path, cast(split_part(path, '_', 1) AS bigint) AS ms, size FROM ({_TRASH} FROM part)"
_add("trash_list", _trash, _TRASHED)
_add("trash_purge", lambda s, d: maintenance.purge_expired(_trash(s, d), 1_700_000_200_000, 100), f"SELECT * FROM ({_TRASHED}) WHERE ms >= 1700000100000")
_add(
    "bucket_replace",
    lambda s, d: answers.replaced_bucket(table(s, d, "tags"), table(s, d, "media").filter("file_size % 3 = 0").selectExpr("path AS item", "array('n' || (file_size % 7), 'm') AS tags", "CASE WHEN file_size % 2 = 0 THEN 'failed' END AS error"), _TAGGER),
    "WITH a AS (SELECT path, file_size FROM media WHERE file_size % 6 = 3) SELECT * FROM tags WHERE namespace <> 'plugin.flags' OR path NOT IN (SELECT path FROM a) "
    "UNION ALL SELECT path, 'plugin.flags', 'n' || (file_size % 7), cast(NULL AS int) FROM a UNION ALL SELECT path, 'plugin.flags', 'm', cast(NULL AS int) FROM a",
    "tags", "media",
)
_PROBER = """SELECT path, '{"streams":[{"codec_name":"h264","width":' || coalesce(width, 640) || ',"height":' || coalesce(height, 480)
 || CASE WHEN file_size % 5 = 1 THEN ',"duration":"' || cast(file_size % 100 AS string) || '.5"' WHEN file_size % 5 = 0 THEN ',"duration":"N/A"' ELSE '' END
 || CASE WHEN file_size % 4 = 2 THEN ',"tags":{"rotate":"180"}' WHEN file_size % 4 = 3 THEN ',"tags":{"rotate":"0"}' ELSE '' END
 || CASE WHEN file_size % 4 = 1 THEN ',"side_data_list":[{"side_data_type":"Display Matrix","rotation":-90}]' WHEN file_size % 4 = 3 THEN ',"side_data_list":[{"side_data_type":"other"},{"rotation":"90"}]' ELSE '' END
 || '}],"format":{"duration":"' || CASE WHEN file_size % 5 = 0 THEN 'N/A' ELSE '99.25' END || '","tags":{"creation_time":"2024-01-02T03:04:05.000000Z"'
 || CASE WHEN file_size % 2 = 0 THEN ',"com.apple.quicktime.creationdate":"2024-01-02T12:04:05+0900"' ELSE '' END
 || CASE file_size % 3 WHEN 0 THEN ',"location-eng":"+48.5-002.25/"' WHEN 1 THEN ',"com.apple.quicktime.location.accuracy.horizontal":"12.0","com.apple.quicktime.location.ISO6709":"+48.5-002.25+010/"' ELSE '' END
 || '}}}' AS json FROM {media}"""


def _prober(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "media").filter("media_type = 'video'").createOrReplaceTempView("shoebox_videos")
    return files.container_facts(spark.sql(_PROBER.replace("{media}", "shoebox_videos")))


_add(
    "container_facts",
    _prober,
    "SELECT path, CASE WHEN file_size % 2 = 1 THEN coalesce(height, 480) ELSE coalesce(width, 640) END AS width, CASE WHEN file_size % 2 = 1 THEN coalesce(width, 640) ELSE coalesce(height, 480) END AS height, "
    "CASE file_size % 5 WHEN 0 THEN NULL WHEN 1 THEN (file_size % 100) + 0.5::double ELSE 99.25::double END AS duration, CASE WHEN file_size % 2 = 0 THEN 1704197045::bigint ELSE 1704164645::bigint END AS taken, "
    "CASE WHEN file_size % 3 < 2 THEN 48.5::double END AS gps_lat, CASE WHEN file_size % 3 < 2 THEN -2.25::double END AS gps_lon FROM media WHERE media_type = 'video'",
    "media",
)
_add(
    "lost_requests",
    lambda s, d: ingest.lost(table(s, d, "fs_events").selectExpr("seq AS id", "seq AS matched_at", "seq % 7 <> 0 AS answered"), 128),
    "SELECT id, matched_at, answered FROM (SELECT seq AS id, seq AS matched_at, seq % 7 <> 0 AS answered, count(*) FILTER (seq % 7 <> 0) OVER (ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM fs_events) WHERE NOT answered AND later >= 128",
    "fs_events",
)
_add(
    "path_intersect",
    lambda s, d: table(s, d, "media").select("path").join(table(s, d, "tiers").filter("tier = 'jm'").select("path"), "path", "left_semi"),
    "SELECT path FROM media WHERE path IN (SELECT path FROM tiers WHERE tier = 'jm')",
    "media", "tiers",
)

# the catalog's commands


def _catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(table(spark, sf_dir, "media"), table(spark, sf_dir, "tags"), table(spark, sf_dir, "tiers"))


_gifs = lambda s, d: table(s, d, "media").filter("media_type = 'gif'")
_GIF = "path IN (SELECT path FROM media WHERE media_type = 'gif')"
_add("catalog_add_tags", lambda s, d: _catalog(s, d).add_tags(_gifs(s, d), ["5-low", "new"]).tags, f"SELECT * FROM tags UNION ALL SELECT path, 'user', t, cast(NULL AS int) FROM (SELECT path, unnest(['5-low', 'new']) AS t FROM media WHERE media_type = 'gif') x WHERE NOT EXISTS (SELECT 1 FROM tags g WHERE g.path = x.path AND g.namespace = 'user' AND g.tag = x.t)", "tags", "media")
_add("catalog_remove_tags", lambda s, d: _catalog(s, d).remove_tags(_gifs(s, d), ["5-low", "1-urgent"]).tags, f"SELECT * FROM tags WHERE NOT (namespace = 'user' AND tag IN ('5-low', '1-urgent') AND {_GIF})", "tags", "media")
_add("catalog_delete_tag", lambda s, d: _catalog(s, d).delete_tag("strip-6", "set").tags, "SELECT * FROM tags WHERE NOT (namespace = 'set' AND tag = 'strip-6')", "tags")
_add("catalog_rename_set", lambda s, d: _catalog(s, d).rename_tag("strip-6", "fresh", "set").tags, "SELECT path, namespace, CASE WHEN namespace = 'set' AND tag = 'strip-6' THEN 'fresh' ELSE tag END AS tag, position FROM tags", "tags")
_add("catalog_merge_sets", lambda s, d: _catalog(s, d).merge_tags(["strip-6", "strip-7"], "strip-8", "set").tags, "SELECT path, namespace, CASE WHEN namespace = 'set' AND tag IN ('strip-6', 'strip-7') THEN 'strip-8' ELSE tag END AS tag, CASE WHEN namespace = 'set' AND tag IN ('strip-6', 'strip-7') THEN NULL ELSE position END AS position FROM tags", "tags")
_add(
    "catalog_order_set",
    lambda s, d: _catalog(s, d).order_set("strip-6", table(s, d, "media").filter("file_size % 3 <> 0").selectExpr("path", "file_size * 1000 + mtime % 1000 AS ord")).tags.filter("namespace = 'set' AND tag = 'strip-6'"),
    "WITH r AS (SELECT m.path, cast(row_number() OVER (ORDER BY file_size * 1000 + mtime % 1000) AS int) AS k FROM media m JOIN tags t ON t.path = m.path AND t.namespace = 'set' AND t.tag = 'strip-6' WHERE file_size % 3 <> 0) SELECT t.path, namespace, tag, k AS position FROM tags t LEFT JOIN r ON r.path = t.path WHERE namespace = 'set' AND tag = 'strip-6'",
    "tags", "media",
)
_add("catalog_trash", lambda s, d: _catalog(s, d).trash_files(_gifs(s, d)).tiers, f"SELECT * FROM tiers WHERE NOT {_GIF}", "tiers", "media")
_add("catalog_record_view", lambda s, d: _catalog(s, d).record_view(_gifs(s, d), NOW).media.select("path", "last_viewed"), f"SELECT path, CASE WHEN media_type = 'gif' THEN {NOW} ELSE last_viewed END AS last_viewed FROM media", "media")
_add("catalog_regenerate", lambda s, d: _catalog(s, d).regenerate_thumbnail(_gifs(s, d)).tiers, f"SELECT * FROM tiers WHERE NOT {_GIF}", "tiers", "media")

# ingest

_KINDS = (
    "WITH c AS (SELECT *, CASE WHEN regexp_matches(path, '\\.sidecars/[^/]+\\.json$') THEN 'sidecar' WHEN regexp_matches(path, '(^|/)\\.[^/]*/') OR path NOT LIKE '%.jpg' THEN NULL WHEN kind IN ('create', 'rename_to') THEN 'add' WHEN kind = 'remove' THEN 'remove' END AS action FROM fs_events), "
    "k AS (SELECT seq, ts, action, CASE WHEN action = 'sidecar' THEN regexp_replace(path, '\\.sidecars/([^/]+)\\.json$', '\\1') ELSE path END AS target FROM c WHERE action IS NOT NULL) "
)
_BURSTS = _KINDS + ", b AS (SELECT *, sum(opens) OVER (ORDER BY ts, seq) AS burst FROM (SELECT *, CASE WHEN lag(ts) OVER (ORDER BY ts, seq) IS NULL OR ts - lag(ts) OVER (ORDER BY ts, seq) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS opens FROM k)) "
_classified = lambda s, d: ingest.classify(table(s, d, "fs_events"))
_add("fs_classify", lambda s, d: _classified(s, d).select("seq", "action", "target"), _KINDS + "SELECT seq, action, target FROM k", "fs_events")
_add("debounce_sessions", lambda s, d: ingest.burst_changes(_classified(s, d), 1800.0).groupBy("burst").agg(F.min("since").alias("start"), F.count("*").cast("int").alias("n")).select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "n"), _BURSTS + "SELECT epoch_us(min(ts)) AS start_us, cast(count(DISTINCT (target, action = 'sidecar')) AS int) AS n FROM b GROUP BY burst", "fs_events")
_add("fs_last_wins", lambda s, d: ingest.burst_changes(_classified(s, d), 1800.0).select(F.col("burst").cast("bigint"), "target", "action"), _BURSTS + "SELECT cast(burst AS bigint) AS burst, target, arg_max(action, (ts, seq)) AS action FROM b GROUP BY burst, target, action = 'sidecar'", "fs_events")
_add(
    "progress_throttle",
    lambda s, d: ingest.throttled(table(s, d, "fs_events").selectExpr("kind AS job", "date_trunc('hour', ts) + make_dt_interval(0, 0, 0, seq % 3) AS ts", "seq AS done", "cast(990 AS bigint) AS total")).select("job", "done", "total"),
    "SELECT job, done, total FROM (SELECT kind AS job, seq AS done, cast(990 AS bigint) AS total, row_number() OVER (PARTITION BY kind, date_trunc('hour', ts) + to_seconds(seq % 3) ORDER BY seq) AS k FROM fs_events) WHERE k = 1 OR done = total",
    "fs_events",
)
_add("latest_writes", lambda s, d: ingest.latest_writes(table(s, d, "fs_events").selectExpr("path AS key", "seq", "kind AS value")), "SELECT path AS key, arg_max(kind, seq) AS value, max(seq) AS seq FROM fs_events GROUP BY path", "fs_events")
_add("single_flight", lambda s, d: ingest.once_each(table(s, d, "fs_events").selectExpr("path", "kind AS tier")), "SELECT DISTINCT path, kind AS tier FROM fs_events", "fs_events")
_add(
    "resync_lagged",
    lambda s, d: ingest.resync(table(s, d, "fs_events").selectExpr("kind AS subscriber", "cast(5 AS bigint) AS read", "seq", "path AS domain"), 150),
    "WITH e AS (SELECT kind AS subscriber, seq, path AS domain, count(*) OVER (PARTITION BY kind) AS n FROM fs_events WHERE seq > 5) SELECT subscriber, domain, seq FROM e WHERE n <= 150 UNION ALL SELECT DISTINCT subscriber, 'resync', cast(NULL AS bigint) FROM e WHERE n > 150",
    "fs_events",
)
