"""Catalog tables derived from the star-schema test tables, in SQL that Spark and DuckDB both read.

Each table is one SELECT; {name} stands for a source table, and the few functions that the
two engines spell differently are placeholders too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

MEDIA = """SELECT
 'album' || cast(o_custkey % 12 AS string) || '/' || cast(o_orderkey AS string) ||
   CASE WHEN o_orderkey % 10 < 7 THEN '.jpg' WHEN o_orderkey % 10 < 9 THEN '.mp4' ELSE '.gif' END AS path,
 CASE WHEN o_orderkey % 10 < 7 THEN 'image' WHEN o_orderkey % 10 < 9 THEN 'video' ELSE 'gif' END AS media_type,
 cast(floor(o_totalprice * 100) AS bigint) AS file_size,
 cast({days:o_orderdate} * 86400 + o_orderkey % 86400 AS bigint) AS mtime,
 CASE WHEN o_orderkey % 4 <> 0 THEN cast({days:o_orderdate} * 86400 AS bigint) END AS date_taken,
 CASE WHEN o_orderkey % 13 <> 0 THEN cast({days:o_orderdate} * 86400 + o_orderkey % 86400 + 86400 AS bigint) END AS date_added,
 CASE WHEN o_orderkey % 3 = 0 THEN cast({days:o_orderdate} * 86400 + o_orderkey % 86400 + 172800 AS bigint) END AS last_viewed,
 CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0 THEN cast({days:o_orderdate} * 86400 + o_orderkey % 86400 + 259200 AS bigint) END AS last_rated,
 CASE WHEN o_orderkey % 5 <> 0 THEN cast(o_orderkey % 6 AS int) END AS rating,
 CASE o_orderkey % 7 WHEN 0 THEN 'red' WHEN 1 THEN 'green' WHEN 2 THEN 'blue' END AS color_label,
 CASE WHEN o_orderkey % 11 <> 0 THEN cast(640 + (o_orderkey * 37) % 4000 AS int) END AS width,
 CASE WHEN o_orderkey % 11 <> 0 THEN cast(480 + (o_orderkey * 53) % 3000 AS int) END AS height,
 CASE WHEN o_orderkey % 10 IN (7, 8) THEN cast(o_orderkey % 300 AS double) / 4e0 END AS duration,
 CASE WHEN o_orderkey % 8 = 1 THEN cast((c_nationkey * 7) % 120 - 60 AS double) + cast(o_orderkey % 5 AS double) / 10e0 END AS gps_lat,
 CASE WHEN o_orderkey % 8 = 1 THEN cast((c_nationkey * 13) % 300 - 150 AS double) END AS gps_lon,
 o_orderkey % 9 <> 0 AS exif_read
FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey"""

_PATH = MEDIA[MEDIA.index("'album'") : MEDIA.index(" AS path")]

TAGS = f"""SELECT {_PATH} AS path, 'user' AS namespace, lower(o_orderpriority) AS tag, cast(NULL AS int) AS position
FROM {{orders}} WHERE o_orderkey % 3 <> 0
UNION ALL SELECT DISTINCT {_PATH}, 'plugin.flags', l_returnflag, cast(NULL AS int) FROM {{orders}} JOIN {{lineitem}} ON o_orderkey = l_orderkey
UNION ALL SELECT {_PATH}, 'plugin.location', replace(n_name, ' ', '_'), cast(NULL AS int)
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey WHERE o_orderkey % 8 = 1
UNION ALL SELECT path, namespace, tag, cast(CASE WHEN placed THEN row_number() OVER (PARTITION BY tag, placed ORDER BY price DESC, k) END AS int) FROM (
 SELECT {_PATH} AS path, 'set' AS namespace, 'strip-' || cast(o_custkey % 40 AS string) AS tag, o_orderkey % 12 = 0 AS placed, o_totalprice AS price, o_orderkey AS k
 FROM {{orders}} WHERE o_orderkey % 6 = 0) AS s"""

#: Thumbnails: four tiers of parts.
TIERS = """SELECT CASE p_partkey % 4 WHEN 0 THEN 'js' WHEN 1 THEN 'j' WHEN 2 THEN 'jm' ELSE 'jh' END AS tier,
 'album' || cast(p_partkey % 12 AS string) || '/' || cast(p_partkey AS string) || CASE WHEN p_partkey % 10 < 7 THEN '.jpg' WHEN p_partkey % 10 < 9 THEN '.mp4' ELSE '.gif' END AS path,
 cast(floor(p_retailprice) AS bigint) AS byte_len, cast(1700000000 + (p_partkey * 7919) % 5000 AS bigint) AS accessed_at FROM {part}"""

#: Hashes of the signs of the first 60 and 16 numbers of a vector.
PHASHES = """SELECT 'img/' || cast(vec_id AS string) || '.jpg' AS path, vec_id AS ord, {signs:60} AS phash, {signs:16} AS coarse,
 cast(100 + (vec_id * 31) % 900 AS bigint) AS file_size, CASE WHEN vec_id % 9 <> 0 THEN cast(100 + (vec_id * 17) % 300 AS int) END AS width,
 CASE WHEN vec_id % 9 <> 0 THEN cast(100 + (vec_id * 13) % 200 AS int) END AS height FROM {embeddings}"""

#: Sets that some of the hashed files are in.
PHASH_SETS = "SELECT 'img/' || cast(vec_id AS string) || '.jpg' AS path, 'burst-' || cast(vec_id % 5 AS string) AS tag FROM {embeddings} WHERE vec_id % 3 = 0"

FS_EVENTS = """SELECT event_id AS seq, ts, CASE event_type WHEN 'purchase' THEN 'album' || cast(user_id % 5 AS string) || '/.sidecars/' || cast(user_id AS string) || '.jpg.json'
 ELSE 'album' || cast(user_id % 5 AS string) || '/' || cast(user_id AS string) || CASE WHEN user_id % 6 = 0 THEN '.txt' ELSE '.jpg' END END AS path,
 CASE event_type WHEN 'click' THEN 'create' WHEN 'view' THEN 'rename_to' WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'modify' ELSE 'access' END AS kind FROM {events}"""

#: A place for each nation, on the grid that the media's coordinates use.
GAZETTEER = """SELECT 'C' || cast(n_nationkey AS string) AS cc, 'Region ' || cast(n_regionkey AS string) AS admin1, n_name AS name,
 cast((n_nationkey * 7) % 120 - 60 AS double) + 0.15e0 AS lat, cast((n_nationkey * 13) % 300 - 150 AS double) AS lon FROM {nation}"""

#: Sidecar documents as JSON text, and which files changed since they were indexed.
SIDECARS = f"""SELECT {_PATH} AS path,
 '{{{{"schema_version":1,"tags":{{{{"user":["' || lower(o_orderpriority) || '","batch"],"set":["strip-' || cast(o_custkey % 40 AS string) || CASE WHEN o_orderkey % 2 = 0 THEN '::' || cast(o_orderkey % 50 AS string) ELSE '' END ||
 '"],"plugins":{{{{"flags":{{{{"version":"1.' || cast(o_orderkey % 3 AS string) || '","tags":["' || o_orderstatus || '"]}}}}}}}}}}}},"meta":{{{{"core":{{{{"rating":' ||
 CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE cast(o_orderkey % 4 AS string) END || ',"color_label":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"Red"' END ||
 ',"date_rated":' || CASE WHEN o_orderkey % 4 = 0 THEN '"2024-02-03T04:05:06+00:00"' ELSE 'null' END || ',"date_added":' || CASE WHEN o_orderkey % 6 = 0 THEN '"2020-05-05T00:00:00Z"' ELSE 'null' END || '}}}}}}}}}}}}' AS json
FROM {{orders}}"""

ANSWERS = """SELECT l_orderkey AS item, l_linenumber AS part, cast(l_linenumber AS int) AS ord,
 CASE WHEN l_linenumber % 5 = 4 THEN NULL ELSE 'flag-' || l_returnflag END AS tag, CASE WHEN l_linenumber % 5 = 4 THEN NULL ELSE 'rating:' || l_linestatus END AS choice,
 CASE WHEN l_linenumber % 3 = 0 THEN 'meta-' || cast(l_suppkey AS string) END AS meta, CASE WHEN l_linenumber % 5 = 4 THEN 'failed' END AS error FROM {lineitem}"""

TABLES = {
    "media": MEDIA, "tags": TAGS, "tiers": TIERS, "phashes": PHASHES, "phash_sets": PHASH_SETS,
    "fs_events": FS_EVENTS, "gazetteer": GAZETTEER, "sidecars": SIDECARS, "answers": ANSWERS,
}


def _filled(template: str, duck: bool, sf_dir: str = "") -> str:
    out = template
    out = out.replace("{days:o_orderdate}", "datediff('day', date '1970-01-01', cast(o_orderdate AS date))" if duck else "unix_date(cast(o_orderdate AS date))")
    for n in (16, 60):
        spark = f"aggregate(sequence(1, {n}), 0L, (a, i) -> a + CASE WHEN element_at(embedding, i) > 0 THEN shiftleft(1L, i - 1) ELSE 0L END)"
        other = f"cast(list_sum(list_transform(range(1, {n + 1}), lambda i: CASE WHEN embedding[i] > 0 THEN cast(1 AS bigint) << (i - 1) ELSE 0 END)) AS bigint)"
        out = out.replace(f"{{signs:{n}}}", other if duck else spark)
    for name in _SOURCES:
        out = out.replace(f"{{{name}}}", name if duck else f"parquet.`{sf_dir}/{name}.parquet`")
    return out.replace("{{", "{").replace("}}", "}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A catalog table as a DataFrame over the Parquet files; nothing is collected or cached."""
    return spark.sql(_filled(TABLES[name], False, sf_dir))


def with_tables(sql: str, *names: str) -> str:
    """DuckDB SQL with the catalog tables that it names in front."""
    ctes = ", ".join(f"{n} AS ({_filled(TABLES[n], True)})" for n in names)
    rest = sql.lstrip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if rest.upper().startswith(start):
            return f"{start}{ctes}, {rest[len(start):]}"
    return f"WITH {ctes} {sql}"
