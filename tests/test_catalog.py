import json
import math
import sys
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from shoebox import fixtures
from shoebox.catalog import Catalog
from shoebox.operators import answers, duplicates, filtering, layout, maintenance, tagging, views, vocabulary
from shoebox.plans import registry
from shoebox.sources import files
from shoebox.streaming import ingest

DIR = "/root/testdata/sf0.001"
#: One or two queries of each family; the driver compares all of them.
SOME = [
    "filter_bool_mix", "filter_nested_not", "filter_not_rating_3vl", "filter_not_width_3vl", "filter_tag_not", "items_set_view", "items_subsort", "items_flagship",
    "group_month", "group_size_range", "scroll_markers_size", "scroll_markers_rating", "suggest_subsequence", "scan_upsert", "mirror_companion", "sidecar_explode", "sidecar_bad", "sidecar_rewrite", "container_facts", "iso6709", "safe_name",
    "tag_rename", "order_set", "tier_evict", "cold_gallery_evict", "dup_groups", "dup_merge_tags", "answer_merge", "geocode", "fs_last_wins", "set_entry", "difference_hash", "capture_clock",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in fixtures._SOURCES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(round(r[k], 9) if isinstance(r[k], float) else r[k] for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", SOME)
def test_against_duckdb(spark, duck, name):
    found = registry.queries()[name](spark, DIR)
    twin = duck.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(twin.columns)
    assert _rows(found.columns, found.collect()) == _rows(twin.columns, twin.fetchall())


def test_every_query_has_a_twin():
    assert registry.queries().keys() - registry.oracle_sql().keys() == {"justified_rows"}


def test_justified_rows(spark):
    assert list(layout.packed([2.0, 2.0, 2.0, 1.0], 400, 100, 0)) == [(2, 100.0), (2, 400 / 3)]
    assert list(layout.packed([1.0], 400, 100, 0)) == [(1, 100 * math.sqrt(1.5))]
    assert list(layout.packed([None, -1.0, 99.0], 300, 100, 0)) == [(3, 50.0)]
    items = spark.createDataFrame([(k, 200, 100) for k in range(5)], "pos long, width int, height int")
    heads = spark.createDataFrame([("a", 0, 3), ("b", 3, 2)], "label string, start_index long, count long")
    found = [(r["first"], r["n"], r["height"], r["y"]) for r in layout.rows(items, heads, 400.0, 100.0, 0.0).orderBy("first").collect()]
    assert found == [(0, 2, 100.0, 0.0), (2, 1, 100.0, 100.0), (3, 2, 100.0, 200.0)]
    assert sum(r["n"] for r in registry.queries()["justified_rows"](spark, DIR).collect()) == 1500 * 7 // 10


MEDIA = "path string, media_type string, file_size long, mtime long, date_taken long, date_added long, last_viewed long, last_rated long, rating int, color_label string, width int, height int, duration double, gps_lat double, gps_lon double, exif_read boolean"


def _media(spark, *rows):
    full = [{"media_type": "image", "file_size": 100, "mtime": 0, "exif_read": True} | r for r in rows]
    return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in MEDIA.split(", ")) for r in full], MEDIA)


TAGS = "path string, namespace string, tag string, position int"


def test_three_valued_logic(spark):
    media = _media(spark, {"path": "hit", "rating": 5, "color_label": "red", "width": 2000, "date_taken": 1717200000}, {"path": "miss", "rating": 1, "color_label": "blue", "width": 10, "date_taken": 0}, {"path": "null"})
    tags = spark.createDataFrame([("hit", "user", "a", None)], TAGS)
    found = lambda text: {r["path"] for r in filtering.apply(media, tags, text).collect()}
    for text, negated in (("rating>=4", {"miss"}), ("color:red", {"miss"}), ("width>=1920", {"miss", "null"}), ("date=2024", {"miss", "null"}), ("user::a", {"miss", "null"})):
        assert found(text) == {"hit"}
        assert found(f"NOT {text}") == negated
        # the same inside a disjunction, where tag terms become flags
        assert found(f"(NOT {text}) OR user::nothing") == negated
    assert found("  ") == {"hit", "miss", "null"}


def test_positions_of_a_large_view(spark, monkeypatch):
    monkeypatch.setattr(views, "ONE_PARTITION_BYTES", -1)
    media = _media(spark, *[{"path": f"{k:04d}", "rating": k % 4 or None} for k in range(500)])
    rows = views.numbered(media, [F.col("rating").desc_nulls_last(), F.col("path").asc()]).collect()
    wanted = sorted(range(500), key=lambda k: (k % 4 == 0, -(k % 4), k))
    assert [r["path"] for r in sorted(rows, key=lambda r: r["pos"])] == [f"{k:04d}" for k in wanted]


def test_an_empty_scan_is_refused(spark):
    media = _media(spark, {"path": "a"})
    with pytest.raises(maintenance.EmptyScan):
        maintenance.prune_missing({"media": media}, media.limit(0))
    assert maintenance.prune_missing({"media": media.limit(0)}, media.limit(0))["media"].count() == 0


def test_vocabulary_changes(spark):
    a = spark.createDataFrame([("user", "x", 1)], "namespace string, tag string, count long")
    assert not vocabulary.changed(a, a)
    assert vocabulary.changed(a, a.withColumn("count", F.lit(2).cast("long")))


def test_set_names_and_folding(spark):
    for name in ("a::3", "x::y::0"):
        with pytest.raises(tagging.InvalidSetName):
            tagging.checked("set", name)
    tagging.checked("set", "::3", "a::", "a::99999999999")
    tagging.checked("user", "a::3")
    lists = spark.createDataFrame([(["a::3", "b::4", "c"],), (["b", "t::9", "a"],), (["c"],), ([],)], "entries array<string>")
    keep = lists.select(tagging.folded(F.col("entries"), "set", ["a", "b"], "t", True)).collect()
    assert [r[0] for r in keep] == [["t::3", "c"], ["t::9"], ["c"], []]
    drop = lists.select(tagging.folded(F.col("entries"), "set", ["a", "b"], "t", False)).collect()
    assert [r[0] for r in drop] == [["t", "c"], ["t::9"], ["c"], []]


def test_permutation_and_block(spark):
    rows = spark.createDataFrame([(p, k) for k, p in enumerate("abcdef")], "path string, pos long")
    moved = tagging.moved_block(rows, spark.createDataFrame([("e",), ("b",)], "path string"), 3).orderBy("new_pos").collect()
    assert "".join(r["path"] for r in moved) == "acbedf"
    assert tagging.is_permutation(rows, rows.orderBy(F.desc("pos")))
    assert not tagging.is_permutation(rows, rows.limit(3))


def test_duplicates_bridge_and_suppression(spark):
    hashes = spark.createDataFrame([("a", 0, 0), ("b", 1, 1), ("c", 2, 3), ("d", 3, None), ("e", 4, -1)], "path string, ord long, phash long")
    hashes = hashes.withColumns({"width": F.lit(10), "height": F.lit(10), "file_size": F.col("ord") + 1})
    sets = spark.createDataFrame([("a", "s"), ("b", "s")], "path string, tag string")
    assert {(r["a"], r["b"]) for r in duplicates.edges(hashes, None, 1).collect()} == {("a", "b"), ("b", "c")}
    assert {(r["a"], r["b"]) for r in duplicates.edges(hashes, sets, 2).collect()} == {("a", "c"), ("b", "c")}
    found = duplicates.groups(hashes, sets, 2).collect()
    assert {r["path"] for r in found} == {"a", "b", "c"} and {r["group_id"] for r in found} == {"a"}
    assert [r["path"] for r in found if r["best"]] == ["a"]


def test_sidecars_on_disk(spark, tmp_path):
    root = tmp_path / "gallery"
    (root / "trip" / ".sidecars").mkdir(parents=True)
    for name in ("b.jpg", "A.PNG", "notes.txt"):
        (root / "trip" / name).write_bytes(b"x" * 10)
    doc = {"tags": {"user": ["beach", "beach"], "set": ["trip::2", "::3"], "plugins": {"p": {"version": "1", "tags": ["t"]}}, "auto": ["old"]}, "meta": {"core": {"rating": 5, "color_label": " Red "}}, "own": {"k": [1, 2]}}
    (root / "trip" / ".sidecars" / "b.jpg.json").write_text(json.dumps(doc))
    (root / "trip" / ".sidecars" / "A.PNG.json").write_text(json.dumps({"schema_version": 2}))
    scan = files.scan_media(spark, str(root)).collect()
    assert [(r["path"], r["media_type"], r["file_size"]) for r in scan] == [("trip/A.PNG", "image", 10), ("trip/b.jpg", "image", 10)]
    raw = files.read_sidecars(spark, str(root)).cache()
    documents = files.parsed(raw)
    assert {r["path"]: r["bad"] for r in documents.collect()} == {"trip/b.jpg": False, "trip/A.PNG": True}
    tags = {(r["namespace"], r["tag"], r["position"]) for r in files.sidecar_tags(documents).collect()}
    assert tags == {("user", "beach", None), ("set", "trip", 2), ("set", "::3", None), ("plugin.p", "t", None)}
    lists = spark.createDataFrame([("trip/b.jpg", "user", ["sea \"x\""])], "path string, namespace string, entries array<string>")
    after = {r["path"]: json.loads(r["json"]) for r in files.with_lists(raw, lists).collect()}["trip/b.jpg"]
    assert after["own"] == doc["own"] and after["meta"] == doc["meta"]
    assert after["tags"] == doc["tags"] | {"user": ["sea \"x\""]}


def test_malformed_sidecars_change_nothing(spark, tmp_path):
    deep = tmp_path / "/".join(f"d{k}" for k in range(12)) / ".sidecars"
    deep.mkdir(parents=True)
    (deep / "a.jpg.json").write_text("{not json")
    (deep / "b.jpg.json").write_text(json.dumps({"created": "2024-02-03T04:05:06Z", "file": "2024.jpg", "x": "true", "y": "[1", "z": 'say "hi"', "meta": {"core": {"rating": 2}}, "tags": {"user": ["new"], "own": 1}}))
    name = "/".join(f"d{k}" for k in range(12))
    raw = files.read_sidecars(spark, str(tmp_path))
    documents = files.parsed(raw)
    assert {r["path"]: r["bad"] for r in documents.collect()} == {f"{name}/a.jpg": True, f"{name}/b.jpg": False}
    media = spark.createDataFrame([(f"{name}/{x}.jpg", 5, "red", None, None, None, None, None, None) for x in "ab"], "path string, rating int, color_label string, last_rated long, date_added long, last_viewed long, gps_lat double, gps_lon double, mtime long")
    tags = spark.createDataFrame([(f"{name}/{x}.jpg", "user", "old", None) for x in "ab"], "path string, namespace string, tag string, position int")
    after = Catalog(media=media, tags=tags).indexed(documents)
    assert {(r["path"][-5], r["rating"], r["color_label"]) for r in after.media.collect()} == {("a", 5, "red"), ("b", 2, None)}
    assert {(r["path"][-5], r["tag"]) for r in after.tags.collect()} == {("a", "old"), ("b", "new")}
    lists = spark.createDataFrame([(f"{name}/{x}.jpg", "set", ["s::1"]) for x in "ab"], "path string, namespace string, entries array<string>")
    texts = {r["path"][-5]: r["json"] for r in files.with_lists(raw, lists).collect()}
    assert texts["a"] == "{not json" and json.loads(texts["b"]) == json.loads((deep / "b.jpg.json").read_text()) | {"tags": {"user": ["new"], "own": 1, "set": ["s::1"]}}


def test_trash_and_settings(spark):
    rows = spark.createDataFrame([("1000_1/a/b.jpg", 5), ("2000_1/c.jpg", 6), ("x_1/d.jpg", 7)], "path string, size long")
    found = files.trash_entries(rows)
    assert [(r["id"], r["path"]) for r in found.collect()] == [("2000_1", "c.jpg"), ("1000_1", "a/b.jpg")]
    assert maintenance.purge_expired(found, 3000, 1).count() == 1 and maintenance.purge_expired(found, 3000, 0).count() == 2
    assert files.load_settings("{") == files.SETTINGS and files.load_settings('{"default_filter": "a"}')["default_filter"] == "a"


def test_a_tagger_process(spark):
    code = "import sys,json\nfor l in reversed(sys.stdin.readlines()):\n f=json.loads(l)['file']\n print(json.dumps({'file':f,'tags':[f.upper()]}) if f!='bad' else 'junk')"
    tagger = answers.Tagger("up", "1.0", (sys.executable, "-c", code), frames=99)
    assert tagger.frames == 16
    parts = spark.createDataFrame([("p", 0, "x"), ("q", 0, "bad")], "path string, part long, file string")
    found = {r["path"]: (r["tags"], r["error"]) for r in answers.run(parts, tagger).collect()}
    assert found == {"p": (["X"], None), "q": ([], "no result")}
    with pytest.raises(ValueError):
        answers.Tagger("up", "1", ("x",), api_version=2)


def test_answers_of_parts(spark):
    rows = [(1, 0, ["a", "rating:x"], None, None), (1, 1, ["b", "rating:y", "a"], "m", None), (1, 2, ["rating:y"], "n", None), (2, 0, [], None, "e1"), (2, 1, [], None, "e2"), (3, 0, ["rating:p"], None, None), (3, 1, ["rating:q"], None, "late")]
    parts = spark.createDataFrame(rows, "item long, part long, tags array<string>, meta string, error string")
    found = {r["item"]: (r["tags"], r["meta"], r["error"]) for r in answers.merged(parts).collect()}
    assert found == {1: (["a", "b", "rating:y"], "m", None), 2: ([], None, "e1"), 3: (["rating:p"], None, None)}


def test_streamed_bursts_equal_the_batch(spark, tmp_path):
    log = fixtures.table(spark, DIR, "fs_events").filter("seq < 300").withColumn("ts", F.col("ts").cast("timestamp"))
    far = log.limit(1).select(F.lit(10_000).cast("long").alias("seq"), F.expr("timestamp'2030-01-01'").alias("ts"), F.lit("z/z.jpg").alias("path"), F.lit("create").alias("kind"))
    log.unionByName(far).repartition(1).write.parquet(str(tmp_path / "log"))
    got = []
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    query = ingest.ingest(stream, lambda df, _: got.extend(df.collect()), str(tmp_path / "state"), "30 minutes", "30 minutes")
    query.processAllAvailable()
    query.stop()
    wanted = ingest.burst_changes(ingest.classify(log), 1800.0).collect()
    assert sorted((r["target"], r["action"]) for r in got) == sorted((r["target"], r["action"]) for r in wanted)


def test_a_long_burst(spark):
    log = spark.range(40_000).selectExpr("id AS seq", "timestamp_micros(1700000000000000 + id * 1000) AS ts", "'a/' || (id * 7919 % 9000) || '.jpg' AS target", "CASE id % 11 WHEN 0 THEN 'sidecar' WHEN 1 THEN 'remove' ELSE 'add' END AS action")
    start = time.monotonic()
    found = ingest.bursts(log).select("start", "changes").collect()
    assert time.monotonic() - start < 60
    last = {}
    for r in log.orderBy("ts", "seq").collect():
        last[r["target"], r["action"] == "sidecar"] = r["action"]
    wanted = sorted((t, a) for (t, _), a in last.items())
    assert len(found) == 1 and [(c["target"], c["action"]) for c in found[0]["changes"]] == wanted
    batch = ingest.burst_changes(log).collect()
    assert sorted((r["target"], r["action"]) for r in batch) == wanted and min(r["since"] for r in batch) == found[0]["start"]
    plan = registry.queries()["debounce_sessions"](spark, DIR)._jdf.queryExecution().toString()
    assert "SessionWindow" not in plan and "collect_list" not in plan


def test_lost_requests_by_a_top_list(spark):
    rows = [(k, None if k == 3 else (k * 7) % 50 // 2, k % 3 != 0) for k in range(50)] + [(50, 30, None)]
    table = spark.createDataFrame(rows, "id long, matched_at long, answered boolean")
    moment = lambda at: -1 if at is None else at
    for results in (0, 1, 5, 33, 34, 100):
        wanted = [i for i, at, a in rows if a is False and sum(bool(b) and moment(other) > moment(at) for _, other, b in rows) >= results]
        assert sorted(r["id"] for r in ingest.lost(table, results).collect()) == wanted
    assert ingest.lost(table.limit(0)).count() == 0
    # a frame to the end of the table is summed anew for each row
    assert "Window" not in ingest.lost(table)._jdf.queryExecution().toString()


def test_client_decisions():
    assert ingest.client_step("changed", 12, False) == "patch" and ingest.client_step("changed", 13, False) == "refetch"
    assert ingest.client_step("tags", 1, False) == "nothing" and ingest.client_step("removed", 99, True) == "splice"
