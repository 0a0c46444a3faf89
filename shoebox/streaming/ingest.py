"""File-system events to catalog changes, in batch and as a stream.

Events are classified by path and kind. A quiet period without relevant events closes a
burst; the last event of each path in a burst decides what happens to it. Streams use event
time with a watermark, so an event later than that is dropped and left to the next scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.functions.scalars import media_type
from shoebox.sources.files import media_of_sidecar

QUIET = "500 milliseconds"
#: File of the settings, kinds of events that add and remove a path, how many items a client patches.
SETTINGS_FILE = ".sidecars/settings.toml"
ADDS, REMOVES = ("create", "rename_to", "modify_name_to"), ("remove", "rename_from", "modify_name_from")
MOST_PATCHES = 12


def classify(events: DataFrame) -> DataFrame:
    """events (path, kind, ...) with action (settings, sidecar, add, remove) and the file it is about; others are left out."""
    path, kind = F.col("path"), F.col("kind")
    owner = media_of_sidecar(path)
    hidden = path.rlike(r"(^|/)\.[^/]*/")
    action = (
        F.when(path == SETTINGS_FILE, "settings")
        .when(owner.isNotNull(), "sidecar")
        .when(hidden | media_type(path).isNull(), None)
        .when(kind.isin(*ADDS), "add")
        .when(kind.isin(*REMOVES), "remove")
    )
    return events.withColumns({"action": action, "target": F.when(action == "sidecar", owner).otherwise(path)}).filter("action is not null")


def bursts(events: DataFrame, quiet: str = QUIET) -> DataFrame:
    """(start, end, changes) for every burst of classified events (ts, seq, ...), also of a stream with a watermark on ts.

    changes has the last event of each file by (ts, seq), adds and removes cancelling each
    other, and sidecar changes beside them.
    """
    window = F.session_window("ts", quiet)
    # one key for all files, as the quiet period is everyone's
    grouped = events.withColumn("all", F.lit(1)).groupBy("all", window.alias("burst")).agg(F.collect_list(F.struct("ts", "seq", "action", "target")).alias("events"))
    return grouped.select("burst.start", "burst.end", _last_of_each(F.col("events")).alias("changes"))


def _last_of_each(events: Column) -> Column:
    """The last event of each file and kind of file: in their order the one before another file's."""
    ordered = F.array_sort(F.transform(events, lambda e: F.struct(e["target"].alias("target"), (e["action"] == "sidecar").alias("beside"), e["ts"].alias("ts"), e["seq"].alias("seq"), e["action"].alias("action"))))
    beside_next = F.arrays_zip(ordered.alias("e"), F.slice(ordered, 2, F.size(events)).alias("next"))
    last = F.filter(beside_next, lambda x: x["next"].isNull() | (x["e"]["target"] != x["next"]["target"]) | (x["e"]["beside"] != x["next"]["beside"]))
    return F.array_sort(F.transform(last, lambda x: F.struct(x["e"]["target"].alias("target"), x["e"]["action"].alias("action"))))


def burst_changes(events: DataFrame, quiet_seconds: float = 0.5) -> DataFrame:
    """(burst, target, action, since) of a bounded log of classified events: what bursts() gives, without gathering a burst.

    since is the file's first event in the burst, so a burst starts at the least of them.

    Bursts are found from each event's predecessor in time. Days overlap by their first event
    alone, so the log is dealt by day and only one number for each day is summed in order.
    """
    moment = F.col("ts").cast("timestamp_ntz")
    rows = events.withColumn("day", moment.cast("date"))
    by_day = Window.partitionBy("day").orderBy("ts", "seq")
    firsts = rows.groupBy("day").agg(F.max("ts").alias("last"))
    earlier = firsts.select(F.lead("day").over(Window.orderBy("day")).alias("day"), F.col("last").alias("carried"))
    rows = rows.join(F.broadcast(earlier), "day", "left")  # a row for each day
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.coalesce(F.lag("ts").over(by_day), F.col("carried")).cast("timestamp"))
    rows = rows.withColumn("opens", F.when(gap.isNull() | (gap >= int(quiet_seconds * 1e6)), 1).otherwise(0))
    inside = rows.withColumn("n", F.sum("opens").over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
    days = rows.groupBy("day").agg(F.sum("opens").alias("k"))
    before = days.select("day", F.coalesce(F.sum("k").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = inside.join(F.broadcast(before), "day").withColumn("burst", F.col("n") + F.col("before"))
    beside = F.col("action") == "sidecar"
    return numbered.groupBy("burst", "target", beside.alias("beside")).agg(F.max_by("action", F.struct("ts", "seq")).alias("action"), F.min("ts").alias("since")).select("burst", "target", "action", "since")


def ingest(stream: DataFrame, flush: Callable[[DataFrame, int], None], checkpoint: str, quiet: str = QUIET, late: str = QUIET):
    """Starts a query that hands the changes (start, target, action) of closed bursts to flush(changes, batch)."""
    closed = bursts(classify(stream.withWatermark("ts", late)), quiet).select("start", F.explode("changes").alias("c")).select("start", "c.target", "c.action")
    return closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(flush).start()


def throttled(ticks: DataFrame) -> DataFrame:
    """Progress ticks (job, ts, done, total) at most one a second for each job, and always the final one."""
    first = Window.partitionBy("job", F.date_trunc("second", "ts")).orderBy("ts", "done")
    rows = ticks.withColumn("k", F.row_number().over(first))
    return rows.filter((F.col("k") == 1) | (F.col("done") == F.col("total"))).drop("k")


def latest_writes(writes: DataFrame) -> DataFrame:
    """Queued writes (key, seq, value): the newest of each key replaces those that wait."""
    return writes.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def once_each(requests: DataFrame) -> DataFrame:
    """Requests (path, tier) of a batch, one for each thumbnail."""
    return requests.dropDuplicates(["path", "tier"])


def resync(events: DataFrame, capacity: int = 512) -> DataFrame:
    """What a subscriber that has read up to a sequence sees of (subscriber, read, seq, domain): its events, or one resync when it is too far behind."""
    behind = events.filter("seq > read").groupBy("subscriber").agg(F.count("*").alias("n"))
    rows = events.filter("seq > read").join(behind, "subscriber")
    lagged = rows.filter(F.col("n") > capacity).select("subscriber", F.lit("resync").alias("domain"), F.lit(None).cast("bigint").alias("seq")).distinct()
    return rows.filter(F.col("n") <= capacity).select("subscriber", "domain", "seq").union(lagged)


def client_step(event: str, changed: int, filtered: bool) -> str:
    """What a client does on an event: patch a few items, splice removals, fetch again, or nothing."""
    if event == "removed":
        return "splice"
    if event == "changed":
        return "patch" if changed <= MOST_PATCHES else "refetch"
    if event == "tags":
        return "refetch" if filtered else "nothing"
    return "refetch"


def lost(requests: DataFrame, results: int = 128) -> DataFrame:
    """Requests (id, matched_at, answered) that are given up: unanswered while so many later results came, counted by matched_at.

    So many came if the results-th latest did, which a top list finds; results of the same
    moment aren't later. Requests without a moment come before all others.
    """
    waiting = requests.filter(~F.col("answered"))
    if results <= 0:
        return waiting
    latest = requests.filter("answered").select(F.col("matched_at").alias("__at")).orderBy(F.col("__at").desc_nulls_last()).limit(results)
    bound = latest.agg(F.when(F.count("__at") == results, F.min("__at")).alias("__bound"))
    known = waiting.crossJoin(F.broadcast(bound))  # a single row
    return known.filter(F.col("__bound").isNotNull() & (F.col("matched_at").isNull() | (F.col("matched_at") < F.col("__bound")))).drop("__bound")
