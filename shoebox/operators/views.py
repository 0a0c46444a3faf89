"""Item views: projection, order, positions, group headers and scroll markers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.operators.filtering import apply
from shoebox.operators.lineage import checkpointed
from shoebox.plans.parser import parse

#: Sort fields by wire name, those whose nulls come last, size groups (decimal), label of unknown dates.
SORT_COLUMNS = {"date": "date", "size": "file_size", "name": "path", "rating": "rating", "mediatype": "media_type", "lastviewed": "last_viewed", "dateadded": "date_added", "lastrated": "last_rated"}
SIZE_GROUPS = ((0, "< 1 MB"), (1_000_000, "1 - 10 MB"), (10_000_000, "10 - 100 MB"), (100_000_000, "100 MB - 1 GB"), (1_000_000_000, "> 1 GB"))
TYPE_LABELS = {"image": "Images", "video": "Videos", "gif": "GIFs"}
UNKNOWN_DATE = "Unknown date"
ITEM_COLUMNS = ("path", "media_type", "file_size", "date", "rating", "width", "height", "duration", "last_viewed", "date_added", "last_rated", "color_label")
SIZE_STEPS = (100 << 10, 500 << 10, 1 << 20, 5 << 20, 10 << 20, 50 << 20, 100 << 20)
MOST_MARKERS = 15

#: Views of up to so many bytes are numbered in one sorted partition; larger ones by ranges.
ONE_PARTITION_BYTES = 256 << 20


@dataclass(frozen=True)
class Request:
    """What a client asks for; group: none, day, month, year, mediatype, size or tag."""

    filter: str = ""
    sort: str = "date"
    order: str = "desc"
    sub_sort: str | None = None
    sub_order: str = "desc"
    group: str = "none"


def sort_date() -> Column:
    return F.coalesce("date_taken", "mtime")


def items(media: DataFrame) -> DataFrame:
    """The fixed columns of an item; the date is that of the capture, else of the file."""
    more = ["thumbhash"] if "thumbhash" in media.columns else []
    found = media.withColumn("date", sort_date()).select(*ITEM_COLUMNS, *more)
    return found.withColumn("thumbhash", F.base64("thumbhash")) if more else found


def ordering(field: str, order: str) -> Column:
    """Nulls come last both ways; dates, sizes, names and types have none."""
    c = F.col(SORT_COLUMNS[field])
    return c.asc_nulls_last() if order == "asc" else c.desc_nulls_last()


def numbered(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """df with positions from 0 on in the given total order.

    A view whose estimated size is small is sorted in one partition. Beyond, it is sorted by
    ranges on all executors, and the ranges' sizes, one number each, make positions global.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= ONE_PARTITION_BYTES:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint") - 1)
    placed = checkpointed(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).count()
    before = F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    found = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")  # a row for each task of the sort
    return found.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__at", "__start")


def view(media: DataFrame, tags: DataFrame, request: Request) -> DataFrame:
    """Items that pass the filter, with pos. A lone set term gives the set's own order first.

    Ties that the request leaves are broken by path, so positions are the same every time.
    """
    expression = parse(request.filter) if request.filter.strip() else None
    found = items(apply(media, tags, expression) if expression is not None else media)
    order = [ordering(request.sort, request.order)]
    if request.sub_sort:
        order.append(ordering(request.sub_sort, request.sub_order))
    members = expression.sole_set() if expression is not None else None
    if members is not None:
        places = tags.filter((F.col("namespace") == "set") & (F.col("tag") == members)).select("path", F.col("position").alias("__place"))
        found = found.join(places, "path", "left")
        order.insert(0, F.col("__place").asc_nulls_last())
    return numbered(found, [*order, F.col("path").asc()]).drop("__place")


def day_of(seconds: Column) -> Column:
    """The UTC date of seconds since 1970, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))


def period_label(seconds: Column, unit: str) -> Column:
    """'March  5, 2024' (the day padded with a space), 'March 2024' or '2024'."""
    day = day_of(seconds)
    if unit == "day":
        text = F.concat(F.date_format(day, "MMMM "), F.lpad(F.dayofmonth(day).cast("string"), 2, " "), F.lit(", "), F.year(day).cast("string"))
    elif unit == "month":
        text = F.concat(F.date_format(day, "MMMM "), F.year(day).cast("string"))
    else:
        text = F.year(day).cast("string")
    return F.when(seconds.isNull(), F.lit(UNKNOWN_DATE)).otherwise(text)


def period_key(seconds: Column, unit: str) -> Column:
    day = day_of(seconds)
    key = F.year(day)
    key = key * 12 + F.month(day) if unit != "year" else key
    return key * 31 + F.dayofmonth(day) if unit == "day" else key


def type_label(kind: Column) -> Column:
    out = kind
    for name, label in TYPE_LABELS.items():
        out = F.when(kind == name, F.lit(label)).otherwise(out)
    return out


def _runs(rows: DataFrame, key: Column) -> DataFrame:
    """(start_index, count) of stretches of equal keys; the same key after a gap opens a new one.

    The previous row is met by joining positions, so no partition has to hold the whole view.
    """
    keyed = rows.select("pos", key.alias("key"))
    before = keyed.select((F.col("pos") + 1).alias("pos"), F.col("key").alias("before"), F.lit(True).alias("seen"))
    heads = keyed.join(before, "pos", "left").filter(F.col("seen").isNull() | ~F.col("key").eqNullSafe(F.col("before"))).select(F.col("pos").alias("start_index"))
    total = rows.agg(F.count("*").alias("total"))
    after = F.lead("start_index").over(Window.orderBy("start_index"))
    return heads.crossJoin(F.broadcast(total)).select("start_index", (F.coalesce(after, F.col("total")) - F.col("start_index")).alias("count"))


def headers(rows: DataFrame, group: str) -> DataFrame:
    """Group headers (label, start_index, count) of a numbered view; none for no grouping and for tags."""
    if group in ("day", "month", "year", "mediatype"):
        if group == "mediatype":
            runs, label = _runs(rows, F.col("media_type")), type_label(F.col("media_type"))
        else:
            runs, label = _runs(rows, period_key(F.col("date"), group)), period_label(F.col("date"), group)
        first = rows.select(F.col("pos").alias("start_index"), label.alias("label"))
        return runs.join(first, "start_index").select("label", "start_index", "count")
    if group == "size":
        bucket = F.lit(0)
        for k, (least, _) in enumerate(SIZE_GROUPS):
            bucket = F.when(F.col("file_size") >= least, F.lit(k)).otherwise(bucket)
        name = F.element_at(F.array(*[F.lit(label) for _, label in SIZE_GROUPS]), F.col("bucket") + 1)
        found = rows.groupBy(bucket.alias("bucket")).agg(F.min("pos").alias("start_index"), F.count("*").alias("count"))
        return found.select(name.alias("label"), "start_index", "count")
    return rows.select(F.lit("").alias("label"), F.col("pos").alias("start_index"), F.col("pos").alias("count")).filter(F.lit(False))


def _thinned(marks: DataFrame) -> DataFrame:
    """At most about MOST_MARKERS of the markers, evenly spaced."""
    whole = Window.orderBy("at")
    counted = marks.withColumn("__k", F.row_number().over(whole) - 1).crossJoin(F.broadcast(marks.agg(F.count("*").alias("__n"))))
    step = F.greatest(F.lit(1), F.ceil(F.col("__n") / MOST_MARKERS))
    return counted.filter(F.col("__k") % step == 0).select("at", "label")


def size_label(size: Column) -> Column:
    """'12 KB', '3.4 MB', '1.0 GB', 1024 to the next unit."""
    return (
        F.when(size < 1 << 10, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1 << 20, F.concat(F.round(size / (1 << 10)).cast("bigint").cast("string"), F.lit(" KB")))
        .when(size < 1 << 30, F.concat(F.round(size / (1 << 20), 1).cast("string"), F.lit(" MB")))
        .otherwise(F.concat(F.round(size / (1 << 30), 1).cast("string"), F.lit(" GB")))
    )


def markers(rows: DataFrame, field: str) -> DataFrame:
    """Scrollbar markers (at, label) of a numbered view: changes of month, first letter, rating, or size steps crossed."""
    if field in ("date", "dateadded", "lastviewed", "lastrated"):
        c = F.col(SORT_COLUMNS[field])
        dated = rows.filter(c.isNotNull() & (c != 0))
        close = numbered(dated.withColumnRenamed("pos", "at"), [F.col("at").asc()])
        label = F.date_format(day_of(c), "MMM yyyy")
        key = period_key(c, "month")
    elif field == "name":
        letter = F.upper(F.substring(F.substring_index("path", "/", -1), 1, 1))
        named = rows.filter(letter != "")
        close = numbered(named.withColumnRenamed("pos", "at"), [F.col("at").asc()])
        label = key = letter
    elif field == "rating":
        close = rows.withColumn("at", F.col("pos"))
        key = F.coalesce("rating", F.lit(0))
        label = F.when(key == 0, F.lit("Unrated")).otherwise(F.repeat(F.lit("★"), key))
    elif field == "size":
        return _thinned(_size_steps(rows))
    else:
        return rows.select(F.col("pos").alias("at"), F.lit("").alias("label")).filter(F.lit(False))
    runs = _runs(close, key)
    named = close.select(F.col("pos").alias("start_index"), "at", label.alias("label"))
    return _thinned(runs.join(named, "start_index").select("at", "label"))


def _size_steps(rows: DataFrame) -> DataFrame:
    """Each step's first row beyond it, one step a row: a step can't come before the row after its predecessor's."""
    ends = rows.agg(F.min_by("file_size", "pos").alias("first"), F.max_by("file_size", "pos").alias("last"), F.count("*").alias("n"))
    rising = (F.col("n") > 1) & (F.col("first") <= F.col("last"))
    steps = rows.crossJoin(F.broadcast(ends)).withColumn("rising", rising)
    ranked = steps.select("pos", "file_size", "n", "rising", F.explode(F.sequence(F.lit(0), F.lit(len(SIZE_STEPS) - 1))).alias("k"))
    limits = F.array(*[F.lit(x).cast("bigint") for x in SIZE_STEPS])
    limit = F.when(F.col("rising"), F.get(limits, F.col("k"))).otherwise(F.get(limits, len(SIZE_STEPS) - 1 - F.col("k")))
    crossed = F.when(F.col("rising"), F.col("file_size") >= limit).otherwise(F.col("file_size") <= limit)
    # in a view sorted by size the rows beyond a step are all behind its first one
    first = ranked.filter(crossed).groupBy("k", limit.alias("limit")).agg(F.min("pos").alias("first"), F.max("n").alias("n"))
    place = F.max(F.col("first") - F.col("k")).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) + F.col("k")
    return first.withColumn("at", place).filter(F.col("at") < F.col("n")).select("at", size_label(F.col("limit")).alias("label"))
