"""Sharding by sampled splitters, with DataFrame functions only.

A size-weighted sample of the records' keys gives quantile boundaries; records are
range-partitioned by them, and ranges that turn out overfull are subdivided. Each
range is small, so exact running sizes inside the ranges, set upon the sizes of all
ranges before, cut the whole order into shards of nearly equal bytes.

The key is a hash of the text, so equal texts lie together and a shard boundary parts
at most one group of them; a group too large for its range is subdivided by doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.llm.common import durable, text_or_empty, unit_interval

#: Ranges for each shard, keys drawn for each range, and the most ranges in all. A range holds
#: a fixed part of the input, and what the driver sees is bounded by their number.
RANGES_PER_SHARD, KEYS_PER_RANGE, MOST_RANGES, ROWS_PER_RANGE = 128, 8, 16384, 100_000


def steps_where(upto: Callable[[Column], Column], bounds: int) -> Column:
    """How many of the sorted bounds are at most the row's key, which upto tells by number, null beyond the last; in log2 steps."""
    levels = max(1, math.ceil(math.log2(bounds + 1)))
    steps = F.array(*[F.lit(1 << k) for k in range(levels - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(upto(at + step - 1), at + step).otherwise(at))


def step_search(known: Column, bounds: int, key: Column) -> Column:
    """How many of the sorted bounds in an array literal are at most key."""
    return steps_where(lambda k: F.get(known, k) <= key, bounds)


def literals(values: list, kind: str) -> Column:
    """An array of constants, which the optimizer folds into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _pick(values: list, index: Column, kind: str) -> Column:
    return F.get(literals(values, kind), index)


def shard_by_bytes(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts every row into one of the shards so that their bytes are near equal.

    Returns id, size (UTF-8 bytes of the text plus 1; null text: 1), text_crc32 (of the
    empty string for null), law, shard, slot (gapless from 0 in each shard) and
    grown_shard (null: this law doesn't promise stable shards).

    Null ids sort first among equal texts; repeated rows each get a slot of their own;
    an empty table gives no rows; other columns are ignored.
    """
    text = text_or_empty(text_col)
    slim = durable(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.xxhash64(text).alias("key"),
        ).withColumn("second", F.xxhash64(F.lit(7), "id", "key")),
        "shard-keys",
    )
    total, rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = int(min(max(shards * RANGES_PER_SHARD, rows // ROWS_PER_RANGE), MOST_RANGES))
    bounds = _boundaries(slim, total, ranges)
    ranged = slim.withColumn("range", step_search(literals(bounds, "bigint"), len(bounds), F.col("key")) if bounds else F.lit(0))
    found = {r["range"]: r["size"] for r in ranged.groupBy("range").agg(F.sum("size").alias("size")).collect()}
    full = max(1, total // ranges)
    cuts = [math.ceil(found.get(k, 0) / full) if found.get(k, 0) > 2 * full else 1 for k in range(len(bounds) + 1)]
    first = [sum(cuts[:k]) for k in range(len(cuts))] if len(cuts) < 64 else _running(cuts)
    part = (F.shiftrightunsigned("second", 11) / F.lit(float(1 << 53)) * _pick(cuts, F.col("range"), "int")).cast("int")
    united = ranged.withColumn("unit", _pick(first, F.col("range"), "int") + part)
    sizes = {r["unit"]: r for r in united.groupBy("unit").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()}
    n_units = sum(cuts)
    before_bytes = _running([sizes[k]["size"] if k in sizes else 0 for k in range(n_units)])
    before_rows = _running([sizes[k]["rows"] if k in sizes else 0 for k in range(n_units)])
    in_unit = Window.partitionBy("unit").orderBy("key", "second", "id", "size", "crc")
    here = in_unit.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = _pick(before_bytes, F.col("unit"), "bigint") + F.sum("size").over(here) - F.col("size") / 2
    numbered = durable(
        united.select(
            "id", "size", "crc",
            F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(max(1, total)))).cast("int")).alias("shard"),
            (_pick(before_rows, F.col("unit"), "bigint") + F.row_number().over(in_unit) - 1).alias("at"),
        ),
        "shard-rows",
    )
    starts = {r["shard"]: r["at"] for r in numbered.groupBy("shard").agg(F.min("at").alias("at")).collect()}
    return numbered.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("at") - _pick([starts.get(k, 0) for k in range(shards)], F.col("shard"), "bigint")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _running(values: list[int]) -> list[int]:
    out, total = [], 0
    for x in values:
        out.append(total)
        total += x
    return out


def _boundaries(slim: DataFrame, total: int, ranges: int) -> list[int]:
    """Keys at the quantiles of a size-weighted sample; large records count by their size."""
    step = max(1.0, total / (ranges * KEYS_PER_RANGE))
    drawn = (
        slim.where(unit_interval(F.lit(11), "id", "key") < F.col("size") / step)
        .select("key", F.greatest(F.col("size") / step, F.lit(1.0)).alias("weight"))
        .groupBy("key")
        .agg(F.sum("weight").alias("weight"))
        .collect()
    )
    drawn.sort(key=lambda r: r["key"])
    whole = sum(r["weight"] for r in drawn)
    bounds, so_far = [], 0.0
    for r in drawn:
        if so_far >= (len(bounds) + 1) * whole / ranges:
            bounds.append(r["key"])
            while so_far >= (len(bounds) + 1) * whole / ranges and len(bounds) < ranges - 1:
                bounds.append(r["key"])
        so_far += r["weight"]
    return sorted(set(bounds[: ranges - 1]))
