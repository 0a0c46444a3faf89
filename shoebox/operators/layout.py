"""Justified rows of a view: pictures fill each row's width at nearly one height."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How much a group's last row may be stretched, bounds of aspects, heights in parts of the wanted one, boost of upright rows.
LAST_STRETCH, ASPECTS, HEIGHTS, BOOST, BOOST_ASPECT = 1.5, (0.25, 4.0), (0.5, 2.0), 1.6, 1.5


def packed(aspects: Iterable[float | None], width: float, height: float, gap: float) -> Iterator[tuple[int, float]]:
    """(pictures, height) of each row of one group.

    A row ends with the picture that brings it down to the height it should have; the last
    row keeps that height when filling the width would stretch it too much.
    """
    wanted = lambda total, n: height * (1.0 if total / n >= BOOST_ASPECT else min(BOOST, math.sqrt(BOOST_ASPECT * n / total)))
    limited = lambda h: min(height * HEIGHTS[1], max(height * HEIGHTS[0], h))
    total, n = 0.0, 0
    for aspect in aspects:
        total += min(ASPECTS[1], max(ASPECTS[0], aspect if aspect and aspect > 0 else 1.0))
        n += 1
        filled = (width - gap * (n - 1)) / total
        if filled <= wanted(total, n):
            yield n, limited(filled)
            total, n = 0.0, 0
    if n:
        filled, natural = (width - gap * (n - 1)) / total, wanted(total, n)
        yield n, limited(filled if filled <= natural * LAST_STRETCH else natural)


def rows(items: DataFrame, headers: DataFrame, width: float, height: float, gap: float = 4.0) -> DataFrame:
    """(first, n, height, y) of the rows of a numbered view (pos, width, height), each group packed by itself.

    Groups are the headers' stretches; without headers all items are one. A group is packed in
    one task, as each row depends on the one before it, and holds two numbers an item.
    """
    if width <= 0 or height <= 0:
        return items.sparkSession.createDataFrame([], "first bigint, n bigint, height double, y double")
    starts = headers.select(F.col("start_index").alias("pos"), F.lit(1).alias("__opens"))
    begun = items.select("pos", (F.col("width") / F.col("height")).alias("aspect")).join(starts, "pos", "left")
    grouped = begun.withColumn("run", F.sum(F.coalesce("__opens", F.lit(0))).over(Window.orderBy("pos")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        out, first = [], int(pdf["pos"].iat[0])
        for n, h in packed((None if pd.isna(a) else a for a in pdf["aspect"]), width, height, gap):
            out.append((first, n, h))
            first += n
        return pd.DataFrame(out, columns=["first", "n", "height"])

    found = grouped.groupBy("run").applyInPandas(pack, "first bigint, n bigint, height double")
    above = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("y", F.coalesce(F.sum(F.col("height") + gap).over(above), F.lit(0.0)))
