"""Mixing sources to target weights by the cube method.

Every source gets a target share of all words; a document's expected number of copies is
its source's target over its source's size. The whole part is taken outright. The rest is
an inclusion probability, rounded to 0 or 1 by the cube method: the flight phase moves the
probabilities of a window of documents, longest first, along the null space of the two
constraints (documents and words taken), until at most two per block are left. Blocks' leftovers fly
again, and again, until at most two are left per source; those land on the corner that
is nearest to the balance.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce
from itertools import islice
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import WORD, durable, text_or_empty

#: Documents in a block of the flight phase.
BLOCK = 1024
#: Documents that move together; many short ones can then balance a long one.
WINDOW = 64
#: A document is taken so many times at most.
MOST_COPIES = 3
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
_NEAR = 1e-9


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: float = MOST_COPIES) -> dict[str | None, float]:
    """The words wanted of each source: shares by weight, cut at most times its size, the excess shared anew."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {name: weights[k % len(weights)] for k, (name, _) in enumerate(ordered)}
    cap = {name: most * size for name, size in ordered}
    got: dict[str | None, float] = {}
    left, free = float(sum(size for _, size in ordered)), [name for name, _ in ordered]
    while free:
        each = left / sum(weight[x] for x in free)
        above = [x for x in free if each * weight[x] > cap[x]]
        if not above:
            return got | {x: each * weight[x] for x in free}
        for x in above:
            got[x] = float(cap[x])
            left -= cap[x]
        free = [x for x in free if x not in got]
    return got


def fly(units: Iterable[tuple[int, float, int]], draw: Random) -> tuple[dict[int, float], list[tuple[int, float]]]:
    """The flight phase over (index, probability, size): settled ones as 0.0 or 1.0, and at most two others."""
    settled: dict[int, float] = {}
    left = [u for u in units]
    for k, p, _ in left:
        if p < _NEAR or p > 1 - _NEAR:
            settled[k] = float(round(p))
    waiting = iter([u for u in left if u[0] not in settled])
    index, p, size = np.empty(0, np.int64), np.empty(0), np.empty(0)
    while True:
        more = list(islice(waiting, WINDOW - len(index)))
        if more:
            i, q, s = zip(*more)
            index, p, size = np.append(index, i).astype(np.int64), np.append(p, q), np.append(size, s)
        along = _direction(size)
        if along is None:
            return settled, list(zip(index.tolist(), p.tolist()))
        up, down = along > 0, along < 0
        ahead = min(((1 - p[up]) / along[up]).min(), (p[down] / -along[down]).min())
        back = min((p[up] / along[up]).min(), ((1 - p[down]) / -along[down]).min())
        p = np.clip(p + along * (ahead if draw.random() * (ahead + back) < back else -back), 0, 1)
        done = (p < _NEAR) | (p > 1 - _NEAR)
        settled.update(zip(index[done].tolist(), np.round(p[done]).tolist()))
        index, p, size = index[~done], p[~done], size[~done]


def _direction(size: np.ndarray) -> np.ndarray | None:
    """A vector that keeps the sums of 1 and of the size: the first document that can move, projected on the null space."""
    n = len(size)
    if n < 2:
        return None
    off = size - size.mean()
    spread = off @ off
    for k in range(n):
        along = -(np.full(n, 1 / n) + (off[k] / spread * off if spread > 0 else 0.0))
        along[k] += 1
        along[np.abs(along) < 1e-10] = 0.0
        if np.abs(along).max() > 1e-6:
            return along
    return None


def land(units: list[tuple[int, float, int]]) -> dict[int, float]:
    """At most two leftover units go to the corner nearest to the words, then the documents, they stand for."""
    words, count = sum(p * s for _, p, s in units), sum(p for _, p, _ in units)
    corners = [[]]
    for _ in units:
        corners = [[*c, x] for c in corners for x in (0, 1)]
    best = min(corners, key=lambda c: (abs(sum(x * u[2] for x, u in zip(c, units)) - words), abs(sum(c) - count), c))
    return {u[0]: float(x) for u, x in zip(units, best)}


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    # long documents first, so that what is left over at the end is short
    pdf = pdf.sort_values(["size", "id", "tie"], ascending=[False, True, True], na_position="first", kind="stable").reset_index(drop=True)
    draw = Random(f"{pdf['rank'].iat[0]} {pdf['block'].iat[0]} {pdf['turn'].iat[0]}")
    open_ = pdf.index[(pdf["p"] > _NEAR) & (pdf["p"] < 1 - _NEAR)]
    p = pdf["p"].round(9).where(~pdf.index.isin(open_), pdf["p"])
    settled, left = fly(zip(open_.tolist(), pdf["p"][open_].tolist(), pdf["size"][open_].tolist()), draw)
    if pdf["last"].iat[0]:
        settled |= land([(k, x, int(pdf["size"].iat[k])) for k, x in left])
        left = []
    p.update(pd.Series(settled | dict(left), dtype="float64"))
    return pdf.assign(p=p)


_FLOWN = "id bigint, tie bigint, size bigint, rank int, base int, p double, block bigint, turn int, last boolean"


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes every row: id, tie (hash of the text), size, source, source_size, target, copies.

    size counts the text's words (null: 0). A null source is a source of its own, ordered last.
    Documents without words are never taken. Repeated rows are sampled apart from each other.
    The driver sees one row for each source.
    An empty table gives no rows; other columns are ignored. Draws are seeded by source and
    block, and blocks hold their rows in order of size, id and text, so reruns agree.
    """
    spark = df.sparkSession
    slim = durable(
        df.select(
            F.col(id_col).cast("bigint").alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("bigint").alias("size"),
            F.xxhash64(text_or_empty(text_col)).alias("tie"),
        ),
        "mix-sizes",
    )
    # one row for each source
    known = [(r["source"], r["size"], r["rows"]) for r in slim.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()]
    wanted = targets([(s, n) for s, n, _ in known])
    plan = []
    for rank, (source, size, rows) in enumerate(sorted(known, key=lambda x: (x[0] is None, x[0] or ""))):
        rate = wanted[source] / size if size else 0.0
        base = min(MOST_COPIES, math.floor(rate + _NEAR))
        plan.append((source, rank, int(size), float(wanted[source]), base, max(0.0, rate - base) if base < MOST_COPIES else 0.0, max(1, math.ceil(rows / BLOCK))))
    sources = spark.createDataFrame(plan, "source string, rank int, source_size bigint, target double, base int, p double, blocks int")
    few = len(plan) <= 100_000  # otherwise Spark joins them by shuffling
    joined = slim.join(F.broadcast(sources) if few else sources, slim["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    block = F.pmod(F.xxhash64(F.lit(3), "id", "tie"), F.col("blocks").cast("bigint"))
    joined = joined.withColumns({c: F.when(F.col("size") > 0, F.col(c)).otherwise(0) for c in ("base", "p")})
    flying = joined.select("id", "tie", "size", "rank", "base", "p", block.alias("block"), F.lit(1).alias("turn"), (F.col("blocks") == 1).alias("last"))
    whole = (F.col("p") < _NEAR) | (F.col("p") > 1 - _NEAR)
    settled = []
    for turn in range(2, 100):
        flown = durable(flying.groupBy("rank", "block").applyInPandas(_block, _FLOWN), "mix-flight")
        settled.append(flown.where(whole))
        left = [(r["rank"], math.ceil(r["count"] / BLOCK)) for r in flown.where(~whole).groupBy("rank").count().collect()]
        if not left:
            break
        dealt = spark.createDataFrame(left, "rank int, blocks bigint")
        flying = flown.where(~whole).drop("block", "turn", "last").join(F.broadcast(dealt) if few else dealt, "rank")
        flying = flying.withColumns({"block": F.pmod(F.xxhash64(F.lit(turn), "id", "tie"), F.col("blocks")), "turn": F.lit(turn), "last": F.col("blocks") == 1})
        flying = flying.select("id", "tie", "size", "rank", "base", "p", "block", "turn", "last")
    taken = reduce(DataFrame.unionByName, settled).select("id", "tie", "size", "rank", (F.col("base") + F.round("p")).cast("int").alias("copies"))
    by_rank = sources.select("rank", "source", "source_size", "target")
    return taken.join(F.broadcast(by_rank) if few else by_rank, "rank").drop("rank")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of df as often as the mix takes them, with df's own columns, whatever their names.

    Rows that agree in id, text and source are told apart by nothing the mix looks at: one of
    them appears as often as it takes all. Null ids and sources, empty tables and texts are
    treated as in copies.
    """
    names = ("i", "t", "s")
    wanted = copies(df, id_col, text_col, source_col).groupBy("id", "tie", "source").agg(F.sum("copies").cast("int").alias("copies"), (F.count("*") > 1).alias("again"))
    wanted = wanted.where("copies > 0").select(*[F.col(c).alias(n) for c, n in zip(("id", "tie", "source"), names)], "copies", "again")
    key = [F.col(f"`{id_col}`").cast("bigint"), F.xxhash64(text_or_empty(f"`{text_col}`")), F.col(f"`{source_col}`").cast("string")]
    marked = df.select(F.struct(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for c, n in zip(key, ("id", "tie", "source"))]).alias("m")).select("m.*")
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")) & F.col("source").eqNullSafe(F.col("s"))
    found = marked.join(wanted, same).select("row", *names, "copies", "again")
    one = found.where("again").groupBy(*names).agg(F.min_by("row", F.xxhash64("row")).alias("row"), F.max("copies").alias("copies"))
    every = found.where(~F.col("again")).select("row", "copies").union(one.select("row", "copies"))
    return every.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
