"""Near-duplicate pictures by the Hamming distance of perceptual hashes.

Two hashes that differ in at most t bits agree in one of t + 1 bands of bits, so pairs come
from an equi-join of bands and are then verified. Files that share a set are never a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.functions.scalars import hamming
from shoebox.operators.lineage import checkpointed

BITS = 64


def _bands(value: Column, threshold: int, bits: int) -> Column:
    cuts = [bits * k // (threshold + 1) for k in range(threshold + 2)]
    part = lambda a, b: F.shiftrightunsigned(value, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1).cast("bigint"))
    return F.array(*[F.struct(F.lit(k).alias("band"), part(a, b).alias("bits")) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a])


def edges(hashes: DataFrame, sets: DataFrame | None, threshold: int, column: str = "phash", bits: int = BITS) -> DataFrame:
    """(a, b, distance) of files (path, ord, hash) within threshold bits, a before b; null hashes are not compared.

    Pairs that share a set (path, tag) are left out.
    """
    rows = hashes.filter(F.col(column).isNotNull()).select("path", "ord", F.col(column).alias("h"))
    if threshold >= bits:
        raise ValueError("the threshold reaches every pair")
    banded = rows.select("path", "ord", "h", F.explode(_bands(F.col("h"), threshold, bits)).alias("x")).select("path", "ord", "h", "x.band", "x.bits")
    left = banded.select(F.col("path").alias("a"), F.col("ord").alias("ao"), F.col("h").alias("ah"), "band", "bits")
    right = banded.select(F.col("path").alias("b"), F.col("ord").alias("bo"), F.col("h").alias("bh"), "band", "bits")
    distance = hamming(F.col("ah"), F.col("bh"))
    pairs = left.join(right, ["band", "bits"]).filter((F.col("ao") < F.col("bo")) & (distance <= threshold)).select("a", "b", distance.alias("distance")).distinct()
    if sets is None:
        return pairs
    both = sets.select(F.col("path").alias("a"), "tag").join(sets.select(F.col("path").alias("b"), "tag"), "tag").select("a", "b").distinct()
    return pairs.join(both, ["a", "b"], "left_anti")


def components(links: DataFrame) -> DataFrame:
    """(path, group_id) for every path of the links (a, b); group_id is the group's smallest path.

    Every round gives a path the least label next to it, then the label of that label, so
    rounds grow with the logarithm of the longest chain; each is cut by a checkpoint.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = checkpointed(both.union(both.select("v", "u")).distinct())
    labels = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("label"))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, "u").select("u", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = step.select(F.col("u").alias("label"), F.col("label").alias("far"))
        after = checkpointed(step.join(jump, "label", "left").select("u", F.least(F.col("label"), F.coalesce("far", F.col("label"))).alias("label"), "old"))
        if not after.filter("label <> old").take(1):
            return after.select(F.col("u").alias("path"), F.col("label").alias("group_id"))
        labels = after.select("u", "label")


def groups(hashes: DataFrame, sets: DataFrame | None, threshold: int, column: str = "phash", bits: int = BITS) -> DataFrame:
    """The members of every duplicate group: group_id, path, the hash of the group's first member, and whether the file is its best.

    Best is the most pixels (unknown ones count 0), then the smallest file; of exact ties the last.
    """
    member = components(edges(hashes, sets, threshold, column, bits))
    found = member.join(hashes, "path")
    pixels = F.coalesce(F.col("width").cast("bigint") * F.col("height"), F.lit(0))
    in_group = Window.partitionBy("group_id")
    best = in_group.orderBy(pixels.desc(), F.coalesce("file_size", F.lit(0)).asc(), F.col("ord").desc())
    first = F.min_by(F.col(column), F.col("ord")).over(in_group)
    return found.select("group_id", "path", first.alias("hash"), (F.row_number().over(best) == 1).alias("best"), "ord")


def unhashed(hashes: DataFrame, limit: int) -> DataFrame:
    return hashes.filter(F.col("phash").isNull()).select("path").orderBy("path").limit(limit)
