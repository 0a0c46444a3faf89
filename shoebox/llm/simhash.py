"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two that differ in at most four bits share at least four
positional bytes, so they meet in the inverted index. Its keys are three positional bytes at
a time, from a set of 20 triples of positions of which any four positions hold one. Under a
key the shared positional bytes of a pair are tallied, pairs with fewer than four are
dropped, and the rest verified bit by bit. Only links that join something new are kept, and
a key with very many fingerprints is dealt in blocks, each pair of blocks by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm import nearcopies
from shoebox.llm.common import bounded_batches, durable, text_bytes, text_or_empty
from shoebox.llm.graph import components

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Pairs that differ in at most MOST_BITS bits share this many of the eight positional bytes.
LEAST_BYTES = 8 - MOST_BITS
#: Fingerprints under a key beyond which it is dealt in blocks of this size.
BLOCK = 512
#: Keys of rows are broadcast up to so many, 16 bytes each; beyond that the rows are joined by shuffling.
BROADCAST_ROWS = 200_000
#: Under a key with more fingerprints than this, links form a forest instead of all pairs.
FEW = 8


def triples() -> list[tuple[int, int, int]]:
    """20 triples of 8 positions such that any 4 positions hold one: inside each of three parts, or two in one and one in the next."""
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    found = [t for p in parts for t in combinations(p, 3)]
    return found + [(*two, x) for k, p in enumerate(parts) for two in combinations(p, 2) for x in parts[(k + 1) % 3]]


def fingerprint(data: bytes, words: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; 0 for a text without words."""
    cut = data.lower().split()
    if not cut:
        return 0
    line = b" ".join(cut)
    ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(words, len(cut))
    n, ones, digest = len(cut) - size + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, 65536):
        stop = min(n, k + 65536)
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[k:stop].tolist(), ends[k + size - 1 : stop + size - 1].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * ones > n))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tie, fp): the id, a hash of the text, and the fingerprint's 64 bits as a long."""
    bounded_batches(df.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("fp", pa.int64())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x) for x in text_bytes(batch.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], schema=schema)

    text = F.col(text_col).cast("string")
    return durable(df.select(F.col(id_col).cast("bigint"), F.xxhash64(text_or_empty(text_col)).alias("tie"), text).mapInArrow(made, "id bigint, tie bigint, fp bigint"), "simhash")


def _keys(fp: Column) -> Column:
    """A key for each triple of positions: its number, then the three bytes."""

    def byte(p: int) -> Column:
        return F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("bigint"))

    return F.array(*[F.lit(k << 24).cast("bigint") + byte(a) * 65536 + byte(b) * 256 + byte(c) for k, (a, b, c) in enumerate(triples())])


def _close(x: np.ndarray) -> np.ndarray:
    """Which differences keep enough positional bytes, and then few enough bits."""
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= LEAST_BYTES
    shared[shared] = np.bitwise_count(x[shared]) <= MOST_BITS
    return shared


def _forest(fps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join everything that close pairs join: each fingerprint is looked for once from every one found."""
    a, b, left = [], [], fps
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            here = todo.pop()
            near = _close(left ^ here)
            found, left = left[near], left[~near]
            a.append(np.full(len(found), here))
            b.append(found)
            todo += list(found)
    return a, b


def _linked(group: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
    """The links inside groups, which lie together."""
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else np.zeros(1, int)
    sizes, a, b = np.diff(edge), [], []
    few = np.repeat(sizes <= FEW, sizes)
    g, f = group[few], fps[few]
    for step in range(1, FEW):
        at = np.flatnonzero(g[step:] == g[:-step])
        if not len(at):
            break
        at = at[_close(f[at] ^ f[at + step])]
        a.append(f[at])
        b.append(f[at + step])
    for k in np.flatnonzero(sizes > FEW):
        more = _forest(fps[edge[k] : edge[k + 1]])
        a += more[0]
        b += more[1]
    both = [np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (a, b)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in both], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links under every key of rows sorted by key; a key's rows may lie in several batches."""
    group, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        group = np.concatenate([group, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
        whole = int(np.searchsorted(group, group[-1])) if len(group) else 0
        if whole:
            yield _linked(group[:whole], fps[:whole])
            group, fps = group[whole:], fps[whole:]
    yield _linked(group, fps)


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints fp that join all that differ in at most MOST_BITS bits."""
    index = distinct.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp")
    hot = durable(index.groupBy("key").count().where(F.col("count") > BLOCK), "simhash-hot")
    rows = index
    if hot.take(1):
        known = hot.select(F.col("key").alias("k"), F.ceil(F.col("count") / BLOCK).alias("blocks"))
        rows = index.join(known, index["key"] == known["k"], "left_anti")
        dealt = index.join(known, index["key"] == known["k"]).select("key", "fp", "blocks", F.pmod(F.xxhash64("fp"), F.col("blocks")).alias("mine"))
        dealt = dealt.select("key", "fp", "mine", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
        # a number for each key and pair of blocks that no plain key has
        pair = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
        rows = rows.union(dealt.select(F.when(pair < 0, pair).otherwise(-1 - pair), "fp"))
    dealt_out = rows.repartition(F.col("key")).sortWithinPartitions("key")
    return dealt_out.mapInArrow(_links, "a bigint, b bigint")


def grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tie, fp, root, component_id) for every row.

    Rows whose fingerprints link, directly or through others, have one root and one
    component_id: the smallest id among them, null only if all are. Null and empty texts have
    the fingerprint zero, which links like any other. Repeated rows each get a row; an empty
    table gives none; other columns are ignored.
    """
    rows = fingerprints(df, id_col, text_col)
    distinct = durable(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    stars = components(links(distinct))
    members = stars.union(stars.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "fp")
    members = members.join(distinct, "fp")
    least = members.groupBy("root").agg(F.min("least").alias("component"))
    known = durable(members.join(least, "root").select(F.col("fp").alias("f"), "root", "component"), "simhash-members")
    named = distinct.join(known, distinct["fp"] == known["f"], "left")
    named = named.select(F.col("fp").alias("f"), F.coalesce("root", "fp").alias("root"), F.when(F.col("f").isNull(), F.col("least")).otherwise(F.col("component")).alias("component_id"))
    return rows.join(named, rows["fp"] == named["f"]).drop("f")


def _of_sets(hashes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Fingerprints of sets of shingles' hashes that lie one behind the other: a bit is 1 if it is set in over half of them."""
    out = np.empty(len(edge) - 1, np.uint64)
    for k, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
        ones = np.zeros(64, np.int64)
        for at in range(a, b, 65536):
            ones += np.unpackbits(hashes[at : min(b, at + 65536)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > b - a, bitorder="little").view("<u8")[0]
    return out


def candidates(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that join all rows (node, fp) whose fingerprints link, directly or through others."""
    distinct = durable(rows.groupBy("fp").agg(F.min("node").alias("least")), "simhash-texts")
    same = rows.join(distinct, "fp").where(F.col("node") != F.col("least")).select(F.col("least").alias("a"), F.col("node").alias("b"))
    x, y = (distinct.select(F.col("fp").alias(f), F.col("least").alias(n)) for f, n in (("a", "x"), ("b", "y")))
    across = links(distinct.select("fp")).join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.union(across).distinct()


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group of near copies: the one with the smallest id, of those the one whose text has the smallest hash.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or
    more, directly or through others. Texts whose fingerprints over the shingles meet in the
    inverted index are verified first; of similar texts many differ in more bits than
    MOST_BITS, so those not joined yet are looked for by nearcopies, which loses none.

    Texts without words are alike, and null texts count as empty. A null id is the smallest of
    its group only if all are null. Of rows that repeat id and text one stays. An empty table
    gives none. Other columns, whatever their names, come along.
    """
    bounded_batches(df.sparkSession)
    rows = nearcopies.keyed(df, id_col, text_col)
    schema = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("sketch", pa.binary()), ("small", pa.binary()), ("fp", pa.int64())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, of = nearcopies.sets_of(list(text_bytes(batch.column(2))))
            edge = np.searchsorted(of, np.arange(len(batch) + 1))
            sketches, small = ([nearcopies.sketch(hashes[a:b], bits) for a, b in zip(edge.tolist(), edge[1:].tolist())] for bits in (0, nearcopies.SMALL))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(edge), pa.int32()), pa.array(sketches, pa.binary()), pa.array(small, pa.binary()), pa.array(_of_sets(hashes, edge).view(np.int64))], schema=schema)

    known = durable(rows.mapInArrow(made, "id bigint, node bigint, size int, sketch binary, small binary, fp bigint"), "simhash-sets")
    parts = nearcopies.linked(rows, known, candidates(known.select("node", "fp").distinct()))
    slim = known.select("id", "node")
    named = slim.join(parts, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"))
    one = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("one"))
    kept = one.select(F.col("one.id").alias("i"), F.col("one.node").alias("n"))
    lost = durable(slim.distinct().join(kept, F.col("id").eqNullSafe(F.col("i")) & (F.col("node") == F.col("n")), "left_anti"), "simhash-lost")
    again = durable(slim.groupBy("id", "node").count().where("count > 1").select("id", "node"), "simhash-again")
    mark = F.struct(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").cast("bigint").alias("id"), F.xxhash64(text_or_empty(f"`{text_col}`")).alias("node"))
    held = df.select(mark.alias("m")).select("m.row", "m.id", "m.node")

    def among(keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("id").alias("i"), F.col("node").alias("n"))
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
        return held.join(keys, F.col("id").eqNullSafe(F.col("i")) & (F.col("node") == F.col("n")), how)

    gone = lost.union(again)
    out = among(gone, "left_anti").select("row")
    if again.take(1):
        first = again.join(lost, again["id"].eqNullSafe(lost["id"]) & (again["node"] == lost["node"]), "left_anti")
        out = out.union(among(first, "left_semi").groupBy("id", "node").agg(F.first("row").alias("row")).select("row"))
    return out.select("row.*")
