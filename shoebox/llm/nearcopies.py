"""Near copies by exact similarity of word shingles, found through prefixes of ordered sets.

A text's set holds its distinct runs of five words; two texts are near copies if their sets'
Jaccard similarity is at least 0.8. Under any one order of all shingles two such sets share
one among the first n - ceil(0.8 n) + 1 of each, so an index of these prefixes meets every
pair; the order puts shingles that are frequent in a sample last, which keeps groups small
and can lose nothing. Each group first links its members to one of them. Only pairs that
are in different components after that are looked at by themselves, and of sets of MANY
shingles or more only those whose SimHash fingerprints differ in at most MOST_BITS of 64 bits:
at a similarity of 0.8 a bit differs with a chance of arccos(8/9) / pi = 0.152, so a pair has
more with one of 1 in 100,000. A sketch of the sets' parities, whose differing bits never are
more than the sets' differing shingles, drops most pairs that are not alike; every link is
verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import discard, durable, span_hashes, text_bytes, text_or_empty, unit_interval, word_spans
from shoebox.llm.graph import components

WORDS = 5
#: Documents in the sample, times a shingle occurs there to go last, and shingles that do at most. They change the work alone.
SAMPLE, OFTEN, MOST_LAST = 20_000, 4, 200_000
#: Bits of the filter that tells tasks which texts' sets to send; when full it sends some for nothing.
FILTER = 1 << 22
#: Pairs that are given out together.
PAIRS = 1 << 18
#: Members of a group, dealt by its key, that others are first compared with.
PIVOTS = 4
#: Bits that the fingerprints of two similar sets of MANY shingles or more differ in at most.
MANY, MOST_BITS = 32, 22
#: Bits of the small sketch that goes along with a group's members.
SMALL = 512
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sets_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as hashes in order, and their texts' numbers.

    A text of fewer words is one shingle, and one without words too.
    """
    line = b"\n".join(t.lower() for t in texts)
    data = np.frombuffer(line, np.uint8)
    starts, ends = word_spans(data)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    of = np.searchsorted(begins, starts, "right") - 1
    words = span_hashes(data, starts, ends)
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    counts = np.diff(first)
    runs = np.flatnonzero(of[WORDS - 1 :] == of[: len(of) - WORDS + 1]) if len(of) >= WORDS else np.empty(0, np.int64)
    hashes = np.zeros(len(runs), np.uint64)
    for k in range(WORDS):
        hashes = _mixed(hashes * _MIX + words[runs + k])
    short = np.flatnonzero(counts < WORDS)
    whole = np.zeros(len(short), np.uint64)
    for k in range(WORDS - 1):
        has = counts[short] > k
        whole[has] = _mixed(whole[has] * _MIX + words[first[short[has]] + k])
    hashes, of = np.concatenate([hashes, _mixed(whole + np.uint64(1))]), np.concatenate([of[runs], short])
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    fresh = np.ones(len(of), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[fresh], of[fresh]


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_or_empty(text_col)).alias("node"), F.col(text_col).cast("string").alias("text"))


def _frequent(rows: DataFrame) -> np.ndarray:
    """Shingles that are frequent in a sample."""
    total = rows.count()
    drawn = rows.where(unit_interval(F.lit(17), "id", "node") < SAMPLE / max(1, total)).dropDuplicates(["node"]).select("text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sets_of(list(text_bytes(batch.column(0))))[0].view(np.int64))], names=["key"])

    found = drawn.mapInArrow(made, "key bigint").groupBy("key").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "key").limit(MOST_LAST)
    return np.sort(np.array([r["key"] for r in found.select("key").collect()], np.int64).view(np.uint64))


_INDEX = "key bigint, node bigint, size int, at int, ahead bigint"


def _index(rows: DataFrame) -> DataFrame:
    """(key, node, size, at, ahead): the shingles in each text's prefix, with the set's size, the place in it and the shingle before that."""
    shared = rows.sparkSession.sparkContext.broadcast(_frequent(rows))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            hashes, of = sets_of(list(text_bytes(batch.column(1))))
            late = np.isin(hashes, last)
            order = np.lexsort((hashes, late, of))
            hashes, of = hashes[order], of[order]
            sizes = np.bincount(of, minlength=len(nodes))
            at = np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of]
            n = sizes[of]
            used = at <= n - (4 * n + 4) // 5
            ahead = np.where(at > 0, np.roll(hashes, 1), np.uint64(0)).view(np.int64)
            of, n = of[used], n[used]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[used].view(np.int64)), pa.array(nodes[of]), pa.array(n.astype(np.int32)), pa.array(at[used].astype(np.int32)), pa.array(ahead[used])], names=["key", "node", "size", "at", "ahead"])

    return rows.select("node", "text").mapInArrow(made, _INDEX)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first, cut only between its values."""
    held = None
    for batch in batches:
        here = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = here if held is None else [np.concatenate(x) for x in zip(held, here)]
        whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if whole:
            yield [c[:whole] for c in held]
            held = [c[whole:] for c in held]
    if held is not None and len(held[0]):
        yield held


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of two nodes or more, without repeated rows, each row beside one of the group: the same in many groups of the same nodes, but not in all."""
    for key, node, size, at, ahead in _whole_groups(batches):
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, size, at, ahead = key[fresh], node[fresh], size[fresh], at[fresh], ahead[fresh]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.diff(np.concatenate([edge, [len(key)]]))
        group = np.repeat(np.arange(len(edge)), many)
        lot = _mixed(node.view(np.uint64) + _MIX * (key.view(np.uint64) % np.uint64(PIVOTS)))
        order = np.lexsort((lot, group))
        first, used = order[edge][group], many[group] > 1
        columns = (key, node, size, at, ahead, node[first], size[first], at[first])
        yield pa.RecordBatch.from_arrays([pa.array(c[used]) for c in columns], names=["key", "node", "size", "at", "ahead", "first", "first_size", "first_at"])


def _may(n, i, m, j) -> np.ndarray:
    """Whether sets of n and m whose first common shingle lies at i and j can be similar enough."""
    n, i, m, j = (np.asarray(x, np.int64) for x in (n, i, m, j))
    return 9 * np.minimum(n - i, m - j) >= 4 * (n + m)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a group that are in different components and can be similar enough.

    A similar pair meets under its first common shingle at the latest, where the shingles
    ahead differ; a pair with the same one ahead has met under that, and is left out here.
    """
    for key, node, size, at, ahead, part, fp, small in _whole_groups(batches):
        small = np.frombuffer(b"".join(small), np.uint64).reshape(-1, SMALL // 64)
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        a, b, held = [], [], 0
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            for k in range(lo, hi - 1):
                rest = slice(k + 1, hi)
                hit = (part[rest] != part[k]) & _may(size[rest], at[rest], size[k], at[k])
                if at[k]:
                    hit &= (ahead[rest] != ahead[k]) | (at[rest] == 0)
                hit &= (np.minimum(size[rest], size[k]) < MANY) | (np.bitwise_count((fp[rest] ^ fp[k]).view(np.uint64)) <= MOST_BITS)
                near = k + 1 + np.flatnonzero(hit)
                near = near[9 * np.bitwise_count(small[near] ^ small[k]).sum(axis=1, dtype=np.int64) <= size[near].astype(np.int64) + size[k]]
                found = node[near]
                a.append(np.minimum(found, node[k]))
                b.append(np.maximum(found, node[k]))
                held += len(found)
                if held >= PAIRS:
                    yield _pairs(a, b)
                    a, b, held = [], [], 0
        yield _pairs(a, b)


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    both = np.stack([np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b)], axis=1)
    both = np.unique(both, axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (batch.column(k).to_pylist() for k in (2, 3))
        good = np.zeros(len(x), bool)
        for k, (s, t) in enumerate(zip(x, y)):
            both = np.sort(np.concatenate([np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)]))
            good[k] = 9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both)
        at = pa.array(np.flatnonzero(good))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])


def sketch(hashes: np.ndarray, bits: int = 0) -> bytes:
    """The parity of the shingles at each place, in a power of two of bits, two for each shingle at least where none are given."""
    bits = bits or max(64, 1 << (2 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _apart(s: bytes, t: bytes) -> int:
    """Shingles that the sets of two sketches differ in at least."""
    x, y = (np.frombuffer(v, np.uint64) for v in ((s, t) if len(s) <= len(t) else (t, s)))
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) with sizes and sketches that can be similar enough: similar ones differ in a ninth of both sizes at most."""
    for batch in batches:
        n, m, s, t = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
        at = pa.array([k for k in range(len(n)) if 9 * _apart(s[k], t[k]) <= n[k] + m[k]], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])


def _verified(rows: DataFrame, sketches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough."""
    x, y = (sketches.select(F.col("node").alias(c), F.col("size").alias(n), F.col("sketch").alias(s)) for c, n, s in (("a", "n", "s"), ("b", "m", "t")))
    pairs = durable(pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "s", "t").mapInArrow(_likely, "a bigint, b bigint"), "near-likely")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    bits = np.zeros(FILTER, bool)
    for r in wanted.select((F.col("node").bitwiseAND(F.lit(FILTER - 1))).cast("int").alias("bit")).distinct().toLocalIterator():  # at most FILTER rows
        bits[r["bit"]] = True
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(bits[batch.column(0).to_numpy() & (FILTER - 1)]))
            hashes, of = sets_of(list(text_bytes(batch.column(1))))
            edge = np.searchsorted(of, np.arange(len(batch) + 1)).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashes[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())], names=["node", "set"])

    sets = rows.select("node", "text").mapInArrow(made, "node bigint, set binary").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    sets = durable(sets, "near-sets")
    x, y = (sets.select(F.col("node").alias(c), F.col("set").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    out = durable(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_similar, "a bigint, b bigint"), "near-links")
    discard(sets, pairs)
    return out


def linked(rows: DataFrame, known: DataFrame, candidates: DataFrame) -> DataFrame:
    """(node, root): the components that similar texts among rows (id, node, text) make.

    known: each node's size, sketch, small sketch and fingerprint; candidates: pairs (a, b) that are verified first.
    """
    index = _index(rows).repartition(F.col("key")).sortWithinPartitions("key", "node")
    groups = durable(index.mapInArrow(_repeated, _INDEX + ", first bigint, first_size int, first_at int"), "near-groups")
    can = (F.least("size", "first_size") * 5 >= F.greatest("size", "first_size") * 4) & (F.col("node") != F.col("first"))
    tried = groups.where(can).select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b"))
    tried = durable(tried.union(candidates).distinct(), "near-tried")
    sketches = known.select("node", "size", "sketch").dropDuplicates(["node"])
    found = _verified(rows, sketches, tried)
    parts = components(found)
    named = groups.select("key", "node", "size", "at", "ahead").join(parts, "node", "left").select("key", "node", "size", "at", "ahead", F.coalesce("root", "node").alias("part"))
    open_keys = named.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("key")
    fps = known.select("node", "fp", "small").dropDuplicates(["node"])
    named = named.join(open_keys, "key", "left_semi").join(fps, "node").select("key", "node", "size", "at", "ahead", "part", "fp", "small").repartition(F.col("key")).sortWithinPartitions("key")
    rest = durable(named.mapInArrow(_across, "a bigint, b bigint").distinct().join(tried, ["a", "b"], "left_anti"), "near-rest")
    if rest.take(1):
        found = durable(found.union(_verified(rows, sketches, rest)), "near-all")
        parts = components(found)
    discard(groups, tried, rest)
    return parts
