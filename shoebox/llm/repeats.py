"""Removing repeated strings of bytes with suffix arrays of the places where texts may repeat.

A string of LENGTH bytes that occurs twice has an equal anchor in both places (see anchors),
so occurrences meet at anchor hashes, which are spread over the executors. Contexts that
occur twice as a whole are settled by counting. Others, which differ from place to place
around one anchor, are trimmed to the longest extension that any other shares on either side,
found between neighbours in sorted order; what stays distinct under an anchor is put into one
suffix array, in which equal strings of LENGTH bytes are neighbours.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.anchors import LENGTH, _mixed, anchors
from shoebox.llm.common import bounded_batches, discard, durable, text_bytes, text_or_empty
from shoebox.llm.suffixes import suffix_array

#: Bits of the filter that tells tasks which contexts to send, 8 MB; a fuller filter sends some for nothing.
FILTER_BITS = 1 << 26

_ANCHOR = pa.schema([("key", pa.int64()), ("tie", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("h", pa.int64()), ("c", pa.int64())])


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key and tie, 128 bits for each different pair of id and text, then the text."""
    tie = F.xxhash64(text_or_empty(text_col))
    return df.select(F.xxhash64(F.lit(5), F.col(id_col).cast("bigint"), tie).alias("key"), tie.alias("tie"), F.col(text_col).cast("string").alias("text"))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        parts, sizes = [], []
        for data in text_bytes(batch.column(2)):
            first, last, _, h, c = anchors(np.frombuffer(data, np.uint8))
            sizes.append(len(first))
            if len(first):
                parts.append((first.astype(np.int32), last.astype(np.int32), h.view(np.int64), c.view(np.int64)))
        columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, np.int32)] * 2 + [np.empty(0, np.int64)] * 2
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(keys, sizes), np.repeat(ties, sizes), *columns)], schema=_ANCHOR)


def _slots(key: np.ndarray, tie: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Three places of the filter for each occurrence."""
    x = _mixed(key.view(np.uint64) ^ _mixed(tie.view(np.uint64) + _mixed(first.astype(np.uint64))))
    return np.stack([(x >> np.uint64(s)) % np.uint64(FILTER_BITS) for s in (0, 19, 38)])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the filter with the bits of these occurrences."""
    for batch in batches:
        slots = np.unique(_slots(*(batch.column(k).to_numpy() for k in range(3))))
        words, where = np.unique(slots >> np.uint64(6), return_inverse=True)
        masks = np.zeros(len(words), np.uint64)
        np.bitwise_or.at(masks, where, np.uint64(1) << (slots & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(masks.view(np.int64))], names=["word", "mask"])


def _contexts(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The bytes around the anchor of each occurrence (key, tie, first, h, c, n) in wanted."""
    spark = df.sparkSession
    words = wanted.select("key", "tie", "first").mapInArrow(_bits, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    for row in words.toLocalIterator():  # no more than the filter has words
        bits[row["word"]] = row["mask"] & 0xFFFFFFFFFFFFFFFF
    shared = spark.sparkContext.broadcast(bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            rows = []
            for key, tie, data in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), text_bytes(batch.column(2))):
                first, last, at, h, c = anchors(np.frombuffer(data, np.uint8))
                slots = _slots(np.full(len(first), key), np.full(len(first), tie), first)
                hit = np.all(bits[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1), axis=0)
                for k in np.flatnonzero(hit):
                    content, off = data[first[k] : last[k] + LENGTH], int(at[k] - first[k])
                    rows.append((int(key), int(tie), int(first[k]), off, content, content[:off][::-1]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["key", "tie", "first", "off", "content", "turned"])

    bounded_batches(spark)
    sent = _keyed(df, id_col, text_col).mapInArrow(cut, "key bigint, tie bigint, first int, off int, content binary, turned binary")
    joined = sent.join(wanted, ["key", "tie", "first"]).dropDuplicates(["h", "c"])
    return durable(joined.select("h", "c", "n", "off", "content", "turned"), "repeat-contexts")


def common(a: bytes, b: bytes) -> int:
    """The length of the longest common beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def _shared_ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to rows sorted by h and their last column how much of it a neighbour under the same h shares.

    A part's outermost rows can't see all their neighbours and count as shared to the end.
    """
    held = None  # the row before, with what it shares with the one before it
    for batch in batches:
        rows, shares = [], []
        for row in zip(*(x.to_pylist() for x in batch.columns)):
            if held is None:
                held = (row, len(row[-1]))
                continue
            with_next = common(held[0][-1], row[-1]) if held[0][0] == row[0] else 0
            rows.append(held[0])
            shares.append(max(held[1], with_next))
            held = (row, with_next)
        yield _widened(batch.schema, rows, shares)
    if held is not None:
        yield _widened(batch.schema, [held[0]], [len(held[0][-1])])


def _widened(schema: pa.Schema, rows: list[tuple], shares: list[int]) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(shares, pa.int32())], names=[*schema.names, "shared"])


def _trimmed(contexts: DataFrame) -> DataFrame:
    """(h, c, shift, n, off, content): contexts cut to what others under their anchor share on both sides."""
    ahead = contexts.withColumn("right", F.expr("substring(content, off + 1)"))
    ahead = ahead.repartitionByRange("h", "right", "c").sortWithinPartitions("h", "right", "c").select("h", "c", "n", "off", "content", "turned", "right")
    ddl = "h bigint, c bigint, n bigint, off int, content binary, turned binary, right binary, shared int"
    ahead = durable(ahead.mapInArrow(_shared_ahead, ddl).where(F.col("off") + F.col("shared") >= LENGTH).drop("right").withColumnRenamed("shared", "ahead"), "repeat-ahead")
    back = ahead.repartitionByRange("h", "turned", "c").sortWithinPartitions("h", "turned", "c").select("h", "c", "n", "off", "content", "ahead", "turned")
    back = back.mapInArrow(_shared_ahead, "h bigint, c bigint, n bigint, off int, content binary, ahead int, turned binary, shared int")
    back = back.where(F.col("shared") + F.col("ahead") >= LENGTH)
    trimmed = durable(back.select("h", "c", (F.col("off") - F.col("shared")).alias("shift"), "n", F.col("shared").alias("off"), F.expr("substring(content, off - shared + 1, shared + ahead)").alias("content")), "repeat-trimmed")
    discard(contexts, ahead)
    return trimmed


def repeated_parts(strings: list[tuple[bytes, int]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For strings with the number of places each has: the parts covered by strings of length bytes that start in two places or more."""
    if len(strings) == 1 and strings[0][1] > 1:  # all of it is in several places
        return [[(0, len(strings[0][0]))] if len(strings[0][0]) >= length else []]
    text: list[int] = []
    begins = []
    for content, _ in strings:
        begins.append(len(text))
        text += [b + 1 for b in content]
        text.append(0)
    owner = np.repeat(np.arange(len(strings)), [len(s) + 1 for s, _ in strings])
    marks: list[list[int]] = [[] for _ in strings]
    run: list[tuple[int, int]] = []
    window = None

    def close() -> None:
        if len(run) > 1 or run and strings[run[0][0]][1] > 1:
            for k, at in run:
                marks[k].append(at)

    for start in suffix_array(text):
        k = int(owner[start])
        at = start - begins[k]
        content = strings[k][0]
        if len(content) - at < length:
            continue
        here = content[at : at + length]
        if here != window:
            close()
            run, window = [], here
        run.append((k, at))
    close()
    return [joined((x, x + length) for x in sorted(m)) for m in marks]


def joined(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlapping and touching ones made one."""
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeated parts of the strings under each h; rows are sorted by h and may part over batches."""

    def done(rows: list[tuple]) -> list[tuple]:
        parts = repeated_parts([(r[2], r[3]) for r in rows])
        return [(r[0], r[1], a, b) for r, p in zip(rows, parts) for a, b in p]

    held: list[tuple] = []
    for batch in batches:
        out = []
        for row in zip(*(x.to_pylist() for x in batch.columns)):
            if held and held[0][0] != row[0]:
                out += done(held)
                held = []
            held.append(row)
        yield _parts(out)
    yield _parts(done(held) if held else [])


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["h", "string", "from", "to"])


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, tie, from, to): byte spans of each text that strings repeated elsewhere cover; they may overlap."""
    spark = df.sparkSession
    bounded_batches(spark)
    found = durable(_keyed(df, id_col, text_col).where(F.octet_length("text") >= LENGTH).mapInArrow(_found, "key bigint, tie bigint, first int, last int, h bigint, c bigint"), "repeat-anchors")
    # a table of its own, so that a hot hash's rows can be split in the join
    twice = durable(found.groupBy("h").count().where("count > 1").select("h"), "repeat-twice")
    seen = durable(found.join(twice, "h"), "repeat-seen")
    discard(found, twice)
    _tidy(spark)
    contexts = seen.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("key", "tie", "first")).alias("one"))
    known = durable(contexts, "repeat-known")
    whole = known.where("n > 1").select("h", "c")
    mixed = known.join(known.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "h")
    wanted = durable(mixed.select("one.key", "one.tie", "one.first", "h", "c", "n"), "repeat-wanted")
    trimmed = _trimmed(_contexts(df, wanted, id_col, text_col))
    _tidy(spark)
    strings = trimmed.withColumn("string", F.xxhash64("off", "content"))
    distinct = strings.groupBy("h", "string").agg(F.min("content").alias("content"), F.sum("n").alias("n"))
    parts = distinct.select("h", "string", "content", "n").repartition(F.col("h")).sortWithinPartitions("h", "string").mapInArrow(_arrays, "h bigint, string bigint, from int, to int")
    inside = strings.select("h", "c", "shift", "string").join(parts, ["h", "string"])
    inside = durable(inside.select("h", "c", (F.col("shift") + F.col("from")).alias("from"), (F.col("shift") + F.col("to")).alias("to")), "repeat-inside")
    discard(trimmed, wanted)
    as_whole = seen.join(whole, ["h", "c"]).select("key", "tie", F.col("first").alias("from"), (F.col("last") + LENGTH).alias("to"))
    as_part = seen.join(inside, ["h", "c"]).select("key", "tie", (F.col("first") + F.col("from")).alias("from"), (F.col("first") + F.col("to")).alias("to"))
    return as_whole.union(as_part)


def _tidy(spark) -> None:
    """Lets Spark see that earlier steps' shuffle files are no longer needed."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the bytes that stay.

    A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in the
    same text included. Null and shorter texts lose nothing; repeated rows are copies of each
    other; null ids stay null; other columns are ignored.
    """
    cover = durable(spans(df, id_col, text_col).distinct().groupBy("key", "tie").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans")), "repeat-spans")
    _tidy(df.sparkSession)
    tie = F.xxhash64(text_or_empty(text_col))
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), tie.alias("tie")).withColumn("key", F.xxhash64(F.lit(5), "doc_id", "tie"))
    bounded_batches(df.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, cover in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist()):
                runs = joined((x["from"], x["to"]) for x in cover or ())
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((len(data), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, list(_KEPT)[1:]))], schema=_KEPT)

    joined_rows = rows.join(cover, ["key", "tie"], "left").select("doc_id", "text", "spans")
    return joined_rows.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
