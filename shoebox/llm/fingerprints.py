"""Document fingerprints from prefix polynomial hashes.

Of a text's code points c the arrays P[i] = sum of (c[j] + 1) * base^j for j < i, modulo two
primes, answer in constant time whether any two spans are equal, so the longest common
extension of two places is found by binary search. A fingerprint samples these arrays at
places that the text around them chooses, so that equal stretches are sampled alike: it has
the text's length and hash, and the length and hash of each span between two places. The
likeness of two fingerprints is the part of the longer text that common runs of spans in the
same order make up; they are lined up anew after each difference and extended by binary
search over prefix hashes of the spans. An edit costs the span around it, about 30 code points.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import bounded_batches, text_bytes, text_or_empty, unit_interval
from shoebox.llm.sharding import literals, steps_where

#: Two primes below 2^31, so that products stay in 64 bits, and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1402024253)
#: Rows in a range of ids, ranges at most, and ids drawn for each range.
ROWS_PER_RANGE, MOST_RANGES, IDS_PER_RANGE = 256, 16384, 8
#: Code points that choose a place, how many are passed by for one that is chosen, and the least and most between two.
GRAM, RATE, LEAST, MOST = 8, 24, 8, 96
#: Spans looked at together when lining up two fingerprints.
PLACES = 64

_POWERS = [np.ones(1, np.int64), np.ones(1, np.int64)]


def _powers(k: int, n: int) -> np.ndarray:
    have, prime = _POWERS[k], PRIMES[k]
    while len(have) < n:
        have = np.concatenate([have, have * pow(BASES[k], len(have), prime) % prime])
    _POWERS[k] = have
    return have


_INVERSES = [np.ones(1, np.int64), np.ones(1, np.int64)]


def _inverses(k: int, n: int) -> np.ndarray:
    have, prime = _INVERSES[k], PRIMES[k]
    while len(have) < n:
        have = np.concatenate([have, have * pow(BASES[k], -len(have), prime) % prime])
    _INVERSES[k] = have
    return have


class Prefixes:
    """The prefix arrays of a text given as code points; 16 bytes for each of them."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.sums = []
        for k, prime in enumerate(PRIMES):
            sums = np.zeros(self.n + 1, np.int64)
            np.cumsum((points.astype(np.int64) + 1) * _powers(k, self.n)[: self.n] % prime, out=sums[1:])
            self.sums.append(sums % prime)

    def equal(self, at: int, other: Prefixes, other_at: int, length: int) -> bool:
        """Whether the spans of this length from the two places are equal."""
        ahead = other_at - at
        for k, prime in enumerate(PRIMES):
            mine = int(self.sums[k][at + length] - self.sums[k][at])
            its = int(other.sums[k][other_at + length] - other.sums[k][other_at])
            if ahead > 0:
                mine *= int(_powers(k, ahead + 1)[ahead])
            elif ahead < 0:
                its *= int(_powers(k, 1 - ahead)[-ahead])
            if (mine - its) % prime:
                return False
        return True

    def extension(self, at: int, other: Prefixes, other_at: int) -> int:
        """The longest common extension to the right of the two places."""
        low, high = 0, min(self.n - at, other.n - other_at)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(at, other, other_at, middle) else (low, middle - 1)
        return low

    def extension_back(self, at: int, other: Prefixes, other_at: int) -> int:
        """The longest common extension to the left of the two places."""
        low, high = 0, min(at, other_at)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(at - middle, other, other_at - middle, middle) else (low, middle - 1)
        return low

    def places(self) -> np.ndarray:
        """The chosen places, with the beginning and the end."""
        n, prime = max(0, self.n - GRAM + 1), PRIMES[0]
        sums = self.sums[0]
        moved = (sums[GRAM : GRAM + n] - sums[:n]) % prime * _inverses(0, n)[:n] % prime
        chosen, last = [0], 0
        for at in (*(np.flatnonzero(moved % RATE == 0) + GRAM).tolist(), self.n):
            while at - last > MOST:
                last += MOST
                chosen.append(last)
            if at - last >= LEAST or at == self.n > last:
                last = at
                chosen.append(at)
        return np.array(chosen)

    def fingerprint(self) -> Fingerprint:
        at, prime = self.places(), PRIMES[0]
        spans = (self.sums[0][at[1:]] - self.sums[0][at[:-1]]) % prime * _inverses(0, self.n + 1)[at[:-1]] % prime
        return Fingerprint(self.n, "".join(f"{int(s[-1]):08x}" for s in self.sums), np.diff(at), spans)


class Fingerprint:
    """A text's length and hash, and the lengths and hashes of its spans; str() and read() write and read it."""

    def __init__(self, n: int, whole: str, lengths: np.ndarray, hashes: np.ndarray):
        self.n, self.whole, self.lengths, self.hashes = n, whole, lengths.astype(np.int64), hashes.astype(np.int64)
        self.spans = self.hashes << 8 | self.lengths
        self.prefixes: Prefixes | None = None

    def __str__(self) -> str:
        packed = self.lengths.astype("u1").tobytes() + self.hashes.astype("<u4").tobytes()
        return f"{self.n:x}-{self.whole}-{base64.b64encode(packed).decode()}"

    @classmethod
    def read(cls, written: str) -> Fingerprint:
        n, whole, packed = written.split("-")
        data = base64.b64decode(packed)
        k = len(data) // 5
        return cls(int(n, 16), whole, np.frombuffer(data[:k], "u1"), np.frombuffer(data[k:], "<u4"))

    def likeness(self, other: Fingerprint) -> float:
        """Common runs of spans in order as a part of the longer text; 1 for two empty texts."""
        longer = max(self.n, other.n)
        if (self.n, self.whole) == (other.n, other.whole):
            return 1.0
        if not np.isin(self.spans, other.spans).any():
            return 0.0
        for x in (self, other):
            x.prefixes = x.prefixes or Prefixes(x.spans % PRIMES[1])
        most = min(len(self.spans), len(other.spans))
        start = self.prefixes.extension(0, other.prefixes, 0)
        end = min(self.prefixes.extension_back(len(self.spans), other.prefixes, len(other.spans)), most - start)
        runs = [(0, start), (len(self.spans) - end, end), *self._between(other, start, end)]
        return float(sum(self.lengths[at : at + n].sum() for at, n in runs)) / longer

    def _between(self, other: Fingerprint, start: int, end: int) -> list[tuple[int, int]]:
        """Common runs (first span, spans) after start and before end spans from the last, lined up anew after each difference."""
        mine, its = self.spans[start : len(self.spans) - end], other.spans[start : len(other.spans) - end]
        if not len(mine) or not len(its):
            return []
        order = np.argsort(its, kind="stable")
        keys = its[order]
        low, high = np.searchsorted(keys, mine), np.searchsorted(keys, mine, "right")
        places = np.flatnonzero(low < high)
        runs, i, j = [], 0, 0
        while True:
            k, best = int(np.searchsorted(places, i)), None
            while k < len(places) and best is None:
                for x in places[k : k + PLACES].tolist():
                    if best is not None and x - i >= best[0]:
                        break
                    a = int(low[x]) + int(np.searchsorted(order[low[x] : high[x]], j))
                    if a < high[x] and (best is None or x - i + int(order[a]) - j < best[0]):
                        best = x - i + int(order[a]) - j, x, int(order[a])
                k += PLACES
            if best is None:
                return runs
            _, x, y = best
            long = min(self.prefixes.extension(start + x, other.prefixes, start + y), len(mine) - x, len(its) - y)
            if not long:
                return runs
            runs.append((start + x, long))
            i, j = x + long, y + long


def points_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)


def _bounds(keys: DataFrame) -> tuple[list[tuple[int, int]], tuple[int, int] | None]:
    """Keys (id, tie) that begin a range each, from a sample of all of them; the first key."""
    rows, least = keys.agg(F.count("*"), F.min(F.struct("id", "tie"))).first()
    ranges = min(max(1, rows // ROWS_PER_RANGE), MOST_RANGES)
    if ranges < 2:
        return [], least and tuple(least)
    drawn = keys.where(unit_interval(F.lit(13), "id", "tie") < ranges * IDS_PER_RANGE / rows).distinct()
    known = sorted(tuple(r) for r in drawn.collect())
    return sorted({known[k * len(known) // ranges] for k in range(1, ranges)} - {tuple(least)}) if known else [], tuple(least)


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(target, ahead, id, text): ranges of ids, each sorted and followed by the first row of the next (ahead = 1).

    Ids ascend, null ones counting as the smallest long; rows of one id by a hash of their
    texts, so many of one id, or without one, are split too. After the last row comes the first.
    """
    text, number = F.col(text_col).cast("string"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(-1 << 63).cast("bigint"))
    bounds, least = _bounds(df.select(number.alias("id"), F.xxhash64(text_or_empty(text_col)).alias("tie")))
    rows = df.select(F.col(id_col).cast("bigint").alias("doc"), text.alias("text"), F.struct(number.alias("id"), F.xxhash64(text_or_empty(text_col)).alias("tie")).alias("key"))
    # two literals: a zipped array would be built anew at every step of every row's search
    ids, ties = (literals([b[k] for b in bounds], "bigint") for k in (0, 1))
    own_id, own_tie = F.col("key.id"), F.col("key.tie")
    upto = lambda k: (F.get(ids, k) < own_id) | ((F.get(ids, k) == own_id) & (F.get(ties, k) <= own_tie))
    target = steps_where(upto, len(bounds)) if bounds else F.lit(0)
    begins = (F.get(ids, F.col("target") - 1) == own_id) & (F.get(ties, F.col("target") - 1) == own_tie) if bounds else F.lit(False)
    first = F.lit(False) if least is None else F.col("key") == F.struct(*[F.lit(x).cast("bigint").alias(c) for x, c in zip(least, ("id", "tie"))])
    places = F.array(
        F.struct(F.col("target").alias("target"), F.lit(0).alias("ahead")),
        F.when((F.col("target") > 0) & begins, F.struct((F.col("target") - 1).alias("target"), F.lit(1).alias("ahead"))),
        F.when(first, F.struct(F.lit(len(bounds)).alias("target"), F.lit(1).alias("ahead"))),
    )
    dealt = rows.withColumn("target", target).withColumn("place", F.explode(F.filter(places, lambda p: p.isNotNull())))
    dealt = dealt.select(F.col("place.target").alias("target"), F.col("place.ahead").alias("ahead"), "key", F.col("doc").alias("id"), "text")
    return dealt.repartition(F.col("target")).sortWithinPartitions("target", "ahead", "key").drop("key")


_FOUND = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _compared(doc: int | None, points: np.ndarray, own: Fingerprint, after: np.ndarray, following: Fingerprint) -> tuple:
    half = len(points) // 2
    edited = np.concatenate([points[: len(points) - half], after[:half]])
    changed = Prefixes(edited).fingerprint()
    text = edited.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return doc, own.n, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), str(own), str(changed), own.likeness(changed), own.likeness(following)


def compare(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint beside that of its edited text, and its likeness to that and to the next row's fingerprint.

    The edited text has its last half replaced by as much of the next text's beginning. Null
    texts count as empty, null ids as the smallest long, repeated rows follow each other, a single
    row is its own next one, an empty table gives none; other columns are ignored.
    """
    bounded_batches(df.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for batch in batches:
            for target, ahead, doc, data in zip(*(batch.column(k).to_pylist() for k in range(3)), text_bytes(batch.column(3))):
                if ahead and (held is None or held[0] != target):
                    continue  # another copy of the row that followed the range before
                points = points_of(data)
                own = Prefixes(points).fingerprint()
                if held is not None and held[0] == target:
                    rows.append(_compared(*held[1:], points, own))
                held = None if ahead else (target, doc, points, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_FOUND), _FOUND)], schema=_FOUND)
            rows = []

    ddl = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(df, id_col, text_col).mapInArrow(made, ddl)
