"""What the operators share: scratch tables, bounded Arrow batches, word spans, salts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows in one Arrow batch; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20

#: Words are runs of anything but these bytes, which is also what bytes.split() cuts at.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\r\x0b\x0c"


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        found = tempfile.mkdtemp(prefix="shoebox-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """df written as Parquet into the shared folder and read back, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/shoebox-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that durable() wrote, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES, which suits slim rows as well as whole texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def unit_interval(*cols) -> Column:
    """A number in [0, 1) that depends on the columns alone, so reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each value of a string column; null counts as empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = memoryview(data) if data is not None else memoryview(b"")
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for k in range(len(column)):
        yield bytes(data[offsets[k] : offsets[k + 1]]) if valid[k] else b""


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
#: A random odd-multiplier polynomial modulo 2^64 over a random value for each byte.
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RNG.integers(1 << 40, 1 << 62)) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def _powers(n: int, up: bool) -> np.ndarray:
    have = _POWERS[up]
    base = _BASE if up else _INVERSE
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _POWERS[up] = have
    return have


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words in an array of bytes."""
    edge = np.diff(np.concatenate([[True], _IS_SPACE[data], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


#: Bytes that are hashed at a time, so long texts need no arrays many times their size.
PIECE = 1 << 20


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, which are in order and don't overlap; equal bytes hash alike."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        first = int(starts[k])
        stop = max(k + 1, int(np.searchsorted(ends, first + PIECE, "right")))
        lo, hi = starts[k:stop] - first, ends[k:stop] - first
        n = int(hi[-1])
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data[first : first + n]] * _powers(n, True)[:n], out=sums[1:])
        h = (sums[hi] - sums[lo]) * _powers(n, False)[lo]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out[k:stop] = h ^ (h >> np.uint64(32))
        k = stop
    return out


def empty_like(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)
