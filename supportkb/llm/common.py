"""What the operators of this package share: folds, steps written to the shared folder, byte-level tokens.

Texts are handled as the bytes Arrow delivers, so hashing words and windows is a handful of numpy passes over
a whole batch and no Python string is made."""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportkb.sizing import scratch_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# The seed of the byte table and the (odd) base of the polynomial hash.
_TABLE = np.random.default_rng(20240611).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def let(value, body):
    """Evaluate ``value`` once per row and use it in ``body``, however often and however deep in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(column, parts: int):
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % parts


def as_text(column):
    """The column as a string, null as empty."""
    return F.coalesce(column.cast("string"), F.lit(""))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read back.

    The lineage ends there: later steps survive lost executors without redoing this one, scans keep their
    statistics and column pruning, and the shuffle files of the step may go as soon as it is written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _cleanup(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def forget(df: DataFrame) -> None:
    """Remove the files behind a step of ``written`` that nothing will read again."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def _cleanup(spark: SparkSession):
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary Arrow column as (bytes, offsets of each value); null is an empty value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    data = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return data, (offsets.astype(np.int64) - first if len(offsets) else np.zeros(1, np.int64))


def pieces(data: np.ndarray, offsets: np.ndarray, most: int):
    """(first row, last row) ranges of at most ``most`` bytes each, one row at least."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def _power(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[:1] = 1
        np.cumprod(have, out=have)
        _POWERS[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; ``span_hash`` gives the hash of any span of the bytes from it."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.multiply(_TABLE[data], _power(_BASE, len(data)), out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes start..end, equal for equal bytes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * _power(_INVERSE, len(prefix))[start])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray):
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: (start, end, number of words before each text)."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True                       # a text ends a word
    before = np.ones(len(data), bool)          # is the byte before a blank or another text
    before[1:] = blank[:-1]
    before |= edge[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = blank[1:]
    after |= edge[1:]
    start = np.flatnonzero(~blank & before)
    end = np.flatnonzero(~blank & after) + 1
    return start, end, np.searchsorted(start, offsets)


def sequences(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after the other."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first, counts)
