"""Shared helpers of the text operators: scratch tables, word offsets and window hashes.

The numpy helpers work on the raw UTF-8 bytes of one Arrow batch.  A batch is cut into blocks of
``BLOCK_BYTES`` so that the temporaries of a task stay bounded whatever the batch holds; one document is
never cut.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step looks at.
BLOCK_BYTES = 2_000_000

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))

#: Byte classes of words: anything but ASCII white space, and ASCII letters, digits and non-ASCII bytes.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    ALPHANUMERIC[_low : _high + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the one in ``spark.checkpoint.dir``; a new temporary one where all is one machine (tests)."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def renamed(rows: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """``rows`` with plain names for all columns but the ``needed`` ones, by place, and the names they had.

    So no column of the caller's meets one of the operator's, whatever it is called (dots too); ``toDF`` with the names gives them back.
    """
    return rows.toDF(*[c if c in needed else f"extra_{i}" for i, c in enumerate(rows.columns)]), rows.columns


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def by_bytes(batch: pa.RecordBatch, column: str, most_rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of at most ``BLOCK_BYTES`` of ``column`` (or one row) and ``most_rows``."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto = np.r_[0, np.cumsum(lengths, dtype=np.int64)]
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(upto, upto[row] + BLOCK_BYTES, "right")) - 1
        end = min(max(end, row + 1), row + most_rows, batch.num_rows)
        yield batch.slice(row, end - row)
        row = end


def utf8_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, row offsets into bytes) for blocks of whole rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words_of(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the word offsets of the rows; words don't cross rows."""
    inside = kind[data]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for the usual block size only."""
    size = max(BLOCK_BYTES + 4096, n + 1)
    if size not in _powers:
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, U64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if n + 1 > BLOCK_BYTES + 4096:
            return both[0], both[1]
        _powers[size] = (both[0], both[1])
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word's bytes; equal in all processes."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _power(len(data))
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words, by the place of its first word; rows are not looked at."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = _power(len(words))
    sums = np.empty(len(words) + 1, U64)
    sums[0] = 0
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[length:] - sums[:n]) * down[:n] + U64(length))


def within_rows(word_offsets: np.ndarray, length: int, n_words: int) -> np.ndarray:
    """For each place of ``window_hashes``, whether that window lies within one row."""
    n = n_words - length + 1
    if n <= 0:
        return np.zeros(0, bool)
    row_end = np.repeat(word_offsets[1:], np.diff(word_offsets))
    return np.arange(n) + length <= row_end[:n]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the number of values in each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
