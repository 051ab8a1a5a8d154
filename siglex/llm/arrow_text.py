"""Whole texts of an Arrow column as byte arrays, in runs of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20  # of an Arrow batch, whose copies lie on both sides of the socket
RUN_BYTES = 1 << 18  # the arrays of a run then fit a core's cache

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, starts, bytes) of consecutive rows; ``starts`` has one place more than rows.

    Nulls are empty texts. A run holds at most ``limit`` bytes, or one row.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


def owner(starts: np.ndarray) -> np.ndarray:
    """For every byte of a run, the index of its row."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def packed(data: np.ndarray, n: int) -> np.ndarray:
    """At every place, the next ``n`` <= 8 bytes as one little-endian uint64 (short at the end)."""
    if n > 1 and n & (n - 1) == 0:
        half = packed(data, n // 2)
        out = half.copy()
        out[: -n // 2 or None] |= half[n // 2 :] << np.uint64(4 * n) if len(half) > n // 2 else np.uint64(0)
        return out
    out = data.astype(np.uint64)
    for k in range(1, n):
        if len(data) > k:
            out[:-k] |= data[k:].astype(np.uint64) << np.uint64(8 * k)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, wrapping."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def has_bits(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Membership of uint64 values in a table of scratch.bit_table."""
    place = values & np.uint64(len(table) * 8 - 1)
    return (table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which is faster here than the hashing of np.unique."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """``mapInArrow`` in batches of bounded size, so that long texts do not fill a task's memory.

    The bounds are settings of the session and stay set; lower ones that are there already are kept.
    """
    conf = df.sparkSession.conf
    for name, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= bound:
            conf.set(name, str(bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        given_back()

    return df.mapInArrow(run, schema)


def given_back() -> None:
    """Memory that a finished task no longer needs goes back to the system, as Spark keeps its Python workers."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
