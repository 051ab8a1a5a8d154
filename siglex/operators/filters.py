"""Zero-phase filters and polyphase resampling of long rows, by blocks with halos.

A row (its key, t, x) of any length is cut to blocks; the samples that a block's outputs
reach beyond its ends are copied to it. Nothing stands beyond a row's ends or in its
gaps. Columns other than t and x must be constant in a row and are carried.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK = 8192  # samples by which blocks advance, or the reach of a filter if that is longer
CELLS = 1 << 21  # numbers that a task holds as one matrix


def _kaiser_sinc(cut: float, half: int, beta: float) -> np.ndarray:
    """Low-pass of 2 half + 1 taps with a Kaiser window, sum one; ``cut`` in cycles a sample."""
    k = np.arange(-half, half + 1)
    h = 2 * cut * np.sinc(2 * cut * k) * np.i0(beta * np.sqrt(1 - (k / half) ** 2)) / np.i0(beta)
    return h / h.sum()


def taps_for(rate: float, width: float) -> int:
    """Odd length at which a Hamming-windowed sinc falls off within ``width`` Hz."""
    return 2 * math.ceil(3.3 * rate / width / 2) + 1


def _by_block(samples: DataFrame, step: int, reach: int, out: Callable[[np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """Rows of ``out(matrix, own samples, last own place + 1, block)``: (row of the matrix, t, x); a matrix row is a block with ``reach`` places on both sides."""
    key = [c for c in samples.columns if c not in ("t", "x")]
    t = F.col("t").cast("long")
    own, inside = F.floor(t / step), t % step
    blocks = F.array_compact(F.array(own, F.when((inside < reach) & (own > 0), own - 1), F.when(inside >= step - reach, own + 1)))
    held = samples.select(*key, t.alias("t"), F.col("x").cast("double").alias("x"), F.explode(blocks).alias("block"))
    rows = held.groupBy(*key, "block").agg(F.collect_list(F.struct("t", "x")).alias("s"))
    n = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = step + 2 * reach
        for batch in batches:
            column, block = batch.column(n + 1), batch.column(n).to_numpy()
            offsets = np.asarray(column.offsets).astype(np.int64)
            inner = column.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
            offsets = offsets - offsets[0]
            ts = inner.field("t").to_numpy(zero_copy_only=False)
            xs = np.nan_to_num(inner.field("x").to_numpy(zero_copy_only=False).astype(np.float64))
            count = max(1, CELLS // wide)
            for row in range(0, batch.num_rows, count):
                end = min(row + count, batch.num_rows)
                place = np.repeat(np.arange(end - row), np.diff(offsets[row : end + 1]))
                at = ts[offsets[row] : offsets[end]] - block[row:end][place] * step + reach
                dense, there = np.zeros((end - row, wide)), np.zeros((end - row, step), bool)
                dense[place, at] = xs[offsets[row] : offsets[end]]
                mine = (at >= reach) & (at < reach + step)
                there[place[mine], at[mine] - reach] = True
                last = np.where(there.any(axis=1), step - there[:, ::-1].argmax(axis=1), 0)
                which, when, value = out(dense, there, last, step)
                if len(which):
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(which + row)) for i in range(n)), pa.array(when(block[row:end][which]).astype(np.int32)), pa.array(value)], schema.names)

    schema = StructType([*(samples.schema[c] for c in key), *StructType.fromDDL("t int, x double")])
    return rows.mapInArrow(run, schema).select(*samples.columns)


def convolved(samples: DataFrame, kernel: list[float] | np.ndarray) -> DataFrame:
    """``x`` under an odd, centred kernel: overlapping blocks, one FFT a block."""
    h = np.asarray(kernel, float)
    half = len(h) // 2
    step = max(BLOCK, half)
    size = 1 << (step + 4 * half).bit_length()
    spectrum = np.fft.rfft(h, size)

    def out(dense: np.ndarray, there: np.ndarray, _: np.ndarray, step: int):
        used = int(there.any(axis=0).nonzero()[0].max(initial=-1)) + 1  # short rows need no long transform
        short = 1 << max(1, (used + 4 * half).bit_length())
        turn = spectrum if short >= size else np.fft.rfft(h, short)
        n = min(short, size)
        y = np.fft.irfft(np.fft.rfft(dense[:, : used + 2 * half], n, axis=1) * turn, n, axis=1)[:, 2 * half : 2 * half + used]
        which, t = np.nonzero(there[:, :used])
        return which, lambda block: block * step + t, y[which, t]

    return _by_block(samples, step, half, out)


def rational(samples: DataFrame, up: int, down: int) -> DataFrame:
    """Resampling by up / down: a Kaiser-windowed low-pass of ten samples of the slower rate on each side, at the samples that stay only.

    A row of n samples gives ceil(n up / down). Output m stands at input place m down / up; its phase
    picks every ``up``-th tap, so neither inserted zeros nor dropped outputs are computed.
    """
    g = math.gcd(up, down)
    up, down = up // g, down // g
    if up == down:
        return samples
    most = max(up, down)
    half = 10 * most
    h = up * _kaiser_sinc(0.5 / most, half, 5.0)
    reach = half // up + 1
    step = down * math.ceil(max(BLOCK, reach) / down)

    def out(dense: np.ndarray, _: np.ndarray, last: np.ndarray, step: int):
        which, place, value = [], [], []
        for s in range(up):  # outputs up * i + s
            first, phase = divmod(down * s, up)
            around = np.arange(-reach, reach + 1)
            tap = half + phase - up * around
            g = np.where((tap >= 0) & (tap < len(h)), h[np.clip(tap, 0, len(h) - 1)], 0.0)
            padded = np.pad(dense, ((0, 0), (0, first + 1)))
            windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1, axis=1)[:, first : first + step : down]
            y = windows @ g
            m = up * np.arange(y.shape[1]) + s
            r, i = np.nonzero(m[None, :] * down < last[:, None] * up)
            which.append(r)
            place.append(m[i])
            value.append(y[r, i])
        which, place = np.concatenate(which), np.concatenate(place)
        return which, lambda block: block * (step // down * up) + place, np.concatenate(value)

    return _by_block(samples, step, reach, out)


def fourier_resampled(rows: DataFrame, n: int, m: int) -> DataFrame:
    """Arrays ``x`` of ``n`` samples as arrays of ``m``: a cut or zero-filled spectrum, turned back; a batch is one matrix. Other lengths go."""
    at, schema = rows.columns.index("x"), rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = min(n, m)
        for batch in batches:
            x = np.asarray(batch.column(at).flatten(), float).reshape(-1, n)
            spectrum = np.fft.rfft(x, axis=1)
            y = np.zeros((len(x), m // 2 + 1), complex)
            y[:, : k // 2 + 1] = spectrum[:, : k // 2 + 1]
            if k % 2 == 0 and n != m:
                y[:, k // 2] *= 2.0 if m < n else 0.5
            z = np.fft.irfft(y, m, axis=1) * (m / n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * m), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([lists if i == at else batch.column(i) for i in range(batch.num_columns)], schema.names)

    return rows.where(F.size("x") == n).withColumn("x", F.col("x").cast("array<double>")).mapInArrow(run, schema)
