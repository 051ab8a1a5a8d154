"""Short-time spectra by batch: frames are rows of a matrix and meet one FFT.

Samples (row key, t, x) go to blocks of whole frames, so that a row of any length is
worked on in pieces; a block's last frames reach into the next, whose first samples
are copied to it. A frame needs all its samples: one with a gap or a null is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROW = ["subject", "trial", "channel"]
BLOCK = 8192  # samples by which blocks advance, at least one frame
CELLS = 1 << 22  # numbers that a task holds as one matrix
Finish = Callable[[np.ndarray], np.ndarray]


def _blocks(samples: DataFrame, size: int, hop: int) -> tuple[DataFrame, int]:
    """(row key, block, s: structs t, x) and the number of frames that start in a block."""
    frames = max(BLOCK // hop, -(-size // hop))
    step = frames * hop
    own = F.floor(F.col("t") / step).cast("long")
    both = F.when((F.col("t") % step < size - hop) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    held = samples.select(*ROW, F.col("t").cast("long").alias("t"), F.col("x").cast("double").alias("x"), F.explode(both).alias("block"))
    return held.groupBy(*ROW, "block").agg(F.collect_list(F.struct("t", "x")).alias("s")), frames


def _matrices(batch: pa.RecordBatch, size: int, hop: int, frames: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the row in the batch, number of the frame, frames as a matrix), whole frames only, in pieces of bounded size."""
    column = batch.column(len(ROW) + 1)
    offsets = np.asarray(column.offsets).astype(np.int64)
    inner = column.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    offsets = offsets - offsets[0]
    t, x = inner.field("t").to_numpy(zero_copy_only=False), inner.field("x").to_numpy(zero_copy_only=False).astype(np.float64)
    first = batch.column(len(ROW)).to_numpy() * frames
    place = np.repeat(np.arange(len(first)), np.diff(offsets))
    at = t - first[place] * hop
    extent = np.maximum.reduceat(at, offsets[:-1]) + 1 if len(at) else np.zeros(0, np.int64)
    row = 0
    while row < len(first):
        end, widest = row, 0
        while end < len(first) and (end == row or max(widest, extent[end]) * (end + 1 - row) * size // hop <= CELLS):
            widest = max(widest, int(extent[end]))
            end += 1
        if widest >= size:
            dense = np.full((end - row, widest), np.nan)
            own = slice(int(offsets[row]), int(offsets[end]))
            dense[place[own] - row, at[own]] = x[own]
            windows = np.lib.stride_tricks.sliding_window_view(dense, size, axis=1)[:, ::hop][:, :frames]
            whole = np.isfinite(windows).all(axis=2)
            which, frame = np.nonzero(whole)
            yield which + row, first[which + row] + frame, windows[whole]
        row = end


def _power(windows: np.ndarray, detrend: bool) -> np.ndarray:
    """Hann-windowed |X|^2 / size of every row."""
    size = windows.shape[1]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    y = (windows - windows.mean(axis=1, keepdims=True) if detrend else windows) * hann
    return np.abs(np.fft.rfft(y, axis=1)) ** 2 / size


def _key(samples: DataFrame) -> list:
    return [samples.schema[c] for c in ROW]


def spectra(samples: DataFrame, size: int, hop: int, detrend: bool = False, finish: Finish | None = None) -> DataFrame:
    """(row key, frame, power): one array of ``size // 2 + 1`` powers a frame, after ``finish`` on the matrix of frames if given."""
    blocks, frames = _blocks(samples, size, hop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, frame, windows in _matrices(batch, size, hop, frames):
                power = _power(windows, detrend)
                power = finish(power) if finish else power
                offsets = pa.array(np.arange(len(power) + 1, dtype=np.int32) * power.shape[1])
                key = [batch.column(i).take(pa.array(place)) for i in range(len(ROW))]
                yield pa.RecordBatch.from_arrays([*key, pa.array(frame), pa.ListArray.from_arrays(offsets, pa.array(power.ravel()))], schema.names)

    schema = StructType([*_key(samples), *StructType.fromDDL("frame long, power array<double>")])
    return blocks.mapInArrow(run, schema)


def binned(samples: DataFrame, size: int, hop: int, detrend: bool = False, finish: Finish | None = None, bins: list[int] | None = None) -> DataFrame:
    """(row key, frame, bin, power) of ``bins``, all by default: ``spectra`` in long rows."""
    chosen = np.arange(size // 2 + 1) if bins is None else np.array(bins, np.int64)
    blocks, frames = _blocks(samples, size, hop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, frame, windows in _matrices(batch, size, hop, frames):
                power = _power(windows, detrend)
                power = (finish(power) if finish else power)[:, chosen]
                times = lambda v: np.repeat(v, len(chosen))
                key = [batch.column(i).take(pa.array(times(place))) for i in range(len(ROW))]
                yield pa.RecordBatch.from_arrays([*key, pa.array(times(frame)), pa.array(np.tile(chosen, len(place)).astype(np.int32)), pa.array(power.ravel())], schema.names)

    schema = StructType([*_key(samples), *StructType.fromDDL("frame long, bin int, power double")])
    return blocks.mapInArrow(run, schema)


def mean_power(samples: DataFrame, size: int, hop: int, detrend: bool = True) -> DataFrame:
    """(row key, bin, power): the mean over a row's frames; a block sends the sums of its bins, which Spark adds."""
    blocks, frames = _blocks(samples, size, hop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, _, windows in _matrices(batch, size, hop, frames):
                if not len(place):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                sums, n = np.add.reduceat(_power(windows, detrend), starts, axis=0), np.diff(np.append(starts, len(place)))
                bins = sums.shape[1]
                key = [batch.column(i).take(pa.array(np.repeat(place[starts], bins))) for i in range(len(ROW))]
                yield pa.RecordBatch.from_arrays([*key, pa.array(np.tile(np.arange(bins, dtype=np.int32), len(n))), pa.array(sums.ravel()), pa.array(np.repeat(n, bins))], schema.names)

    schema = StructType([*_key(samples), *StructType.fromDDL("bin int, total double, n long")])
    return blocks.mapInArrow(run, schema).groupBy(*ROW, "bin").agg((F.sum("total") / F.sum("n")).alias("power"))


def log_scaled(power: np.ndarray) -> np.ndarray:
    """Log powers, z-scored over the bins of each frame."""
    v = np.log1p(power)
    return (v - v.mean(axis=1, keepdims=True)) / np.maximum(v.std(axis=1, keepdims=True), 1e-8)
