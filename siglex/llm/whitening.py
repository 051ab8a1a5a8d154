"""Operator 11: whitening of embeddings with eigenvectors refined from float32.

Vectors become integer vectors; each distinct one is counted once (the fit list).
Spark deduplicates them as packed bytes, sums them, and sums the products of
what is left after the nearest integer of the mean is taken off, which float64
holds exactly while sums stay below 2**53; the rest of the mean, at most one
half, is taken off the covariance in long double. The driver holds one matrix of
dimension x dimension: float32 eigenvectors are its start, and iterations of Ogita
and Aishima (matrix products only, in float64, then in long double) double
their correct digits each time; eigenvectors of clustered eigenvalues are first
turned by a sub-solve of the cluster's own small matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siglex.llm.arrow_text import map_arrow
from siglex.llm.scratch import written

SCALE, SHIFT = 64, 1_000_000
WIDEST = 1 << 62  # entries beyond are held there
MAX_DIMENSION = 8192  # the driver's matrices are of this size squared at most
WIDTHS = ("<i1", "<i2", "<i4", "<i8")


def integers(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows whose vector is whole, their floor(64 * entry) as int64): no null vector, null entry or non-finite entry."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten()  # leaves out what null rows cover
    bad = ~np.isfinite(flat.to_numpy(zero_copy_only=False).astype(np.float64))
    ends = np.cumsum(np.maximum(lengths, 0))
    before = np.concatenate([[0], np.cumsum(bad)])
    starts = ends - np.maximum(lengths, 0)
    rows = np.flatnonzero((lengths >= 0) & (before[ends] == before[starts]))
    scaled = np.clip(np.floor(SCALE * np.where(bad, 0, flat.to_numpy(zero_copy_only=False).astype(np.float64))), -float(WIDEST), float(WIDEST)).astype(np.int64)
    return rows, [scaled[starts[r] : ends[r]] for r in rows]


def packed(x: np.ndarray) -> bytes:
    """Entries in as few bytes each as all of them need, after the number of that width; equal vectors give equal bytes."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    k = next(k for k, t in enumerate(WIDTHS) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return bytes([k]) + x.astype(WIDTHS[k]).tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, WIDTHS[x[0]], offset=1).astype(np.int64)


def fit_list(vectors: DataFrame) -> DataFrame:
    """(dim, x): every distinct integer vector once; copies of a task are put together before they travel."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, xs = integers(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in xs], pa.int32()), pa.array([packed(x) for x in xs], pa.binary())], ["dim", "x"])

    return map_arrow(vectors.select(F.col("embedding").cast("array<double>")), made, "dim int, x binary").where("dim > 0").distinct()


def _stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(dimension, matrix of integer vectors) for each dimension of each batch of a fit list."""
    for batch in batches:
        dims, xs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for d in np.unique(dims).tolist():
            yield d, np.stack([unpacked(xs[i]) for i in np.flatnonzero(dims == d)])


def means(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each dimension, the number of fit vectors and their exact sums."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for d, rows in _stacked(batches):
            total[d] = total.get(d, 0) + np.concatenate([[len(rows)], rows.astype(object).sum(axis=0) if np.abs(rows).max() > WIDEST // max(len(rows), 1) else rows.sum(axis=0)]).astype(object)
        cells = [(d, i, str(v)) for d, v in total.items() for i, v in enumerate(v.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True) if cells else [[]] * 3, (pa.int32(), pa.int32(), pa.string()), strict=True)], ["dim", "i", "v"])

    rows = map_arrow(fit, summed, "dim int, i int, v string").groupBy("dim", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for d in {r.dim for r in rows}:
        if d > MAX_DIMENSION:
            raise ValueError(f"vectors of {d} entries: the driver solves matrices of up to {MAX_DIMENSION} squared")
        values = [int(v) for _, v in sorted((r.i, r.v) for r in rows if r.dim == d)]
        out[d] = (values[0], values[1:])
    return out


def _added(fit: DataFrame, function) -> dict[int, np.ndarray]:
    """For each dimension, the sum of the matrices that ``function(dimension, vectors)`` gives for batches of a fit list; Spark adds row by row."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for d, rows in _stacked(batches):
            total[d] = total.get(d, 0) + function(d, rows)
        lines = [(d, i, line.astype("<f8").tobytes()) for d, m in total.items() for i, line in enumerate(m)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines, strict=True) if lines else [[]] * 3, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["dim", "i", "line"])

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(x, "<f8") for batch in batches for x in batch.column("line").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["dim", "i", "line"])

    rows = map_arrow(fit, parts, "dim int, i int, line binary").groupBy("dim", "i").applyInArrow(merged, "dim int, i int, line binary").collect()
    return {d: np.stack([np.frombuffer(x, "<f8") for _, x in sorted((r.i, bytes(r.line)) for r in rows if r.dim == d)]) for d in {r.dim for r in rows}}


def covariances(fit: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """For each dimension the covariance of the fit list (divisor n) in long double, centred before multiplying."""
    near = {d: np.array([(2 * s + n) // (2 * n) for s in total], np.int64) for d, (n, total) in sums.items()}

    def products(d: int, rows: np.ndarray) -> np.ndarray:
        y = (rows - near[d]).astype(np.float64)
        return y.T @ y

    out = {}
    for d, total in _added(fit, products).items():
        n, s = sums[d]
        rest = np.array([np.longdouble(v - n * int(m)) / np.longdouble(n) for v, m in zip(s, near[d].tolist(), strict=True)])
        v = total.astype(np.longdouble) / np.longdouble(n) - np.outer(rest, rest)
        out[d] = (v + v.T) / 2
    return out


def _clusters(values: np.ndarray, close: float) -> list[np.ndarray]:
    """Places of neighbouring sorted values no further apart than ``close``, of two or more."""
    order = np.argsort(values)
    return [c for c in np.split(order, np.flatnonzero(np.diff(values[order]) > close) + 1) if len(c) > 1]


def _measured(m: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far X is from orthogonal, and X'MX; both symmetric, as the sum of E and its transpose must be R to the last digit."""
    r, s = np.eye(len(m), dtype=m.dtype) - x.T @ x, x.T @ (m @ x)
    return (r + r.T) / 2, (s + s.T) / 2


def _unresolved(r: np.ndarray, s: np.ndarray) -> float:
    """Eigenvalues closer than this are not told apart: by the round's errors, or since rounding over their distance would undo orthogonality."""
    off = (s - np.diag(np.diag(s))).astype(np.float64)
    return max(2 * float(np.linalg.norm(off, 2) + np.linalg.norm(r.astype(np.float64), 2)), float(np.sqrt(np.finfo(s.dtype).eps)))


def refined(v: np.ndarray, rounds: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix in long double.

    Starts from float32 eigenvectors. A round measures R = 1 - X'X and S = X'VX, takes the
    eigenvalues S_ii / (1 - R_ii), and adds X E with E_ij = (S_ij + value_j R_ij) / (value_j - value_i),
    or R_ij / 2 where two values are closer than the round can tell apart. Before that, the
    columns of a cluster are turned by the eigenvectors of their own shifted matrix, whose
    entries are small, so that float64 tells them apart. Ends when nothing moves in long double.
    """
    scale = np.abs(v).max(initial=0)
    if not scale:
        return np.zeros(len(v), np.longdouble), np.eye(len(v), dtype=np.longdouble)
    a = (v / scale).astype(np.longdouble)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    kind, last, done = np.float64, np.inf, 0
    while done < rounds:
        m, x = a.astype(kind), x.astype(kind)
        r, s = _measured(m, x)
        for places in _clusters(np.diag(s), _unresolved(r, s)):
            own = np.linalg.qr(x[:, places].astype(np.float64))[0].astype(kind)
            mid = kind(np.diag(s)[places].mean())
            small = own.T @ (m @ own - mid * own)
            turn = np.linalg.eigh(((small + small.T) / 2).astype(np.float64))[1]
            x[:, places] = own @ turn.astype(kind)
        r, s = _measured(m, x)
        value = np.diag(s) / (1 - np.diag(r))
        gap = value[None, :] - value[:, None]
        close = np.abs(gap) <= _unresolved(r, s)
        e = np.where(close, r / 2, (s + value[None, :] * r) / np.where(close, 1, gap))
        x = x + x @ e
        moved = float(np.abs(e).max())
        done += 1
        stuck = moved < 1e-18 or moved >= last / 2
        if kind is np.float64 and (moved < 1e-7 or stuck or done == rounds // 2):
            kind, moved = np.longdouble, np.inf
        elif kind is np.longdouble and stuck:
            break
        last = moved
    x = x.astype(np.longdouble)
    x = x / np.sqrt((x * x).sum(axis=0))
    value = (x * (a @ x)).sum(axis=0) * scale
    order = np.argsort(-value, kind="stable")
    return value[order], x[:, order]


def whitened(vectors: DataFrame, components: int = 16) -> DataFrame:
    """For every row with a whole vector and each component: vec_id, component, n, deviation, whitened, explained, identity_error.

    A vector is whole if neither it nor an entry is null or not finite; other rows give none.
    Vectors of each length are whitened among themselves, with up to as many
    components as entries; empty vectors have none. Repeated rows and copies give rows
    each, but count once in the fit. Where an eigenvalue is not above rounding (as with one vector, or a constant
    entry), whitened is null, and explained too if nothing varies at all; identity_error is over the other components. A
    deviation beyond a long is null. vec_id may be null and of any type; other columns are not read.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    fit = written(fit_list(rows), "whitening-fit")
    sums = means(fit)
    solved = {}
    for d, v in covariances(fit, sums).items():
        value, x = refined(v)
        trace = np.trace(v)
        k = min(components, d)
        good = value[:k] > trace * np.longdouble(d) * np.longdouble(1e-17)
        project = np.where(good, x[:, :k] / np.sqrt(np.where(good, value[:k], 1)), np.nan).astype(np.float64)
        solved[d] = (sums[d][0], sums[d][1], project, (value[:k] / trace).astype(np.float64) if trace > 0 else np.full(k, np.nan), good)

    def centred(d: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - sums, exact, as int64 where it fits, and x less the mean."""
        n, total = solved[d][:2]
        fits = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, total))) < WIDEST // 2
        exact = x.astype(np.int64 if fits else object) * n - np.array(total, np.int64 if fits else object)
        return exact, exact.astype(np.float64) / n

    def spread(d: int, x: np.ndarray) -> np.ndarray:
        w = centred(d, x)[1] @ solved[d][2][:, solved[d][4]]
        return np.vstack([w.T @ w, w.sum(axis=0)])

    error = {}
    for d, total in _added(fit, spread).items():
        n, size = solved[d][0], total.shape[1]
        mean = total[-1] / n
        error[d] = float(np.abs(total[:-1] / n - np.outer(mean, mean) - np.eye(size)).max(initial=0)) if size else 0.0

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, xs = integers(batch.column(1))
            dims = np.array([len(x) for x in xs])
            for d in np.unique(dims[dims > 0]).tolist():
                own = np.flatnonzero(dims == d)
                n, _, project, explained, good = solved[d]
                exact, y = centred(d, np.stack([xs[i] for i in own]))
                wide = exact.dtype == object or int(np.abs(exact).max()) >= 1 << 28
                squares = (exact.astype(object) ** 2 if wide else exact**2).sum(axis=1).tolist()
                k, m = project.shape[1], len(own)
                ids = batch.column(0).take(pa.array(np.repeat(at[own], k)))
                scores = (y @ np.where(good, project, 0)).ravel()
                columns = [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array([q if q < 1 << 63 else None for q in squares], pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(scores, mask=np.tile(~good, m)), pa.array(np.tile(explained, m), from_pandas=True), pa.array(np.full(m * k, error[d])),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    schema = StructType([vectors.schema["vec_id"], *StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")])
    return map_arrow(rows, made, schema)
