"""Permutation tests by keyed permutations of row numbers: nothing is sorted a shuffle, and no value passes the driver."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglex.functions import scalar as S
from siglex.operators import stats
from siglex.sources.shared import written

ROUNDS = 6
PRIME = 2_147_483_647  # squares of smaller numbers fit a signed long
BLOCK = 1 << 14  # places whose values travel as one array
TOGETHER = 64  # shuffles that one batch of rows is placed by at a time


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``i``, gapless from 0 by ``order`` (ties in any order): range parts with carried counts."""
    return stats.running(rows.withColumn("_one", F.lit(1).cast("long")), [], order, ["_one"]).drop("_one").withColumnRenamed("_one_before", "i")


def round_keys(seed: int, shuffle: int) -> list[int]:
    """The keys of a shuffle's rounds: the first 28 bits of the md5 of ``seed:shuffle:round``."""
    return [int(hashlib.md5(f"{seed}:{shuffle}:{k}".encode()).hexdigest()[:7], 16) for k in range(ROUNDS)]


def places(i: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    """Where the numbers ``i`` of ``[0, n)`` go: a Feistel network over a square of at least ``n`` cells.

    A round adds a keyed cube of one coordinate to the other, modulo the side. Cells
    beyond ``n`` walk on until they fall inside, which keeps it a permutation.
    """
    side = math.isqrt(n - 1) + 1
    if side >= 1 << 30:
        raise ValueError(f"{n} rows: numbers up to 2^60 are placed")

    def added(of: np.ndarray, key: int) -> np.ndarray:
        t = of + key  # below PRIME, as sides are below 2^30
        return t * t % PRIME * t % PRIME % side

    out, walking = i.astype(np.int64), np.arange(len(i))
    while len(walking):
        left, right = np.divmod(out[walking], side)
        for k, key in enumerate(keys):
            if k % 2:
                right = (right + added(left, key)) % side
            else:
                left = (left + added(right, key)) % side
        out[walking] = left * side + right
        walking = walking[out[walking] >= n]
    return out


PACK = "part int, block long, shuffle binary, at binary, v binary"


def _packed(part: int, place: np.ndarray, values: np.ndarray, shuffle: np.ndarray | None) -> pa.RecordBatch:
    """One row a block of places: where in the block each value goes, and under which shuffle (null for the values that stay)."""
    block, at = np.divmod(place, BLOCK)
    order = np.argsort(block.astype(np.uint16) if block.max() < 1 << 16 else block, kind="stable")  # short keys are sorted by digits
    block = block[order]
    starts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1])
    blocks, ends = block[starts], [*starts[1:], len(place)]
    cut = lambda v: pa.array([v[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary())
    columns = [pa.array([part] * len(blocks), pa.int32()), pa.array(blocks, pa.int64()), pa.nulls(len(blocks), pa.binary()) if shuffle is None else cut(shuffle[order]), cut(at[order].astype(np.int32)), cut(values[order])]
    return pa.RecordBatch.from_arrays(columns, names=["part", "block", "shuffle", "at", "v"])


def _dealt(n: int, permutations: int, seed: int):
    """Batches of (i, x, y) to packs: ``y`` where it is, once a part, and ``x`` where each shuffle of the part puts it."""
    keys = [round_keys(seed, k) for k in range(permutations)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "x", "y"))
            for first in range(0, permutations if len(i) else 0, TOGETHER):
                some = range(first, min(first + TOGETHER, permutations))
                yield _packed(first // TOGETHER, i, y, None)
                to = np.concatenate([places(i, n, keys[k]) for k in some])
                yield _packed(first // TOGETHER, to, np.tile(x, len(some)), np.repeat(np.arange(some.start, some.stop, dtype=np.int32), len(i)))

    return run


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs in order of (part, block), those of ``y`` first, to (shuffle, s): sums of products, one row a shuffle and batch."""
    y, now = np.zeros(BLOCK), None
    for batch in batches:
        sums: dict[int, float] = {}
        for part, block, shuffle, at, v in zip(*(batch.column(c) for c in ("part", "block", "shuffle", "at", "v")), strict=True):
            at, v = np.frombuffer(at.as_buffer(), np.int32), np.frombuffer(v.as_buffer(), np.float64)
            if not shuffle.is_valid:
                if now != (now := (part.as_py(), block.as_py())):
                    y[:] = 0.0
                y[at] = v
                continue
            shuffle = np.frombuffer(shuffle.as_buffer(), np.int32)
            low = int(shuffle.min())
            for k, s in enumerate(np.bincount(shuffle - low, v * y[at])):
                sums[low + k] = sums.get(low + k, 0.0) + s
        yield pa.RecordBatch.from_pydict({"shuffle": pa.array(sums.keys(), pa.int32()), "s": pa.array(sums.values(), pa.float64())})


def shuffled_products(rows: DataFrame, n: int, permutations: int, seed: int = 42) -> DataFrame:
    """(shuffle, s): sums of ``x`` times the ``y`` of the place its row goes to, of rows (i, x, y) numbered from 0 to n - 1.

    Rows are placed batch by batch and leave as one pack a block of places. A task walks its
    blocks in order, holds the ``y`` of one block and multiplies what comes to it: 16 bytes
    are shuffled for a row and shuffle, and 12 for a row and part of ``TOGETHER`` shuffles.
    """
    packs = rows.select("i", "x", "y").mapInArrow(_dealt(n, permutations, seed), PACK)
    walked = packs.repartition("part", "block").sortWithinPartitions("part", "block", F.col("shuffle").isNotNull())
    return walked.mapInArrow(_multiplied, "shuffle int, s double").groupBy("shuffle").agg(F.sum("s").alias("s"))


def permutation_test(rows: DataFrame, x: str, y: str, id_column: str, permutations: int = 1000, seed: int = 42) -> DataFrame:
    """(observed, p) of the correlation of two columns against ``permutations`` shuffles of ``y``, two-sided, the data counted as one shuffle.

    Rows with a null in either column are left out. Without rows, or where a column does
    not vary, ``observed`` is null and ``p`` 1. Rows are numbered by ``id_column``.
    """
    if permutations < 1:
        raise ValueError("at least one shuffle")
    own = rows.select(F.col(id_column).alias("_id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    placed = written(numbered(own, ["_id"]), "numbered")
    of = placed.agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.stddev_pop("x") * F.stddev_pop("y")).alias("sd"), S.correlation("x", "y").alias("observed")).first()
    if of.observed is None:
        return rows.sparkSession.createDataFrame([(None, 1.0)], "observed double, p double")
    centred = placed.select("i", (F.col("x") - of.mx).alias("x"), (F.col("y") - of.my).alias("y"))
    rho = shuffled_products(centred, of.n, permutations, seed).select((F.col("s") / (of.n * of.sd)).alias("rho"))
    reached = F.count_if(F.abs("rho") >= abs(of.observed) - 1e-12)
    return rho.agg(F.lit(of.observed).alias("observed"), ((reached + 1) / (F.count("*") + 1)).alias("p"))


def rank_permutation_test(rows: DataFrame, x: str, y: str, id_column: str, permutations: int = 1000, seed: int = 42) -> DataFrame:
    """``permutation_test`` of Spearman's correlation: both columns by their average ranks, found by running counts of equal values."""
    ranked = rows.dropna(subset=[x, y])
    for name, c in (("_x", x), ("_y", y)):
        ranked = stats.ranked(ranked, c, name)
    return permutation_test(ranked, "_x", "_y", id_column, permutations, seed)
