"""Operator 2, native: shards by a Feistel permutation of global row numbers.

Rows are numbered by a total order, the number is permuted by a keyed Feistel
network over a rectangle ``a x b`` (``a*b - n < a``) with cycle walking back
into ``[0, n)``, and the permuted place gives ``shard = place % shards`` and
``slot = place // shards``. So shard sizes differ by one row at most, slots
have no gaps, and the place of any row number can be computed alone.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglex.llm.scratch import long_array, partitions, written

ROUNDS = 4


def domain(n: int) -> tuple[int, int]:
    """Sides of a near-square rectangle with at least ``n`` places."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _pass(x: Column, a: int, b: int, seed: int) -> Column:
    """One run of the network over ``[0, a*b)``: additive rounds, left half modulo a, right modulo b."""
    left = x % F.lit(a)
    halves = F.struct(left.cast("long").alias("l"), ((x - left) / F.lit(a)).cast("long").alias("r"))
    rounds = F.array(*(F.struct(F.lit(k % 2 == 0).alias("even"), F.lit(seed * 1000 + k).alias("key")) for k in range(ROUNDS)))

    def step(s: Column, k: Column) -> Column:
        return F.struct(
            F.when(k["even"], F.pmod(s["l"] + F.xxhash64(k["key"], s["r"]) % F.lit(a), F.lit(a))).otherwise(s["l"]).cast("long").alias("l"),
            F.when(k["even"], s["r"]).otherwise(F.pmod(s["r"] + F.xxhash64(k["key"], s["l"]) % F.lit(b), F.lit(b))).cast("long").alias("r"),
        )

    return F.aggregate(rounds, halves, step, lambda s: s["l"] + s["r"] * F.lit(a))


def feistel(x: Column, n: int, seed: int) -> Column:
    """``x`` in ``[0, n)`` to its place in ``[0, n)``; a permutation for every ``n`` and ``seed``.

    Only ``a*b - n < sqrt(n) + 1`` places lie beyond ``n``, so a walk ends after
    that many further passes at the latest, and only rows that fall there walk.
    """
    a, b = domain(n)
    first, beyond = _pass(x, a, b, seed), a * b - n
    if not beyond:
        return first
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(beyond)),
        first,
        lambda place, _: F.when(place < n, place).otherwise(_pass(place, a, b, seed)),
    )
    return F.when(first < n, first).otherwise(walk)


def numbered(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with gapless global row numbers from 0 by ``order``, and the number of rows.

    One range partitioning of the given (narrow) columns, written to the shared
    folder; then only one count for each partition reaches the driver. Rows
    equal in ``order`` are dealt on by where they were read, so a run of equal
    keys is split between tasks.
    """
    at, tie = f"{name}__at", f"{name}__tie"
    keys = [*order, tie]
    placed = written(
        df.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(partitions(df.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .withColumn(at, F.monotonically_increasing_id())
        .drop(tie),
        "numbered",
    )
    counts = dict(placed.groupBy(F.shiftright(at, 33).alias("p")).count().collect())
    starts = [0, *accumulate(counts.get(p, 0) for p in range(max(counts, default=-1) + 1))]
    before = F.element_at(long_array(starts), F.shiftright(at, 33).cast("int") + 1)
    number = before + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, number.cast("long")).drop(at), starts[-1]


def feistel_shards(docs: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot of every row of ``docs``.

    Order of the numbers: doc_id (nulls first), then a hash of the text. Null
    texts count no bytes and have the checksum of the empty text. Repeated rows
    are rows like others; which of two equal rows gets which place is open. An
    empty table gives an empty result. Columns other than doc_id and text are
    not read, so they cannot clash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows, n = numbered(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("digest"),
        ),
        ["doc_id", "digest"],
    )
    place = F.col("place")
    return rows.withColumn("place", feistel(F.col("row_number"), max(n, 1), seed)).select(
        "doc_id",
        "size",
        "text_crc32",
        "row_number",
        (place % shards).cast("int").alias("shard"),
        ((place - place % shards) / shards).cast("long").alias("slot"),
    )
