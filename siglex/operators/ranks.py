"""Exact order statistics without sorting: histograms over value ranges, refined where a wanted rank lies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siglex.sources import shared

PARTS = 4096  # of a range, in all wanted ranges together at least four each
LEAST = 1 << 18  # values of a range that are counted one by one


def _part(v: Column, low: Column, high: Column, parts: int) -> Column:
    """Which part of [low, high] holds ``v``; never falls as ``v`` grows."""
    return F.when(high > low, F.least(F.floor((v - low) / (high - low) * parts), F.lit(parts - 1))).otherwise(0).cast("int")


def ranked(rows: DataFrame, value: str, ranks: list[int] | Callable[[int], list[int]], least: int = LEAST) -> dict[int, float]:
    """The values of ranks (0 is the least) among all ``value`` of a table that are neither null nor NaN; a rank beyond the last gives the last.

    Each round cuts every range that holds a wanted rank into equal parts and counts them,
    map-side, with their least and greatest values; parts with few values or a single
    one are counted by value in the end. No task sees more than what is in one
    part, and the driver one row for each wanted rank and round. The values are written
    once, so that what makes them is not done again each round. ``ranks`` may be
    made from the number of values.
    """
    spark = rows.sparkSession
    place = shared.path(spark, "values")
    rows.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)").write.parquet(place)
    try:
        return _selected(spark.read.schema("v double").parquet(place), ranks, least)
    finally:
        shared.removed(spark, place)


def _selected(v: DataFrame, ranks: list[int] | Callable[[int], list[int]], least: int) -> dict[int, float]:
    whole = v.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if not whole.n:
        return {}
    wanted = {k: min(max(k, 0), whole.n - 1) for k in (ranks(whole.n) if callable(ranks) else ranks)}
    open_ = [(0, whole.low, whole.high, 0, whole.n)]  # id, least, greatest, values before, values
    out: dict[int, float] = {}
    table, spark = v.withColumn("id", F.lit(0)), v.sparkSession
    while open_:
        for _, low, high, before, n in open_:
            if low == high:
                out |= {k: low for k, at in wanted.items() if before <= at < before + n}
        open_ = [r for r in open_ if r[1] < r[2]]
        if not open_:
            break
        if len(open_) == 1:  # as in the first round
            held = table.where(F.col("id") == open_[0][0]).withColumns(dict(zip(("low", "high", "before"), map(F.lit, open_[0][1:4]), strict=True)))
        else:
            ranges = spark.createDataFrame(open_, "id int, low double, high double, before long, n long")
            held = table.join(F.broadcast(ranges), "id")  # one row a wanted rank at most
        fine = max(r[4] for r in open_) <= least
        if fine:
            cut = held.groupBy("id", "before", "v").agg(F.count("*").alias("c"))
            w = Window.partitionBy("id").orderBy("v")
            each = cut.select("v", "v", (F.col("before") + F.sum("c").over(w) - F.col("c")).alias("b"), "c").toDF("low", "high", "b", "c")
        else:
            parts = max(4, PARTS // len(open_))
            cut = held.withColumn("part", _part(F.col("v"), F.col("low"), F.col("high"), parts))
            counts = cut.groupBy("id", "before", "part").agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("greatest"))
            w = Window.partitionBy("id").orderBy("part")
            each = counts.select("id", "part", F.col("least").alias("low"), F.col("greatest").alias("high"), (F.col("before") + F.sum("c").over(w) - F.col("c")).alias("b"), "c")
        left = sorted({at for k, at in wanted.items() if k not in out})
        hit = F.exists(F.array(*(F.lit(at).cast("long") for at in left)), lambda at: (at >= F.col("b")) & (at < F.col("b") + F.col("c")))
        found = each.where(hit).collect()  # one row a wanted rank at most
        if fine:
            out |= {k: r.low for r in found for k, at in wanted.items() if r.b <= at < r.b + r.c and k not in out}
            break
        open_ = [(k, r.low, r.high, r.b, r.c) for k, r in enumerate(found)]
        names = F.broadcast(spark.createDataFrame([(r.id, r.part, k) for k, r in enumerate(found)], "id int, part int, next int"))
        table = cut.join(names, ["id", "part"]).select("v", F.col("next").alias("id"))
    return out


def quantiles(rows: DataFrame, value: str, shares: list[float], least: int = LEAST) -> list[float]:
    """Quantiles by linear interpolation between neighbouring ranks; empty without values."""
    n = 0

    def neighbours(count: int) -> list[int]:
        nonlocal n
        n = count
        return sorted({k for s in shares for k in (int(s * (n - 1)), min(int(s * (n - 1)) + 1, n - 1))})

    at = ranked(rows, value, neighbours, least)
    places = [s * (n - 1) for s in shares] if n else []
    return [at[int(p)] if p == int(p) else (int(p) + 1 - p) * at[int(p)] + (p - int(p)) * at[int(p) + 1] for p in places]
