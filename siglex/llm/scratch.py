"""Intermediate tables in the folder the cluster shares, and bounded bit tables.

Lineage is cut with written Parquet tables under ``spark.checkpoint.dir`` so
that a lost executor costs one re-read and never a recomputation. Only where
that setting is absent (tests on one machine) is a folder of our own used.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits in one bitmap of Spark's bitmap_construct_agg.
BITMAP_BITS = 32768
ROW_GROUP = 32 << 20  # bytes that a task holds before they are written


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or a checkpoint folder that was set by hand.

    With neither, only a session on one machine gets a folder of its own; on a
    cluster that would be unreachable for others, so it is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="siglex-"))
    return sc.getCheckpointDir().rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/siglex-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.place = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.place)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go as it ends; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def long_array(values: list[int]) -> Column:
    """An array of longs that the optimiser folds into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def bit_table(df: DataFrame, hashed: Column, log2_bits: int) -> bytes:
    """Bits of a table with ``2**log2_bits`` places, set where ``hashed`` falls.

    Its size is the caller's bound, so it may be broadcast. More values
    only make it less selective; whoever uses it must stay right when every
    bit is set. Built by Spark as bitmaps of 4 KB, merged map-side.
    """
    place = F.pmod(hashed, F.lit(1 << log2_bits)) + 1  # the bitmap functions number from 1
    rows = (
        df.select(place.alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
        .collect()
    )
    size = (1 << log2_bits) // 8
    table = bytearray(size + BITMAP_BITS // 8)
    for row in rows:  # at most 2**log2_bits / 32768 rows
        at = (row.b - 1) * (BITMAP_BITS // 8)
        table[at : at + len(row.bits)] = row.bits
    return bytes(table[:size])
