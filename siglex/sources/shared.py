"""Tables in the folder that the cluster shares, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a session on one machine may do without."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="siglex-"))
    return sc.getCheckpointDir().rstrip("/")


def path(spark: SparkSession, label: str) -> str:
    """A new place for a table."""
    return f"{folder(spark)}/siglex-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` and read it back."""
    place = path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def removed(spark: SparkSession, place: str) -> None:
    """Delete a table that nothing reads any more, by the file system of its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, place: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def moved(spark: SparkSession, place: str, to: str) -> bool:
    """Rename a table; false where ``to`` is there already."""
    if exists(spark, to):
        return False
    path, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (place, to))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).rename(path, target)
