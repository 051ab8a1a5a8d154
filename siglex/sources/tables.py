"""Sources and sinks: driver tables as long signal tables, dataset tables, result tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siglex.sources import shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(df: DataFrame, subject: Column, trial: Column, channel: Column, order: list[str], x: Column, label: Column) -> DataFrame:
    """Long samples (subject, trial, channel, t, x, label), numbered from 0 within a row key."""
    keyed = df.select(subject.alias("subject"), trial.alias("trial"), channel.alias("channel"), x.cast("double").alias("x"), label.alias("label"), *(F.col(c).alias(f"o_{c}") for c in order))
    w = Window.partitionBy("subject", "trial", "channel").orderBy(*(f"o_{c}" for c in order))
    return keyed.withColumn("t", (F.row_number().over(w) - 1).cast("int")).select("subject", "trial", "channel", "t", "x", "label")


def events_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel for each event type of a user."""
    e = table(spark, sf_dir, "events")
    return signal(e, F.col("user_id"), F.lit(0), F.col("event_type"), ["ts", "event_id"], F.col("value"), F.col("event_type"))


def events_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trial for each event type of a user, labelled by it."""
    e = table(spark, sf_dir, "events")
    return signal(e, F.col("user_id"), F.col("event_type"), F.lit("value"), ["ts", "event_id"], F.col("value"), F.col("event_type"))


def embed_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64-sample trial for each vector; ten subjects."""
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") % 10).alias("subject"), F.col("vec_id").alias("trial"), F.lit("e").alias("channel"), "label", F.posexplode("embedding").alias("t", "x")).select(
        "subject", "trial", "channel", "t", F.col("x").cast("double").alias("x"), "label"
    )


#: Channels of ``lineitem_multi`` and their columns.
LINEITEM_CHANNELS = {"quantity": "l_quantity", "extendedprice": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}


def lineitem_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, trial, label, t, channels): the time steps of each supplier and return flag, a column a channel."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_suppkey", "l_returnflag").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    flag = F.col("l_returnflag")
    return li.select(F.col("l_suppkey").alias("subject"), flag.alias("trial"), flag.alias("label"), (F.row_number().over(w) - 1).cast("int").alias("t"), *(F.col(c).alias(n) for n, c in LINEITEM_CHANNELS.items()))


def lineitem_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four aligned channels of each supplier and return flag."""
    pairs = F.array(*(F.struct(F.lit(n).alias("channel"), F.col(n).alias("x")) for n in LINEITEM_CHANNELS))
    return lineitem_wide(spark, sf_dir).select("subject", "trial", "t", F.explode(pairs).alias("c"), "label").select("subject", "trial", "c.channel", "t", "c.x", "label")


def doc_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, subject, trial, chars) of the documents that have text."""
    d = table(spark, sf_dir, "documents").where("text is not null and text <> ''")
    return d.select(F.col("lang").alias("dataset"), F.col("source").alias("subject"), F.col("doc_id").alias("trial"), F.filter(F.split("text", ""), lambda c: c != "").alias("chars"))


def char_counts(spark: SparkSession, sf_dir: str, by: list[str]) -> DataFrame:
    """(by, tok, n): how often each character occurs, counted before any code is given."""
    rows = doc_chars(spark, sf_dir).select(*by, F.explode("chars").alias("ch")).groupBy(*by, "ch").agg(F.count("*").alias("n"))
    codes = alphabet(rows)
    return rows.join(F.broadcast(codes), "ch").select(*by, "tok", "n")  # no more rows than Unicode has characters


def alphabet(chars: DataFrame) -> DataFrame:
    """(ch, tok): ranks of the distinct characters by their UTF-8 bytes; at most as many as Unicode has."""
    return chars.select("ch").distinct().withColumn("tok", (F.row_number().over(Window.orderBy(F.encode("ch", "UTF-8"))) - 1).cast("int"))


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of documents as codes: (dataset, subject, trial, pos, tok); codes are ranks of distinct characters."""
    d = doc_chars(spark, sf_dir)
    codes = alphabet(d.select(F.explode(F.array_distinct("chars")).alias("ch")))
    return d.select("dataset", "subject", "trial", F.posexplode("chars").alias("pos", "ch")).join(F.broadcast(codes), "ch").select("dataset", "subject", "trial", "pos", "tok")


#: Data sets by name.
LOADERS = {"events_signal": events_signal, "events_trials": events_trials, "embed_trials": embed_trials, "lineitem_multi": lineitem_multi}
#: Rate, classes, paradigm and validation of each data set.
REGISTRY = (
    ("events_signal", 1.0, 5, "workload", "kfold"), ("events_trials", 1.0, 5, "workload", "kfold"),
    ("embed_trials", 64.0, 10, "motor", "loso"), ("lineitem_multi", 1.0, 3, "sleep", "kfold"),
)


def registry(spark: SparkSession) -> DataFrame:
    """(dataset, rate, n_classes, paradigm, validation)."""
    return spark.createDataFrame(REGISTRY, "dataset string, rate double, n_classes int, paradigm string, validation string")


def load_dataset(spark: SparkSession, sf_dir: str, name: str, subjects: list | None = None, max_subjects: int | None = None) -> DataFrame:
    """The samples of a named data set, of the given subjects, or of the first ``max_subjects``."""
    samples = LOADERS[name](spark, sf_dir)
    if subjects is not None:
        samples = samples.where(F.col("subject").isin(subjects))
    return samples if max_subjects is None else first_subjects(samples, max_subjects)


def first_subjects(samples: DataFrame, n: int) -> DataFrame:
    """Only the ``n`` least subjects."""
    few = samples.select("subject").distinct().orderBy("subject").limit(n)
    return samples.join(F.broadcast(few), "subject", "left_semi")  # n rows


def load_summary(samples: DataFrame) -> DataFrame:
    """Trials, subjects and samples by label."""
    return samples.groupBy("label").agg(F.count_distinct("subject", "trial").alias("n_trials"), F.count_distinct("subject").alias("n_subjects"), F.count("*").alias("n_samples"))


def encoded_labels(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``code``: names in sorted order as 0, 1, ..."""
    names = df.select(column).distinct()
    codes = names.withColumn("code", (F.row_number().over(Window.orderBy(column)) - 1).cast("int"))  # as many rows as there are labels
    return df.join(codes, column)


def mapped_labels(df: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a label map on a composite key; rows without a class go."""
    return df.join(mapping, keys)


def union_results(*tables: DataFrame) -> DataFrame:
    """Rows of result tables with different columns; what one lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def append_results(df: DataFrame, path: str, schema: list[str]) -> None:
    """Append under a declared schema: columns beyond it go, missing ones are null."""
    df.select(*((F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in schema)).write.mode("append").parquet(path)


def latest_results(df: DataFrame, key: list[str], at: str) -> DataFrame:
    """One row for each key, the latest."""
    w = Window.partitionBy(*key).orderBy(F.desc(at))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pending(grid: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Configurations without a result."""
    return grid.join(done, key, "left_anti")


def grouped_names(df: DataFrame, column: str, classes: dict[str, str]) -> DataFrame:
    """``df`` with ``stage``: several names of ``column`` stand for one class; rows without a class go."""
    names = F.create_map(*(F.lit(v) for pair in classes.items() for v in pair))
    return df.withColumn("stage", names[F.col(column)]).where("stage is not null")


def save_csv(path: str, *parts: DataFrame) -> None:
    """Result tables under the union of their columns, as CSV with a header."""
    union_results(*parts).write.mode("overwrite").option("header", True).csv(path)


def load_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def config_hash(*columns: str) -> Column:
    """A digest of a configuration; equal ones share it."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def logged(results: DataFrame, experiment: str, config: list[str]) -> DataFrame:
    """Results with the name of the experiment, the digest of their configuration and the time of the run."""
    return results.withColumn("experiment", F.lit(experiment)).withColumn("config", config_hash(*config)).withColumn("logged_at", F.current_timestamp())


def content_digest(rows: DataFrame) -> str:
    """A digest of a table's schema and rows, whatever their order: their number and the sums of two hashes of each, added up map-side."""
    columns = sorted(rows.columns)
    each = [F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in columns)).cast("decimal(38,0)") for seed in (1, 2)]
    total = rows.agg(F.count("*").alias("n"), *(F.sum(h).alias(f"h{k}") for k, h in enumerate(each))).first()
    text = json.dumps([[(c, rows.schema[c].dataType.simpleString()) for c in columns], *(str(v) for v in total)])
    return hashlib.sha256(text.encode()).hexdigest()


def materialised(spark: SparkSession, folder: str, params: dict[str, object], made: Callable[[], DataFrame], inputs: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``made()`` as a table named by the digests of its parameters and of the content of its inputs; built once, read ever after.

    A changed row of an input gives another name. The table is written aside and moved to
    its name when whole, so that no reader meets half of it; if another writer came first, its table is read.
    """
    key = json.dumps([params, [content_digest(d) for d in inputs]], sort_keys=True)
    name = hashlib.sha256(key.encode()).hexdigest()
    place, aside = f"{folder}/features-{name}", f"{folder}/features-{name}-{uuid.uuid4().hex}"
    if not shared.exists(spark, place):
        made().write.parquet(aside)
        if not shared.moved(spark, aside, place):
            shared.removed(spark, aside)
    return spark.read.parquet(place)
