"""Models and codebooks: cross-validated classifiers, k-means codes, envelopes, streaming-free pipelines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siglex.operators import bpe, filters, forests, signals, spectra, stats
from siglex.sources import tables as T
from siglex.sources.shared import written


def dense(samples: DataFrame, key: list[str], n: int) -> DataFrame:
    """One vector of ``n`` values for each key, by t."""
    rows = samples.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda s: s["x"]).alias("a"))
    return rows.where(F.size("a") == n).withColumn("features", array_to_vector("a")).drop("a")


def class_weights(df: DataFrame) -> DataFrame:
    """``weight`` N / (k n_c), from the counts of the labels."""
    counts = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}  # one for each label
    table = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, sum(counts.values()) / (len(counts) * n))))
    return df.withColumn("weight", table[F.col("label")])


def logistic(train: DataFrame, max_iter: int = 50, c: float = 1.0):
    weighted = class_weights(train)
    total = weighted.agg(F.sum("weight")).first()[0]
    return LogisticRegression(weightCol="weight", regParam=1.0 / (c * total), maxIter=max_iter, standardization=False).fit(weighted)


def forest(train: DataFrame, trees: int = 50, depth: int = 8, seed: int = 42):
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(train)


def cross_validated(rows: DataFrame, folds: DataFrame, key: str, fit: Callable[[DataFrame], object], k: int) -> DataFrame:
    """Predictions (fold, y, p) of every row by the model of the folds it is not in; features are scaled in the fold."""
    rows = rows.join(folds, key).persist()
    out = None
    for fold in range(k):
        train, test = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(train)
        scale = lambda d, s=scaler: s.transform(d).drop("features").withColumnRenamed("scaled", "features")
        p = fit(scale(train)).transform(scale(test)).select("fold", F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("p"))
        out = p if out is None else out.unionByName(p)
    return out


def codes(rows: DataFrame, k: int, seed: int = 42) -> tuple[DataFrame, KMeansModel]:
    """``code`` of every vector by a k-means codebook."""
    model = KMeans(k=k, seed=seed, predictionCol="code", maxIter=10).fit(rows)
    return model.transform(rows), model


def multiband_envelope(samples: DataFrame, rate: float, bands: dict[str, tuple[float, float]], factor: int = 1) -> DataFrame:
    """Amplitude of the analytic signal of every row within each band, as channels ``channel:band``, resampled by 1 / ``factor`` behind a low-pass.

    Rows of a batch that are equally long go through one FFT as a matrix.
    """
    rows = samples.groupBy("subject", "trial", "channel", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda s: s["x"]).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(4)
            sizes, flat = column.value_lengths().to_numpy(), np.asarray(column.flatten(), float)
            ends = np.cumsum(sizes)
            for n in np.unique(sizes[sizes > 0]):
                own = np.flatnonzero(sizes == n)
                x = flat[(ends[own] - n)[:, None] + np.arange(n)]
                spectrum, hz = np.fft.fft(x - x.mean(1, keepdims=True), axis=1), np.fft.fftfreq(n, 1 / rate)
                part = batch.take(pa.array(own))
                for name, (low, high) in bands.items():
                    y = np.abs(np.fft.ifft(np.where((hz >= low) & (hz <= high) & (hz > 0), 2 * spectrum, 0), axis=1))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array([name] * len(own)), lists], [*batch.schema.names[:4], "band", "x"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:4]) + ", band string, x array<double>"
    out = rows.mapInArrow(run, schema)
    long = out.select("subject", "trial", F.concat_ws(":", "channel", "band").alias("channel"), "label", F.posexplode("x").alias("t", "x"))
    return filters.rational(long, 1, factor)


def envelope(samples: DataFrame, rate: float, low: float, high: float, factor: int = 1) -> DataFrame:
    """``multiband_envelope`` of one band, under the channels' own names."""
    e = multiband_envelope(samples, rate, {"": (low, high)}, factor)
    return e.withColumn("channel", F.regexp_replace("channel", ":$", ""))


def _trials(spark: SparkSession, sf: str) -> DataFrame:
    return dense(T.embed_trials(spark, sf), ["subject", "trial", "label"], 64)


def _subject_folds(spark: SparkSession, sf: str) -> DataFrame:
    return stats.group_folds(T.embed_trials(spark, sf).select("subject"), 3, 42)


def logreg_cv(spark: SparkSession, sf: str) -> DataFrame:
    return stats.classification(cross_validated(_trials(spark, sf), _subject_folds(spark, sf), "subject", logistic, 3), ["fold"])


def rf_cv(spark: SparkSession, sf: str) -> DataFrame:
    return stats.classification(forests.cross_validated(_trials(spark, sf), _subject_folds(spark, sf), 3, 200, 20), ["fold"])


def kmeans_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Patch codebook: patches of eight samples as vectors, 16 codes, histogram of codes by label."""
    p = signals.segments(T.embed_trials(spark, sf), 8).withColumn("t", F.col("t_in"))
    coded, _ = codes(dense(p, ["trial", "segment", "label"], 8), 16)
    return coded.groupBy("label", "code").agg(F.count("*").alias("n"))


def spatial_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Codebook over the aligned channels of each time step, then merges over the code sequences."""
    channels = list(T.LINEITEM_CHANNELS)
    z = signals.zscore_columns(T.lineitem_wide(spark, sf), channels, ["subject", "trial"])
    rows = written(z.select("subject", "trial", "t", array_to_vector(F.array(*channels)).alias("features")), "steps")
    coded, _ = codes(rows, 16)
    seqs = written(bpe.sequences(coded.select("subject", "trial", F.col("t").alias("pos"), F.col("code").alias("tok")), ["subject", "trial"]), "states")
    tokens = bpe.tokenise(seqs, bpe.train(seqs, 16, 24, relaxed=4), 16)
    return tokens.select("subject", "trial", F.size("toks").alias("n_tokens"))


def spectral_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Log-power frames as vectors, 16 codes, counts by label."""
    rows = spectra.binned(T.embed_trials(spark, sf), 16, 8, finish=np.log1p).select("trial", "frame", F.col("bin").alias("t"), F.col("power").alias("x"))
    coded, _ = codes(dense(rows, ["trial", "frame"], 9), 16)
    return coded.groupBy("code").agg(F.count("*").alias("n"))


def bpe_train_relaxed(spark: SparkSession, sf: str) -> DataFrame:
    z = signals.zscore(T.events_signal(spark, sf))
    coded = signals.quantise(z, "uniform", 64).select("subject", "channel", F.col("t").alias("pos"), F.col("code").alias("tok"))
    return bpe.merge_table(spark, bpe.train(bpe.sequences(coded, ["subject", "channel"]), 64, 96, relaxed=8), 64)


QUERIES = {
    "logreg_cv": logreg_cv,
    "rf_cv": rf_cv,
    "kmeans_codes": kmeans_codes,
    "spatial_tokens": spatial_tokens,
    "spectral_tokens": spectral_tokens,
    "bpe_train_relaxed": bpe_train_relaxed,
}
