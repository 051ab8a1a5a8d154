"""Whole studies as compositions of the operators: signal -> codes -> tokens -> features -> validated model -> result rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglex.operators import bpe, folds, forests, models, signals, stats
from siglex.sources.shared import written
from siglex.sources.tables import union_results

TRIAL = ["subject", "trial", "label"]
KEY = [*TRIAL, "channel"]


def coded(samples: DataFrame, method: str = "uniform", bins: int = 16, norm: str = "per_row") -> DataFrame:
    """Code sequences (subject, trial, label, channel, toks) of normalised samples."""
    z = signals.quantise(signals.NORMALISERS[norm](samples), method, bins)
    return written(bpe.sequences(z.select(*KEY, F.col("t").alias("pos"), F.col("code").alias("tok")), KEY), "codes")


def tokenised(seqs: DataFrame, bins: int, vocabulary: int, training: DataFrame | None = None) -> DataFrame:
    """Sequences under merges trained on ``training`` (all of them by default)."""
    return bpe.tokenise(seqs, bpe.train(seqs if training is None else training, bins, vocabulary), bins)


def vectors(hist: DataFrame, key: list[str], size: int, value: str = "share") -> DataFrame:
    """(key, features): one vector of ``size`` entries for each row of a histogram (key, token, value)."""
    of = hist.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("token", value))).alias("m"))  # no more entries than ids
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return of.select(*key, array_to_vector(dense).alias("features"))


def histogram_rows(tokens: DataFrame, size: int, transform: str = "raw") -> DataFrame:
    """Feature rows of token sequences: shares by trial, raw, log, binary or tf-idf."""
    hist = stats.histogram(bpe.exploded(tokens, TRIAL), TRIAL)
    return vectors(hist, TRIAL, size) if transform == "raw" else vectors(stats.transforms(hist, TRIAL), TRIAL, size, transform)


def joined(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two feature sets of the same trials side by side."""
    both = one.join(other.withColumnRenamed("features", "more"), TRIAL)
    return both.select(*TRIAL, array_to_vector(F.concat(vector_to_array("features"), vector_to_array("more"))).alias("features"))


def reduced(rows: DataFrame, k: int) -> DataFrame:
    """Features on their first ``k`` principal components, where they have more columns."""
    size = rows.select(F.size(vector_to_array("features")).alias("n")).first()
    if size is None or size.n <= k:
        return rows
    model = PCA(k=k, inputCol="features", outputCol="reduced").fit(rows)
    return model.transform(rows).drop("features").withColumnRenamed("reduced", "features")


def perceptron(train: DataFrame, hidden: tuple[int, ...] = (128, 64), iterations: int = 40, seed: int = 42) -> object:
    shape = train.select(F.size(vector_to_array("features")).alias("n"), "label").agg(F.max("n").alias("n"), F.max("label").alias("top")).first()
    return MultilayerPerceptronClassifier(layers=[shape.n, *hidden, shape.top + 1], maxIter=iterations, seed=seed).fit(train)


class Discriminant:
    """Linear discriminant with a pooled covariance; a model of means and one matrix."""

    def __init__(self, labels: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        self.labels, self.weights, self.bias = labels, weights, bias

    def transform(self, rows: DataFrame) -> DataFrame:
        x = vector_to_array("features")
        score = lambda w, b: F.aggregate(F.zip_with(x, F.array(*map(F.lit, w.tolist())), lambda u, v: u * v), F.lit(float(b)), lambda s, v: s + v)
        scores = F.array(*(F.struct(score(w, b).alias("s"), F.lit(int(c)).alias("c")) for c, w, b in zip(self.labels, self.weights, self.bias, strict=True)))
        return rows.withColumn("prediction", F.array_max(scores)["c"].cast("double"))


def discriminant(train: DataFrame, ridge: float = 1e-3) -> Discriminant:
    """Class means and pooled covariance by one aggregation: sums of features and of their products, one matrix a class and task."""
    rows = folds.plain(train).select(F.col("label").cast("long").alias("label"), "features")

    def moments(p: folds.Batch) -> dict[int, np.ndarray]:
        return {int(c): np.vstack([x.T @ x, x.sum(0), np.full(x.shape[1], len(x))]) for c in np.unique(p["label"]) for x in [p["x"][p["label"] == c]]}

    found = folds.summed(rows, ["label"], moments)
    if not found:
        raise ValueError("no rows to fit on")
    n = next(iter(found.values())).shape[1]
    if n > folds.WIDEST:
        raise ValueError(f"{n} features: products are summed for up to {folds.WIDEST}")
    sums = {c: np.concatenate([[m[n + 1, 0]], m[n], m[:n].ravel()]) for c, m in found.items()}
    labels = sorted(sums)
    counts = np.array([sums[c][0] for c in labels])
    mean = np.array([sums[c][1 : n + 1] for c in labels]) / counts[:, None]
    second = sum(sums[c][n + 1 :].reshape(n, n) for c in labels)
    pooled = (second - sum(c * np.outer(m, m) for c, m in zip(counts, mean, strict=True))) / max(1.0, counts.sum() - len(labels))
    weights = np.linalg.solve(pooled + ridge * np.trace(pooled) / n * np.eye(n) + 1e-12 * np.eye(n), mean.T).T
    return Discriminant(np.array(labels), weights, -0.5 * (weights * mean).sum(1) + np.log(counts / counts.sum()))


def spatial_filters(samples: DataFrame, components: int) -> DataFrame:
    """(component, channel, w): common spatial patterns, each class against all, from the class covariances (a channels-squared table)."""
    rows = signals.class_covariance(samples).collect()
    names, labels = sorted({c for r in rows for c in (r.c1, r.c2)}), sorted({r.label for r in rows})
    cov = {c: np.zeros((len(names), len(names))) for c in labels}
    for r in rows:
        i, j = names.index(r.c1), names.index(r.c2)
        cov[r.label][i, j] = cov[r.label][j, i] = r["cov"]
    cov = {c: m / max(np.trace(m), 1e-12) for c, m in cov.items()}
    total = sum(cov.values()) + 1e-9 * np.eye(len(names))
    value, vector = np.linalg.eigh(total)
    white = (vector / np.sqrt(np.maximum(value, 1e-12))).T
    out = []
    for c in labels:
        _, own = np.linalg.eigh(white @ cov[c] @ white.T)
        for k in range(components):
            out += [(f"{c}:{k}", ch, float(w)) for ch, w in zip(names, own[:, -1 - k] @ white, strict=True)]
    return samples.sparkSession.createDataFrame(out, "component string, channel string, w double")


def log_variance_rows(samples: DataFrame, filters: DataFrame) -> DataFrame:
    """Feature rows: log variance of each spatially filtered component."""
    v = signals.spatial_filter(samples, filters).groupBy(*TRIAL, "component").agg(F.log(F.var_pop("x") + 1e-12).alias("v"))
    return v.groupBy(*TRIAL).agg(array_to_vector(F.transform(F.array_sort(F.collect_list(F.struct("component", "v"))), lambda s: s["v"])).alias("features"))


MODELS: dict[str, Callable[[DataFrame], object]] = {
    "logreg": lambda d: models.logistic(d, 30),
    "forest": lambda d: models.forest(d, 200, 20),
    "mlp": perceptron,
    "lda": discriminant,
}


def predictions(rows: DataFrame, folds: DataFrame, model: str, k: int) -> DataFrame:
    """(fold, y, p) of every row by the model of the folds it is not in; forests of all folds are grown together."""
    if model == "forest":
        return forests.cross_validated(rows, folds, k, 200, 20)
    return models.cross_validated(rows, folds, "subject", MODELS[model], k)


def validated(rows: DataFrame, model: str = "logreg", k: int = 2, seed: int = 42, by: list[str] | None = None, pca: int | None = None) -> DataFrame:
    """Metrics of a model under subject folds: (by, accuracy, balanced_accuracy, macro_f1, kappa)."""
    rows = written(rows if pca is None else reduced(rows, pca), "features")
    folds = stats.group_folds(rows.select("subject"), k, seed)
    return stats.classification(predictions(rows, folds, model, k), by or [])


def study(conditions: dict[str, DataFrame], model: str = "logreg", k: int = 2) -> DataFrame:
    """One result row for each condition's feature rows."""
    return union_results(*(validated(rows, model, k).select(F.lit(name).alias("condition"), "*") for name, rows in conditions.items()))


def psd_rows(samples: DataFrame, rate: float, bands: dict[str, tuple[float, float]]) -> DataFrame:
    p = signals.welch_bands(samples.drop("label"), 16, rate, bands)
    labels = samples.select(*TRIAL).distinct()
    return p.join(labels, ["subject", "trial"]).select(*TRIAL, array_to_vector(F.array(*bands)).alias("features"))


def array_rows(values: DataFrame, order: list[str], value: str, samples: DataFrame) -> DataFrame:
    """Feature rows from long values (subject, trial, order, value)."""
    a = values.groupBy("subject", "trial").agg(array_to_vector(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda s: s[value])).alias("features"))
    return a.join(samples.select(*TRIAL).distinct(), ["subject", "trial"]).select(*TRIAL, "features")


def vq_tokens(rows: DataFrame, order: str, k: int) -> DataFrame:
    """Sequences of codebook codes of vectors (subject, trial, label, order, features)."""
    out, _ = models.codes(rows, k)
    return bpe.sequences(out.select(*TRIAL, F.col(order).alias("pos"), F.col("code").alias("tok")), TRIAL)
