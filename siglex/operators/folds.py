"""Everything that is fitted, fitted for every fold at once on the rows outside it.

Rows carry a ``fold`` (the one that holds them out), and a ``model`` where their features are
made by that fold's own fit; those of fold f's fit then stand in rows of model f. What a fit needs is summed by fold in
one job over the data; a fold's own fit takes the sums of all other folds,
so that no number of a held-out row enters it. Iterative fits (codebooks, logistic
models) keep the parameters of all folds on the driver and make one
such job a step. Parameters are bounded by folds x features x classes (or codes).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siglex.functions import scalar
from siglex.operators import signals
from siglex.sources.shared import written

CELLS = 1 << 22  # numbers of a matrix that a task makes at once
WIDEST = 2048  # features of which products are summed
BLOCK = 1 << 17  # numbers of a matrix that travel as one value
SEEDS = 4096  # rows, by a hash, among which first codes are chosen
Batch = dict[str, np.ndarray]


def plain(rows: DataFrame) -> DataFrame:
    """``features`` as an array of doubles."""
    if rows.schema["features"].dataType.typeName() == "array":
        return rows.withColumn("features", F.col("features").cast("array<double>"))
    return rows.withColumn("features", vector_to_array("features"))


def placed(rows: DataFrame, folds: DataFrame, key: str = "subject") -> DataFrame:
    """Rows with the fold that holds them out, and plain features; written, as every step reads them."""
    return written(plain(rows.join(folds.select(key, F.col("fold").cast("int").alias("fold")), key)), "folded")


def _read(batch: pa.RecordBatch) -> Iterator[Batch]:
    """Columns as arrays, ``features`` as a matrix, in pieces of bounded size; rows of other lengths than the first are an error."""
    names = batch.schema.names
    at = names.index("features")
    width = len(batch.column(at)[0]) if batch.num_rows else 0
    step = max(1, CELLS // max(1, width))
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        out = {n: part.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names) if i != at}
        yield out | {"x": np.asarray(part.column(at).flatten(), float).reshape(part.num_rows, width)}


def summed(rows: DataFrame, columns: list[str], function: Callable[[Batch], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """For each key, the sum of the matrices that ``function`` gives for pieces of the rows; a task sends a matrix in blocks of lines, which Spark adds."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece in _read(batch):
                for k, m in function(piece).items():
                    total[k] = total[k] + m if k in total else m
        blocks = []
        for k, m in total.items():
            lines = max(1, BLOCK // m.shape[1])
            blocks += [(k, at, m.shape[1], np.ascontiguousarray(m[at : at + lines], "<f8").tobytes()) for at in range(0, len(m), lines)]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in blocks], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["key", "at", "width", "block"])

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(x, "<f8") for batch in batches for x in batch.column("block").to_pylist())
        yield pa.RecordBatch.from_arrays([*(pa.array([v.as_py()], pa.int32()) for v in key), pa.array([total.tobytes()], pa.binary())], ["key", "at", "width", "block"])

    schema = "key int, at int, width int, block binary"
    found: dict[int, list] = {}
    for r in rows.select(*columns, "features").mapInArrow(parts, schema).groupBy("key", "at", "width").applyInArrow(merged, schema).collect():
        found.setdefault(r.key, []).append((r.at, np.frombuffer(bytes(r.block), "<f8").reshape(-1, r.width)))
    return {k: np.concatenate([v for _, v in sorted(blocks, key=lambda x: x[0])]) for k, blocks in found.items()}


def outside(sums: dict[int, np.ndarray], k: int) -> dict[int, np.ndarray]:
    """For each of ``k`` folds the sum over all other folds, from running sums of both sides: its own numbers are never added."""
    zero = 0 * next(iter(sums.values()))
    before, behind = [zero], [zero]
    for f in range(k):
        before.append(before[-1] + sums.get(f, zero))
        behind.append(behind[-1] + sums.get(k - 1 - f, zero))
    return {f: before[f] + behind[k - 1 - f] for f in range(k)}


def _outside(rows: DataFrame, columns: list[str], k: int, function: Callable[[np.ndarray, Batch], np.ndarray]) -> dict[int, np.ndarray]:
    """For each fold the sum of ``function(matrix, columns)`` over its training rows."""
    key = "model" if "model" in rows.columns else "fold"

    def parts(p: Batch) -> dict[int, np.ndarray]:
        return {int(f): function(p["x"][own], {n: v[own] for n, v in p.items()}) for f in np.unique(p[key]) for own in [np.flatnonzero(p[key] == f)]}

    if key == "model":
        found = summed(rows.where("fold <> model"), [key, *columns], parts)
        return {f: found[f] for f in range(k)}
    return outside(summed(rows, [key, *columns], parts), k)


def scales(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(means, deviations), a line a fold; a feature that does not vary has deviation one."""
    sums = _outside(rows, [], k, lambda x, _: np.stack([np.full(x.shape[1], len(x)), x.sum(0), (x * x).sum(0)]))
    table = np.stack([sums[f] for f in range(k)])
    n = np.maximum(table[:, 0], 1)
    mean = table[:, 1] / n
    spread = np.sqrt(np.maximum(table[:, 2] / n - mean**2, 0))
    return mean, np.where(spread > 1e-12 * np.maximum(1, np.abs(mean)), spread, 1.0)


def components(rows: DataFrame, k: int, n: int) -> np.ndarray:
    """(fold, n, features): principal components of each fold's training rows."""
    mean, _ = scales(rows, k)
    if mean.shape[1] > WIDEST:
        raise ValueError(f"{mean.shape[1]} features: products are summed for up to {WIDEST}")
    centre = mean.mean(0)
    sums = _outside(rows, [], k, lambda x, _: np.vstack([(x - centre).T @ (x - centre), (x - centre).sum(0), np.full(x.shape[1], len(x))]))
    out = []
    for f in range(k):
        d = mean.shape[1]
        count = max(sums[f][d + 1, 0], 1)
        rest = sums[f][d] / count
        _, vector = np.linalg.eigh(sums[f][:d] / count - np.outer(rest, rest))
        own = vector[:, ::-1][:, :n].T
        out.append(own * np.where(own[np.arange(len(own)), np.abs(own).argmax(1)] < 0, -1, 1)[:, None])
    return np.stack(out)


def wide_components(rows: DataFrame, n: int, more: int = 10, rounds: int = 4, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """((n, features) principal components, their variances) of rows with many features, without a matrix of features squared.

    A random range finder with power rounds: each round one job sums X'X Q for a thin Q (n + ``more`` columns),
    which the driver makes orthonormal; the last solves the small matrix Q'X'X Q.
    """
    held = plain(rows).select("features")
    first = summed(held, [], lambda p: {0: np.vstack([p["x"].sum(0), np.full(p["x"].shape[1], len(p["x"]))])})[0]
    mean, total = first[0] / first[1, 0], first[1, 0]
    d = len(mean)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, min(d, n + more))))[0]

    def products(p: Batch, q: np.ndarray) -> dict[int, np.ndarray]:
        x = p["x"] - mean
        return {0: x.T @ (x @ q)}

    for _ in range(rounds):
        q = np.linalg.qr(summed(held, [], lambda p, q=q: products(p, q))[0])[0]
    value, vector = np.linalg.eigh(q.T @ summed(held, [], lambda p: products(p, q))[0] / total)
    own = (q @ vector[:, ::-1][:, :n]).T
    return own * np.where(own[np.arange(len(own)), np.abs(own).argmax(1)] < 0, -1, 1)[:, None], value[::-1][:n]


def transformed(rows: DataFrame, function: Callable[[int, np.ndarray], np.ndarray], k: int, training: bool = True) -> DataFrame:
    """Rows (.., fold, model, features) as each fold's fit sees them: ``function(model, matrix)``; with ``training`` false only those held out."""
    names = [c for c in rows.columns if c != "features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in range(k):
                own = batch if training else batch.filter(pa.array(batch.column(names.index("fold")).to_numpy() == f))
                start = 0
                for piece in _read(own):
                    y = np.ascontiguousarray(function(f, piece["x"]))
                    part = own.slice(start, len(y))
                    start += len(y)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(np.full(len(y), f, np.int32)), lists], [*names, "model", "features"])

    return rows.select(*names, "features").mapInArrow(run, StructType([*(rows.schema[c] for c in names), *StructType.fromDDL("model int, features array<double>")]))


def spatial_filters(samples: DataFrame, folds: DataFrame, k: int, n: int) -> tuple[dict[int, dict[str, np.ndarray]], list[str]]:
    """({fold: {component: weights}}, channels): common spatial patterns of each fold's training subjects, each class against all.

    Class covariances come from sums of products by fold and label, one job for all folds.
    """
    steps = samples.groupBy("subject", "trial", "t", "label").agg(F.map_from_entries(F.collect_list(F.struct("channel", "x"))).alias("m"))  # the channels of a time step
    names = sorted(r.channel for r in samples.select("channel").distinct().collect())
    labels = sorted(r.label for r in samples.select("label").distinct().collect())
    vectors = steps.select("subject", F.array_position(F.array(*map(F.lit, labels)), F.col("label")).cast("int").alias("y"), F.array(*(F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(0.0)) for c in names)).alias("features"))
    rows = vectors.join(folds.select("subject", F.col("fold").cast("int").alias("fold")), "subject").withColumn("key", F.col("fold") * len(labels) + F.col("y") - 1)
    c = len(names)
    products = summed(rows, ["key"], lambda p: {int(key): np.vstack([x.T @ x, x.sum(0), np.full(c, len(x))]) for key in np.unique(p["key"]) for x in [p["x"][p["key"] == key]]})
    return _patterns(products, labels, c, k, n), names


def _patterns(products: dict[int, np.ndarray], labels: list, c: int, k: int, n: int) -> dict[int, dict[str, np.ndarray]]:
    """Common spatial patterns of each fold from (products, sums, counts) by fold and label."""
    zero = np.zeros((c + 2, c))
    stacked = outside({f: np.concatenate([products.get(f * len(labels) + y, zero) for y in range(len(labels))]) for f in range(k)}, k)
    out: dict[int, dict[str, np.ndarray]] = {}
    for f in range(k):
        cov = {}
        for y, label in enumerate(labels):
            own = stacked[f][y * (c + 2) : (y + 1) * (c + 2)]
            count = max(own[c + 1, 0], 1)
            m = own[:c] / count - np.outer(own[c], own[c]) / count**2
            cov[label] = m / max(np.trace(m), 1e-12)
        value, vector = np.linalg.eigh(sum(cov.values()) + 1e-9 * np.eye(c))
        white = (vector / np.sqrt(np.maximum(value, 1e-12))).T
        out[f] = {}
        for label in labels:
            _, own = np.linalg.eigh(white @ cov[label] @ white.T)
            for j in range(min(n, c)):
                w = own[:, -1 - j] @ white
                out[f][f"{label}:{j}"] = w * (-1 if w[np.abs(w).argmax()] < 0 else 1)
    return out


def filtered(samples: DataFrame, filters: dict[int, dict[str, np.ndarray]], names: list[str]) -> DataFrame:
    """(model, subject, trial, component, t, label, x): samples under every fold's filters, a table of folds x components x channels weights."""
    table = [(f, k, ch, float(w)) for f, of in filters.items() for k, weights in of.items() for ch, w in zip(names, weights, strict=True)]
    weights = samples.sparkSession.createDataFrame(table, "model int, component string, channel string, w double")
    return samples.join(F.broadcast(weights), "channel").groupBy("model", "subject", "trial", "component", "t", "label").agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def codebooks(rows: DataFrame, k: int, codes: int, rounds: int = 20) -> np.ndarray:
    """(fold, codes, features): a k-means codebook of each fold's training rows by steps over all folds at once.

    First codes are the farthest-first choice among ``SEEDS`` training rows taken by a hash of the features; a code
    without rows stays. Ends when no code moves, or after ``rounds`` steps.
    """
    order = rows.select("fold", "features", F.xxhash64("features").alias("h")).distinct()
    seeds = []
    for f in range(k):
        some = np.array([r.features for r in order.where(F.col("fold") != f).orderBy("h").limit(SEEDS).collect()])
        chosen, far = [0], np.full(len(some), np.inf)
        while len(chosen) < codes:
            far = np.minimum(far, ((some - some[chosen[-1]]) ** 2).sum(1))
            chosen.append(int(far.argmax()))
        seeds.append(some[chosen])
    book = np.stack(seeds)
    for _ in range(rounds):
        now = book

        def sums(p: Batch, now: np.ndarray = now) -> dict[int, np.ndarray]:
            out = {}
            for f in range(k):
                x = p["x"][p["fold"] != f]
                own = nearest(x, now[f])
                total = np.zeros((codes, x.shape[1] + 1))
                np.add.at(total, own, np.column_stack([x, np.ones(len(x))]))
                out[f] = total
            return out

        total = summed(rows, ["fold"], sums)
        book = np.stack([np.where(total[f][:, -1:] > 0, total[f][:, :-1] / np.maximum(total[f][:, -1:], 1), now[f]) for f in range(k)])
        if np.abs(book - now).max() <= 1e-9 * (1 + np.abs(now).max()):
            break
    return book


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest code of every row, the first of equals."""
    return ((book**2).sum(1) - 2 * x @ book.T).argmin(1) if len(x) else np.zeros(0, np.int64)


class Logistic:
    """Weights (model, features + 1, classes) of one multinomial logistic model for each fold."""

    def __init__(self, weights: np.ndarray, labels: list):
        self.weights, self.labels = weights, labels

    def probabilities(self, model: int, x: np.ndarray) -> np.ndarray:
        s = x @ self.weights[model][:-1] + self.weights[model][-1]
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def logistic(rows: DataFrame, k: int, c: float = 1.0, steps: int = 500, tolerance: float = 1e-5) -> Logistic:
    """A model for each fold on its training rows (fold, label, features), scaled there, with balanced class weights and an L2 term 1 / (c n).

    All folds advance together: a step is one job that gives every fold the loss and gradient of its trial point,
    and the driver moves each by L-BFGS with backtracking. Rows of a row's own fold have weight zero.
    ``steps`` bounds the jobs; folds whose gradient is below ``tolerance`` rest.
    """
    labels = sorted(r.label for r in rows.select("label").distinct().collect())
    place = {label: i for i, label in enumerate(labels)}
    mean, spread = scales(rows, k)
    d, classes = mean.shape[1], len(labels)
    number = lambda y: np.array([place[v] for v in y.tolist()])
    counted = _outside(rows, ["label"], k, lambda x, p: np.bincount(number(p["label"]), minlength=classes)[None].astype(float))
    made = ["model"] if "model" in rows.columns else []
    counts = np.stack([counted[f][0] for f in range(k)])
    total = counts.sum(1)
    weight = np.where(counts > 0, total[:, None] / (np.maximum((counts > 0).sum(1), 1)[:, None] * np.maximum(counts, 1)), 0.0)
    penalty = 1.0 / (c * np.maximum(total, 1))

    def raw(w: np.ndarray) -> np.ndarray:
        """Weights on unscaled features."""
        inner = w[:, :-1] / spread[:, :, None]
        return np.concatenate([inner, w[:, -1:] - np.einsum("fd,fdc->fc", mean, inner)[:, None]], axis=1)

    def measured(w: np.ndarray, live: list[int]) -> tuple[np.ndarray, np.ndarray]:
        weights = raw(w)

        def parts(p: Batch) -> dict[int, np.ndarray]:
            y, out = number(p["label"]), {}
            for f in live:
                own = (p["fold"] != f) & (p["model"] == f) if made else p["fold"] != f
                if not own.any():
                    continue
                x, yy = p["x"][own], y[own]
                s = x @ weights[f][:-1] + weights[f][-1]
                s -= s.max(1, keepdims=True)
                log = np.log(np.exp(s).sum(1))
                each = weight[f][yy]
                r = np.exp(s - log[:, None]) * each[:, None]
                loss = (each * (log - s[np.arange(len(yy)), yy])).sum()
                r[np.arange(len(yy)), yy] -= each
                out[f] = np.vstack([x.T @ r, r.sum(0), np.full(classes, loss)])
            return out

        sums = summed(rows, ["fold", "label", *made], parts)
        loss, grad = np.full(k, np.inf), np.zeros_like(w)
        for f in live:
            g = sums[f] / total[f]
            inner = (g[:d] - np.outer(mean[f], g[d])) / spread[f][:, None]
            grad[f] = np.vstack([inner + penalty[f] * w[f, :-1], g[d : d + 1]])
            loss[f] = g[d + 1, 0] + penalty[f] / 2 * (w[f, :-1] ** 2).sum()
        return loss, grad

    w = np.zeros((k, d + 1, classes))
    loss, grad = measured(w, list(range(k)))
    past: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(k)]
    step, live = np.ones(k), list(range(k))
    way = {f: -grad[f] / max(1.0, np.abs(grad[f]).max()) for f in live}
    for _ in range(steps):
        live = [f for f in live if np.abs(grad[f]).max() > tolerance and step[f] > 1e-8]
        if not live:
            break
        trial = w.copy()
        for f in live:
            trial[f] += step[f] * way[f]
        new_loss, new_grad = measured(trial, live)
        for f in live:
            if new_loss[f] > loss[f] + 1e-4 * step[f] * (grad[f] * way[f]).sum():
                step[f] /= 4
                continue
            s, y = trial[f] - w[f], new_grad[f] - grad[f]
            if (s * y).sum() > 1e-12:
                past[f] = [*past[f][-9:], (s, y)]
            w[f], loss[f], grad[f], step[f] = trial[f], new_loss[f], new_grad[f], 1.0
            q, held = new_grad[f].copy(), []
            for s, y in reversed(past[f]):
                a = (s * q).sum() / (s * y).sum()
                q -= a * y
                held.append(a)
            if past[f]:
                s, y = past[f][-1]
                q *= (s * y).sum() / (y * y).sum()
            for (s, y), a in zip(past[f], reversed(held), strict=True):
                q += s * (a - (y * q).sum() / (s * y).sum())
            way[f] = -q
    return Logistic(raw(w), labels)


def held_out(rows: DataFrame, model: Logistic, k: int) -> DataFrame:
    """(.., fold, y, p, probability): every row by the model of its own fold, which never saw it."""
    rows = rows.where("fold = model").drop("model") if "model" in rows.columns else rows
    out = transformed(rows, model.probabilities, k, training=False).withColumnRenamed("features", "probability").drop("model")
    best = F.array_position("probability", F.array_max("probability")).cast("int")
    return out.withColumn("p", F.array(*map(F.lit, model.labels))[best - 1]).withColumnRenamed("label", "y")


def scores(predictions: DataFrame, labels: list) -> DataFrame:
    """(fold, hit, class, score): one row a class, as the area under the curve of one class against the rest needs them."""
    each = F.array(*(F.struct(F.lit(c).alias("class"), F.col("probability")[i].alias("score"), (F.col("y") == F.lit(c)).alias("hit")) for i, c in enumerate(labels)))
    return predictions.select("fold", F.inline(each))


def measures(predictions: DataFrame, labels: list) -> DataFrame:
    """(fold, accuracy, balanced_accuracy, macro_f1, kappa, auc): ``auc`` is the mean over the classes that a fold has rows of and rows without."""
    from siglex.operators import stats

    areas = stats.auc_by_counts(scores(predictions, labels), ["fold", "class"]).where("auc is not null").groupBy("fold").agg(F.avg("auc").alias("auc"))
    return stats.classification(predictions, ["fold"]).join(areas, "fold", "left")


def spatial_rows(samples: DataFrame, folds: DataFrame, k: int, n: int) -> DataFrame:
    """(subject, trial, label, fold, model, features): log variances of each fold's components, for every fold's fit."""
    filters, names = spatial_filters(samples, folds, k, n)
    v = filtered(samples, filters, names).groupBy("model", "subject", "trial", "label", "component").agg(F.log(F.var_pop("x") + 1e-12).alias("v"))
    rows = v.groupBy("model", "subject", "trial", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "v"))), lambda s: s["v"]).alias("features"))
    return rows.join(folds.select("subject", F.col("fold").cast("int").alias("fold")), "subject")


def series(steps: DataFrame, names: list[str]) -> DataFrame:
    """(subject, trial, label, t, x): a row a trial; ``x`` holds the channels of every time step one after another, 0 where a step lacks one.

    ``steps`` are long samples, or time steps with a column for each of the channels ``names``.
    """
    key, c, long = ["subject", "trial", "label"], len(names), "channel" in steps.columns
    value = F.struct("t", F.array_position(F.array(*map(F.lit, names)), F.col("channel")).alias("c"), F.col("x").cast("double").alias("x")) if long else F.struct("t", *(F.col(n).cast("double").alias(n) for n in names))
    rows = steps.groupBy(*key).agg(F.collect_list(value).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            offsets = np.asarray(column.offsets).astype(np.int64)
            inner = column.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            t = inner.field("t").to_numpy(zero_copy_only=False).astype(np.int64)
            at = (row << 32) | t
            if long:
                at, place = np.unique(at, return_inverse=True)
                x = np.zeros((len(at), c))
                x[place, inner.field("c").to_numpy(zero_copy_only=False) - 1] = inner.field("x").to_numpy(zero_copy_only=False)
            else:
                order = np.argsort(at)
                at, x = at[order], np.stack([inner.field(n).to_numpy(zero_copy_only=False)[order] for n in names], 1)
            ends = np.concatenate([[0], np.cumsum(np.bincount(at >> 32, minlength=batch.num_rows))])
            lists = [pa.ListArray.from_arrays(pa.array((ends * m).astype(np.int32)), pa.array(v)) for m, v in ((1, (at & 0xFFFFFFFF).astype(np.int32)), (c, np.where(np.isnan(x), 0.0, x).ravel()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *lists], [*key, "t", "x"])

    return rows.mapInArrow(run, StructType([*(rows.schema[n] for n in key), *StructType.fromDDL("t array<int>, x array<double>")]))


def _steps(batch: pa.RecordBatch, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(time steps x channels, first steps, numbers of steps) of a batch of ``series``."""
    column = batch.column(4)
    size = column.value_lengths().to_numpy() // c
    return np.asarray(column.flatten(), float).reshape(-1, c), np.cumsum(size) - size, size


def moments(held: DataFrame, c: int) -> DataFrame:
    """(subject, trial, label, features): products of the channels of ``series`` summed over time, sums of channels, number of steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, first, size = _steps(batch, c)
            out = np.empty((batch.num_rows, c * c + c + 1))
            for i, (a, n) in enumerate(zip(first.tolist(), size.tolist(), strict=True)):
                own = x[a : a + n]
                out[i, : c * c], out[i, c * c : -1], out[i, -1] = (own.T @ own).ravel(), own.sum(0), n
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), lists], [*batch.schema.names[:3], "features"])

    return held.mapInArrow(run, StructType([*(held.schema[n] for n in ("subject", "trial", "label")), *StructType.fromDDL("features array<double>")]))


def patterns(summed_trials: DataFrame, c: int, k: int, n: int) -> dict[int, dict[str, np.ndarray]]:
    """``spatial_filters`` from rows of ``moments`` with their folds."""
    labels = sorted(r.label for r in summed_trials.select("label").distinct().collect())
    rows = summed_trials.withColumn("key", (F.col("fold") * len(labels) + F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1).cast("int"))
    found = summed(rows, ["key"], lambda p: {int(key): p["x"][p["key"] == key].sum(0, keepdims=True) for key in np.unique(p["key"])})
    return _patterns({key: np.vstack([m[0, : c * c].reshape(c, c), m[0, c * c : -1], np.full(c, m[0, -1])]) for key, m in found.items()}, labels, c, k, n)


def log_variances(summed_trials: DataFrame, filters: dict[int, dict[str, np.ndarray]], c: int, k: int) -> DataFrame:
    """``spatial_rows`` from rows of ``moments`` with their folds: a component's variance follows from the trial's products."""
    weights = {f: np.stack([w for _, w in sorted(of.items())], 1) for f, of in filters.items()}

    def function(f: int, x: np.ndarray) -> np.ndarray:
        mean = x[:, c * c : -1] / x[:, -1:]
        cov = x[:, : c * c].reshape(-1, c, c) / x[:, -1, None, None] - mean[:, :, None] * mean[:, None]
        return np.log(np.maximum(np.einsum("ck,ncd,dk->nk", weights[f], cov, weights[f], optimize=True), 0) + 1e-12)

    return transformed(summed_trials, function, k)


def component_values(held: DataFrame, filters: dict[int, dict[str, np.ndarray]], c: int, column: str, kind: str, function: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(subject, trial, label, t, channel, ``column``, model): arrays of ``function(components by time, first steps, numbers of steps)`` under every fold's filters; nothing is shuffled."""
    dtype = np.int32 if kind == "int" else float

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, first, size = _steps(batch, c)
            offsets = pa.array(np.append(first, len(x)).astype(np.int32))
            for f, of in filters.items():
                y = function(x @ np.stack(list(of.values()), 1), first, size)
                for j, name in enumerate(of):
                    lists = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(y[:, j], dtype)))
                    yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array([name] * batch.num_rows), lists, pa.array(np.full(batch.num_rows, f, np.int32))], [*batch.schema.names[:4], "channel", column, "model"])

    return held.mapInArrow(run, StructType([*held.schema.fields[:4], *StructType.fromDDL(f"channel string, {column} array<{kind}>, model int")]))


def uniform_codes(y: np.ndarray, first: np.ndarray, size: np.ndarray, bins: int) -> np.ndarray:
    """Codes of ``signals.zscore`` and uniform bins for each column of consecutive rows of steps."""
    n = size[:, None]
    y = y - np.repeat(np.add.reduceat(y, first, axis=0) / n, size, 0)
    y /= np.repeat(np.maximum(np.sqrt(np.add.reduceat(y * y, first, axis=0) / n), scalar.EPS), size, 0)
    code = np.floor((np.clip(np.round(y, 9), -4, 4) + 4) / (8 + scalar.STEP) * bins)
    return np.clip(code, 0, bins - 1).astype(np.int32)


def codes_of(rows: DataFrame, book: np.ndarray, model: int) -> DataFrame:
    """Rows with the ``code`` of one fold's codebook."""
    own = transformed(rows.withColumn("fold", F.lit(0)), lambda _, x: nearest(x, book[model])[:, None].astype(float), 1)
    return own.select(*[c for c in rows.columns if c not in ("features", "fold")], "model", F.col("features")[0].cast("int").alias("code")).drop("model")


def zscored(samples: DataFrame) -> DataFrame:
    """``x`` normalised within its row; nothing of another row enters."""
    return signals.zscore(samples).withColumn("x", F.col("z")).drop("z")
