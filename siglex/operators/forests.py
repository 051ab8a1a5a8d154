"""Random forests of every fold, out-of-fold votes without a forest or a table that is whole on the driver.

Features are cut to bins by the training rows of a fold. Nodes with more rows than a task
holds are split by histograms that one job a level sums for all trees and folds; a task then takes the rows of
a node and finishes its subtree alone. It lets the held-out rows there vote at once, so
that only sums of votes travel. While the table fits a task, a task grows several whole trees of
one fold from one copy of the rows.

Bootstrap weights follow a hash of the row and features a generator a node, so neither
the dealing of rows nor their order changes a tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglex.operators import folds
from siglex.sources.shared import written

BINS = 32
HELD = 1 << 26  # bins (rows x features) that a task holds to finish a subtree
DENSE = 48  # rows of a node from which a histogram is cheaper than a sort
CHUNK = 1 << 16  # rows of small nodes that are sorted at once
CELLS = 1 << 24  # numbers of the histograms that a job sums
#: Distribution of a Poisson(1) variable, up to 2^-64.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(20)])


def weights(h: np.ndarray, seed: int, fold: int, tree: int) -> np.ndarray:
    """How often the bootstrap of a tree takes each row, by the hashes of the rows."""
    x = h.view(np.uint64) ^ np.random.default_rng([seed, fold, tree]).integers(0, 1 << 63, dtype=np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(_POISSON, (x ^ (x >> np.uint64(31))) / 2.0**64, "right").astype(np.float32)


def cuts(rows: DataFrame, k: int) -> list[list[np.ndarray]]:
    """For each fold and feature, the values at which its training rows are cut: all but the last of up to 32 values, else quantiles of all rows."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for p in folds._read(batch):
                for f in np.unique(p["fold"]).tolist():
                    for j, x in enumerate(p["x"][p["fold"] == f].T):
                        known = found.get((f, j), x[:0])
                        found[f, j] = known if len(known) > BINS else np.unique(np.concatenate([known, x]))[: BINS + 1]
        out = [(f, j, v) for (f, j), own in found.items() for v in own.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], ["fold", "feature", "v"])

    few: dict[tuple[int, int], list[float]] = {}
    for r in rows.select("fold", "features").mapInArrow(values, "fold int, feature int, v double").groupBy("fold", "feature").agg(F.slice(F.array_sort(F.collect_set("v")), 1, BINS + 1).alias("v")).collect():
        few[r.fold, r.feature] = r.v
    shares = F.array(*(F.lit(b / BINS) for b in range(1, BINS)))
    each = rows.select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("model"), "fold", "features").where("fold <> model")
    found = {(r.model, r.feature): r.q for r in each.select("model", F.posexplode("features").alias("feature", "v")).groupBy("model", "feature").agg(F.percentile_approx("v", shares, 10000).alias("q")).collect()}
    out = []
    for f in range(k):
        own = []
        for j in range(1 + max(j for _, j in few)):
            v = sorted({x for g in range(k) if g != f for x in few.get((g, j), [])})
            own.append(np.unique(v[:-1] if len(v) <= BINS else found[f, j]))
        out.append(own)
    return out


def binned(x: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    """Bins of a matrix; bin b holds what is above cut b - 1 and not above cut b."""
    return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(at)], 1).astype(np.uint8)


class Tree:
    """Nodes as arrays: a feature (-1: none), the last bin that goes left, the left child (the right one follows), class shares."""

    def __init__(self, classes: int):
        self.feature, self.cut, self.child, self.depth = (np.full(1, v, np.int32) for v in (-1, 0, 0, 0))
        self.share = np.zeros((1, classes), np.float32)

    def split(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Give nodes children; returns the left ones."""
        left = len(self.feature) + 2 * np.arange(len(nodes), dtype=np.int32)
        self.feature[nodes], self.cut[nodes], self.child[nodes] = feature, cut, left
        more = 2 * len(nodes)
        self.feature, self.cut, self.child = (np.concatenate([a, np.full(more, v, np.int32)]) for a, v in ((self.feature, -1), (self.cut, 0), (self.child, 0)))
        self.depth = np.concatenate([self.depth, np.repeat(self.depth[nodes] + 1, 2)])
        self.share = np.concatenate([self.share, np.zeros((more, self.share.shape[1]), np.float32)])
        return left

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        at, row = np.zeros(len(bins), np.int32), np.arange(len(bins))
        while len(row):
            row = row[self.feature[at[row]] >= 0]
            now = at[row]
            at[row] = self.child[now] + (bins[row, self.feature[now]] > self.cut[now])
        return at


def _score(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Sum over both sides of squared class counts by count: the more, the purer; -1 where a side is empty."""
    right = total - left
    a, b = left.sum(-1), right.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.einsum("...c,...c->...", left, left) / a + np.einsum("...c,...c->...", right, right) / b
    return np.where((a > 0) & (b > 0), s, -1.0)


def best_cuts(x: np.ndarray, node: np.ndarray, y: np.ndarray, w: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, bin) of the best cut of one feature ``x`` (of each node its own) for every node; rows in order of their nodes."""
    n, classes = total.shape
    score, cut = np.full(n, -1.0), np.zeros(n, np.int32)
    size = np.bincount(node, minlength=n)
    for large in (True, False):
        some = np.flatnonzero((size >= DENSE) == large)
        number = np.full(n, -1)
        number[some] = np.arange(len(some))
        at = np.flatnonzero(number[node] >= 0)
        if not len(at):
            continue
        if large:
            table = np.bincount((number[node[at]] * BINS + x[at]) * classes + y[at], w[at], len(some) * BINS * classes).reshape(-1, BINS, classes)
            s = _score(table.cumsum(1)[:, :-1], total[some][:, None])
            cut[some] = s.argmax(1)
            score[some] = s[np.arange(len(some)), cut[some]]
            continue
        ends = np.cumsum(size[some])
        for a, b in zip(*(lambda e: (np.concatenate([[0], e[:-1]]), e))(ends[np.unique(np.searchsorted(ends, np.arange(CHUNK, len(at) + CHUNK, CHUNK), "left").clip(max=len(ends) - 1))]), strict=True):
            own = at[a:b]
            key = number[node[own]] * BINS + x[own]
            order = np.argsort(key, kind="stable")
            own, key = own[order], key[order]
            inside = number[node[own]]
            one = np.zeros((len(own), classes))
            one[np.arange(len(own)), y[own]] = w[own]
            one = one.cumsum(0)
            first = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1]]))
            before = np.concatenate([np.zeros((1, classes)), one])[first]
            left = one - np.repeat(before, np.diff(np.append(first, len(own))), 0)
            s = _score(left, total[some[inside]])
            s[:-1][key[1:] == key[:-1]] = -1.0
            top = np.maximum.reduceat(s, first)
            best = np.flatnonzero(s == np.repeat(top, np.diff(np.append(first, len(own)))))
            best = best[np.unique(inside[best], return_index=True)[1]]
            score[some[inside[best]]], cut[some[inside[best]]] = s[best], key[best] % BINS
    return score, cut


def chosen(rng: np.random.Generator, nodes: int, d: int) -> np.ndarray:
    """The square root of ``d`` features for each node."""
    m = math.ceil(math.sqrt(d))
    return rng.random((nodes, d), np.float32).argpartition(min(m, d - 1), 1)[:, :m]


def grown(bins: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, depth: int, rng: np.random.Generator) -> Tree:
    """A tree on rows with weights, by Gini gain among a random choice of features, down to pure nodes or ``depth``."""
    tree = Tree(classes)
    row = np.flatnonzero(w > 0)
    nodes, node = np.zeros(1, np.int32), np.zeros(len(row), np.int64)
    while len(row):
        total = np.bincount(node * classes + y[row], w[row], len(nodes) * classes).reshape(-1, classes)
        count = total.sum(1)
        tree.share[nodes] = total / count[:, None]
        if not depth:
            break
        depth -= 1
        features = chosen(rng, len(nodes), bins.shape[1])
        base = np.einsum("nc,nc->n", total, total) / count
        open_ = (total > 0).sum(1) > 1
        number = np.cumsum(open_) - 1
        keep = open_[node]
        row, node = row[keep], number[node[keep]]
        nodes, features, total, base = nodes[open_], features[open_], total[open_], base[open_]
        if not len(row):
            break
        best, which, cut = base + 1e-9 * (1 + base), np.full(len(nodes), -1), np.zeros(len(nodes), np.int32)
        yy, ww = y[row], w[row]
        for s in range(features.shape[1]):
            score, at = best_cuts(bins[row, features[node, s]].astype(np.int64), node, yy, ww, total)
            better = score > best
            best, which, cut = np.where(better, score, best), np.where(better, s, which), np.where(better, at, cut)
        found = which >= 0
        feature = features[np.arange(len(nodes)), np.maximum(which, 0)]
        left = tree.split(nodes[found], feature[found], cut[found])
        keep = found[node]
        row, node = row[keep], node[keep]
        child = 2 * (np.cumsum(found) - 1)[node] + (bins[row, feature[node]] > cut[node])
        order = np.argsort(child.astype(np.uint16) if 2 * len(left) <= 1 << 16 else child, kind="stable")
        row, node, nodes = row[order], child[order], np.repeat(left, 2) + np.tile(np.arange(2, dtype=np.int32), len(left))
    return tree


def tops(rows: DataFrame, k: int, trees: int, depth: int, labels: list, at: list[list[np.ndarray]], seed: int, most: int) -> dict[tuple[int, int], Tree]:
    """The upper part of every (fold, tree): nodes are split by summed histograms while they have more than ``most`` rows."""
    classes, d = len(labels), len(at[0])
    out = {(f, t): Tree(classes) for f in range(k) for t in range(trees)}
    large = [(f, t, 0) for f, t in out]
    while large:
        step = max(1, CELLS // (BINS * classes * math.ceil(math.sqrt(d))))
        after = []
        for start in range(0, len(large), step):
            part = large[start : start + step]
            features = np.concatenate([chosen(np.random.default_rng([seed, 1, *key]), 1, d) for key in part])

            def tables(p: folds.Batch, part: list = part, features: np.ndarray = features) -> dict[int, np.ndarray]:
                y, found = np.searchsorted(labels, p["label"]), {}
                of_fold = {f: binned(p["x"], at[f]) for f in {f for f, _, _ in part}}
                for i, (f, t, node) in enumerate(part):
                    w = weights(p["h"], seed, f, t) * (p["fold"] != f)
                    own = np.flatnonzero((w > 0) & (out[f, t].place(of_fold[f]) == node))
                    x = of_fold[f][own][:, features[i]].astype(np.int64) + BINS * np.arange(features.shape[1])
                    table = np.bincount((x * classes + y[own, None]).ravel(), np.repeat(w[own], features.shape[1]), features.shape[1] * BINS * classes)
                    found[i] = np.vstack([table.reshape(-1, classes), np.full(classes, len(own))])
                return found

            sums = folds.summed(rows, ["fold", "label", "h"], tables)
            for i, (f, t, node) in enumerate(part):
                tree, size = out[f, t], sums[i][-1, 0]
                table = sums[i][:-1].reshape(-1, BINS, classes)
                total = table[0].sum(0)
                if size > 0:
                    tree.share[node] = total / total.sum()
                if size <= most or tree.depth[node] >= depth or (total > 0).sum() < 2:
                    continue
                s = _score(table.cumsum(1)[:, :-1], total)
                slot, cut = divmod(int(s.argmax()), BINS - 1)
                base = (total**2).sum() / total.sum()
                if s.max() > base + 1e-9 * (1 + base):
                    left = int(tree.split(np.array([node]), features[i][[slot]], np.array([cut]))[0])
                    after += [(f, t, left), (f, t, left + 1)]
        large = after
    return out


def cross_validated(rows: DataFrame, of: DataFrame, k: int, trees: int = 200, depth: int = 20, seed: int = 42, held: int = HELD) -> DataFrame:
    """Predictions (fold, y, p) of every row (subject, label, features) by the forest of the folds it is not in.

    A forest has ``trees`` trees of at most ``depth`` levels on Poisson bootstraps, the square root of the features at
    each node, 32 bins a feature, no least gain or node; a row's votes are the class shares of its
    leaves. Scaling would change no tree. A table of up to ``held`` bins goes to a task for some trees; nodes of a
    larger one are split together until one fits, which sends a row once for every tree.
    """
    spark = rows.sparkSession
    marked = folds.placed(rows, of)
    marked = written(marked.select("label", "fold", "features", F.xxhash64(*(c for c in marked.columns)).alias("h"), F.monotonically_increasing_id().alias("id")), "forest-rows")
    sizes = {r.fold: r.n for r in marked.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    if not n or any(sizes.get(f) == n for f in range(k)):
        raise ValueError("a fold has no rows to train on")
    labels = sorted(r.label for r in marked.select("label").distinct().collect())
    at, classes = cuts(marked, k), len(labels)
    d = len(at[0])
    most = max(1, held // d)
    top = tops(marked, k, trees, depth, labels, at, seed, most) if n > most else None
    parallel = spark.sparkContext.defaultParallelism
    groups = min(trees, max(1, math.ceil(4 * parallel / k)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows for each unit of work: (model, tree, node) and what it needs; without tops, a group of trees from the root."""
        for batch in batches:
            for p in folds._read(batch):
                y = np.searchsorted(labels, p["label"]).astype(np.int32)
                for f in range(k):
                    bins = binned(p["x"], at[f])
                    for t in range(trees if top else groups):
                        own, node = np.arange(len(y)), np.zeros(len(y), np.int32)
                        if top:
                            own = np.flatnonzero((p["fold"] == f) | (weights(p["h"], seed, f, t) > 0))
                            node = top[f, t].place(bins[own])
                        flat = pa.py_buffer(np.ascontiguousarray(bins[own]))
                        packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(d), len(own), [None, flat]).cast(pa.binary())
                        marks = [pa.array(np.full(len(own), v, np.int32)) for v in (f, t)]
                        yield pa.RecordBatch.from_arrays([*marks, pa.array(node), pa.array(p["id"][own]), pa.array(p["h"][own]), pa.array((p["fold"][own] == f)), pa.array(y[own]), packed], ["model", "tree", "node", "id", "h", "out", "y", "bins"])

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, parts = None, []
        for batch in batches:  # sorted by unit
            key = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if unit is not None and tuple(key[a]) != unit:
                    yield votes(unit, parts)
                    parts = []
                unit = tuple(key[a].tolist())
                parts.append(batch.slice(a, b - a))
        if parts:
            yield votes(unit, parts)

    def votes(unit: tuple[int, int, int], parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        f, first, node = unit
        ids, h, y = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in (3, 4, 6))
        out = np.concatenate([p.column(5).to_numpy(zero_copy_only=False) for p in parts])
        bins = np.frombuffer(b"".join(b for p in parts for b in p.column(7).to_pylist()), np.uint8).reshape(-1, d)
        train, test = np.flatnonzero(~out), np.flatnonzero(out)
        own, seen, y = bins[train], bins[test], y[train]
        total = np.zeros((len(test), classes))
        for t in [first] if top else range(first, trees, groups):
            left = depth - int(top[f, t].depth[node]) if top else depth
            tree = grown(own, y, weights(h[train], seed, f, t), classes, left, np.random.default_rng([seed, 2, f, t, node]))
            total += tree.share[tree.place(seen)]
        return pa.RecordBatch.from_arrays([pa.array(ids[test]), *(pa.array(np.ascontiguousarray(c)) for c in total.T)], ["id", *names])

    names = [f"v{c}" for c in range(classes)]
    units = marked.select("label", "fold", "h", "id", "features").mapInArrow(dealt, "model int, tree int, node int, id long, h long, out boolean, y int, bins binary")
    units = units.repartition(k * groups, "model", "tree", "node").sortWithinPartitions("model", "tree", "node")
    summed = units.mapInArrow(voted, "id long, " + ", ".join(f"{c} double" for c in names)).groupBy("id").agg(*(F.sum(c).alias(c) for c in names))
    best = F.array_position(F.array(*names), F.greatest(*names) if classes > 1 else F.col(names[0])).cast("int")
    own = marked.select("id", "fold", F.col("label").cast("int").alias("y")).join(summed, "id")
    return written(own.select("fold", "y", F.array(*map(F.lit, labels))[best - 1].cast("int").alias("p")), "forest-votes")
