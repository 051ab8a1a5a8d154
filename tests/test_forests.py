"""Forests of every fold: cuts against brute force, whole predictions, nothing of a held-out row, large tables by summed histograms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siglex.operators import forests
from siglex.operators import pipelines as P


def table(spark, seed, n=240, change=None):
    """Three classes in two of five features; a change turns the features of one subject round."""
    r = np.random.default_rng(seed)
    x, y = r.normal(size=(n, 5)), r.integers(0, 3, n)
    x[:, 1] += 4 * (y == 1)
    x[:, 3] += 4 * (y == 2)
    rows = [(int(i % 6), int(i), int(2 * y[i] + 1), [float(v) for v in (-x[i] if i % 6 == change else x[i])]) for i in range(n)]
    of = spark.createDataFrame([(s, s % 3) for s in range(6)], "subject int, fold int")
    return spark.createDataFrame(rows, "subject int, trial long, label int, features array<double>").repartition(3), of


def brute(x, y, w, classes):
    best = (-1.0, 0)
    for cut in range(forests.BINS - 1):
        sides = [np.bincount(y[own], w[own], classes) for own in (x <= cut, x > cut)]
        if min(s.sum() for s in sides) > 0:
            best = max(best, (sum((s**2).sum() / s.sum() for s in sides), -cut))
    return best[0], -best[1]


@pytest.mark.parametrize("rows", [300, 3000])
def test_cuts_agree_with_brute_force(rows, monkeypatch):
    monkeypatch.setattr(forests, "CHUNK", 64)
    r = np.random.default_rng(rows)
    node = np.sort(r.choice(40, rows, p=r.dirichlet(np.full(40, 0.5))))
    _, node = np.unique(node, return_inverse=True)
    x, y, w = r.integers(0, 32, rows) // r.integers(1, 9, rows), r.integers(0, 4, rows), r.integers(1, 4, rows).astype(np.float32)
    total = np.bincount(node * 4 + y, w, (node.max() + 1) * 4).reshape(-1, 4)
    score, cut = forests.best_cuts(x, node, y, w, total)
    for n in range(node.max() + 1):
        own = node == n
        expected, at = brute(x[own], y[own], w[own], 4)
        assert score[n] == pytest.approx(expected)
        if expected > 0:
            left = (x[own] <= cut[n]).sum()
            assert left == (x[own] <= at).sum() or brute_score(x[own], y[own], w[own], cut[n]) == pytest.approx(expected)


def brute_score(x, y, w, cut):
    return sum((s**2).sum() / s.sum() for s in (np.bincount(y[own], w[own], 4) for own in (x <= cut, x > cut)))


def test_a_tree_takes_its_training_rows_apart():
    r = np.random.default_rng(5)
    bins, y = r.integers(0, 32, (500, 9)).astype(np.uint8), r.integers(0, 3, 500)
    w = forests.weights(r.integers(-(2**62), 2**62, 500), 1, 0, 0)
    assert abs(w.mean() - 1) < 0.2 and abs((w == 0).mean() - np.exp(-1)) < 0.1
    tree = forests.grown(bins, y, w, 3, 40, np.random.default_rng(1))
    assert (tree.share[tree.place(bins)].argmax(1) == y)[w > 0].all()
    assert forests.grown(bins, y, w, 3, 2, np.random.default_rng(1)).depth.max() == 2


@pytest.mark.parametrize("held", [forests.HELD, 5 * 30])
def test_every_row_is_predicted_once_by_its_fold(spark, held):
    rows, of = table(spark, 1)
    got = forests.cross_validated(rows, of, 3, 30, 20, held=held).toPandas()
    assert got["fold"].value_counts().to_dict() == {0: 80, 1: 80, 2: 80} and set(got["y"]) == {1, 3, 5}
    assert (got["y"] == got["p"]).mean() > 0.9


def test_held_out_rows_do_not_enter_their_forest(spark):
    found = []
    for change in (None, 4):  # all rows of subject 4 have label 5; of its fold, the others are then those of subject 1
        rows, of = table(spark, 2, change=change)
        marked = rows.withColumn("label", F.when(F.col("subject") == 4, 5).otherwise(F.col("label")))
        got = forests.cross_validated(marked, of, 3, 10, 20).toPandas()
        found.append([got.query(q).value_counts(["y", "p"]).to_dict() for q in ("fold == 1 and y != 5", "fold == 1", "fold != 1")])
    assert found[0][0] == found[1][0] and sum(found[0][0].values()) > 20
    assert found[0][1] != found[1][1] and found[0][2] != found[1][2]


def test_repeated_rows_and_few_values(spark):
    rows, of = table(spark, 3, 60)
    flat = rows.withColumn("features", F.transform("features", lambda v: F.when(v > 2, 1.0).otherwise(0.0)))
    got = forests.cross_validated(flat.unionByName(flat), of, 3, 10, 20).toPandas()
    assert len(got) == 120 and (got["y"] == got["p"]).mean() > 0.7
    with pytest.raises(ValueError, match="train"):
        forests.cross_validated(rows, of.withColumn("fold", F.lit(0)), 1, 5, 20)


def test_validated_forests_keep_every_row(spark):
    rows, _ = table(spark, 4)
    got = P.validated(rows, "forest", 2, by=["fold"]).toPandas()
    assert sorted(got["fold"]) == [0, 1] and got["accuracy"].min() > 0.85
