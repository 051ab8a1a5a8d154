"""Keyed permutations of row numbers, and the tests built on them, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siglex.operators import permutations as M
from siglex.operators import stats


@pytest.mark.parametrize("n", [1, 2, 3, 10, 17, 1000, 4097])
def test_places_are_a_permutation_of_any_size_and_differ_by_shuffle(n):
    seen = [M.places(np.arange(n), n, M.round_keys(3, k)) for k in range(8)]
    assert all(sorted(p) == list(range(n)) for p in seen)
    assert n < 10 or len({tuple(p) for p in seen}) == 8


def test_places_are_spread_evenly():
    n, shuffles = 20, 4000
    to = np.array([M.places(np.arange(n), n, M.round_keys(1, k)) for k in range(shuffles)])
    hits = np.array([np.bincount(to[:, i], minlength=n) for i in range(n)])
    assert ((hits - shuffles / n) ** 2 / (shuffles / n)).sum() < 2 * n * n  # chi-squared with (n - 1)^2 degrees
    pairs = np.bincount(to[:, 0] * n + to[:, 1], minlength=n * n).reshape(n, n)
    assert (np.diag(pairs) == 0).all() and pairs[~np.eye(n, dtype=bool)].min() > 0


@pytest.mark.parametrize("block", [5, 1 << 14])
def test_shuffled_products_equal_plain_ones(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "TOGETHER", 7)
    r = np.random.default_rng(2)
    n, x, y = 61, r.normal(size=61), r.normal(size=61)
    rows = spark.createDataFrame([(i, float(x[i]), float(y[i])) for i in r.permutation(n).tolist()], "i long, x double, y double").repartition(3)
    got = {row.shuffle: row.s for row in M.shuffled_products(rows, n, 20).collect()}
    assert sorted(got) == list(range(20))
    assert all(got[k] == pytest.approx((x * y[M.places(np.arange(n), n, M.round_keys(42, k))]).sum()) for k in got)


def test_p_of_linked_and_of_unlinked_columns(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=500)
    rows = spark.createDataFrame([(i, float(x[i]), float(x[i] + 2 * e), float(u)) for i, (e, u) in enumerate(r.normal(size=(500, 2)))], "id long, x double, linked double, free double").repartition(4)
    linked, free = (M.permutation_test(rows, "x", c, "id", 200).first() for c in ("linked", "free"))
    assert linked.p == pytest.approx(1 / 201) and free.p > 0.05
    assert linked.observed == pytest.approx(rows.select(F.corr("x", "linked")).first()[0])


def test_p_is_uniform_without_a_link(spark):
    r = np.random.default_rng(9)
    ps = []
    for seed in range(12):
        rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(r.normal(size=(40, 2)))], "id long, x double, y double").coalesce(1)
        ps.append(M.permutation_test(rows, "x", "y", "id", 99, seed).first().p)
    assert 0.2 < np.mean(ps) < 0.8 and min(ps) < 0.5 < max(ps)


def test_ranks_and_edges(spark):
    rows = spark.createDataFrame([(1, 5.0, 1.0), (1, 5.0, 2.0), (2, None, 3.0), (3, 9.0, None), (4, 7.0, 2.0), (5, 1e9, 8.0)], "id long, x double, y double")
    got = {(q.id, q.y): q.rank for q in stats.ranked(rows, "x", "rank").collect()}
    assert got == {(1, 1.0): 1.5, (1, 2.0): 1.5, (2, 3.0): None, (3, None): 4.0, (4, 2.0): 3.0, (5, 8.0): 5.0}
    observed = M.rank_permutation_test(rows, "x", "y", "id", 50).first().observed
    assert observed == pytest.approx(np.corrcoef([1.5, 1.5, 3, 4], [1, 2.5, 2.5, 4])[0, 1])
    assert M.permutation_test(rows.where("id = 1"), "x", "y", "id", 5).first() == (None, 1.0)  # one column does not vary
    assert M.permutation_test(rows.limit(0), "x", "y", "id", 5).first() == (None, 1.0)
    with pytest.raises(ValueError):
        M.permutation_test(rows, "x", "y", "id", 0)
