"""Whitening against exact arithmetic; refinement on clustered eigenvalues."""

from fractions import Fraction

import numpy as np
import pytest

from siglex.llm import queries, whitening


def with_values(values, seed=0):
    r = np.random.default_rng(seed)
    q = np.linalg.qr(r.normal(size=(len(values),) * 2))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal to long double
        q = q @ (3 * np.eye(len(values), dtype=np.longdouble) - q.T @ q) / 2
    v = (q * np.array(values, np.longdouble)) @ q.T
    return (v + v.T) / 2, q


@pytest.mark.parametrize("values", [
    list(range(1, 21)), [5.0] * 6 + [1.0], [1 + 1e-9 * k for k in range(8)] + [3, 3 + 1e-12, 1e-6], [10.0 ** -k for k in range(12)], [1 + 1e-13, 1.0, 0.5], [0.0] * 4, [2.0], [1.0, 1.0, 0.0, 0.0],
])
def test_refinement(values):
    v, q = with_values(values)
    got, x = whitening.refined(v)
    scale = max(max(values), 1e-300)
    assert np.all(np.abs(got - np.sort(values)[::-1]) <= 1e-17 * len(values) * scale * 4)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-17
    assert np.abs(v @ x - x * got).max() <= 1e-17 * scale * len(values)
    for k, value in enumerate(values):
        alone = min((abs(value - other) for j, other in enumerate(values) if j != k), default=1)
        if alone > 1e-6 * scale:  # a vector of its own, to double precision
            assert 1 - abs(q[:, k] @ x[:, np.argmin(np.abs(got - value))]) < 1e-16
        elif alone > 1e-13 * scale:
            assert 1 - abs(q[:, k] @ x[:, np.argmin(np.abs(got - value))]) < 1e-7


def exact(vectors):
    """(n, sums, covariance as fractions) of distinct integer vectors."""
    xs = sorted({tuple(int(np.floor(64 * c)) + 1_000_000 for c in v) for v in vectors})
    n, d = len(xs), len(xs[0])
    sums = [sum(x[i] for x in xs) for i in range(d)]
    y = np.array([[n * x[i] - sums[i] for i in range(d)] for x in xs], object)
    return n, sums, y.T.dot(y), n**3


def compare(rows, vectors, components):
    """``vectors``: id to whole vector."""
    n, sums, top, bottom = exact(list(vectors.values()))
    d = len(sums)
    v = np.array([[float(Fraction(int(top[i, j]), bottom)) for j in range(d)] for i in range(d)])
    value, x = np.linalg.eigh(v)
    value, x = value[::-1], x[:, ::-1]
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(vectors) * components
    table = np.array([[got[i, k + 1].whitened for k in range(components)] for i in vectors])
    x0 = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in u] for u in vectors.values()], object)
    y = n * x0 - np.array(sums, object)
    want = (y.astype(float) / n) @ x[:, :components] / np.sqrt(value[:components])
    sign = np.sign((table * want).sum(axis=0))
    assert np.abs(table * sign - want).max() < 1e-8
    for at, i in enumerate(vectors):
        for k in range(components):
            r = got[i, k + 1]
            assert (r.n, r.deviation) == (n, int((y[at] ** 2).sum()))
            assert abs(r.explained * v.trace() / value[k] - 1) < 1e-9 and 0 <= r.identity_error < 1e-9


def test_against_exact(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(300, 20)) @ np.diag(np.linspace(0.2, 3, 20)) + 1000
    vectors = {k: base[k if k % 3 else 0].tolist() for k in range(300)}
    rows = [(k, v, 1) for k, v in vectors.items()] + [(1000, None, 1), (1001, [None] * 20, 1), (1002, [float("nan")] * 20, 1), (1003, [float("inf")] + [0.0] * 19, 1), (1004, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int").repartition(5)
    compare(whitening.whitened(df).collect(), vectors, 16)


def test_edges(spark):
    kinds = "vec_id string, embedding array<float>"
    w = lambda rows: sorted((tuple(x) for x in whitening.whitened(spark.createDataFrame(rows, kinds)).collect()), key=str)
    assert w([]) == [] and w([("a", None)]) == []
    assert w([("a", [1.0, 2.0]), (None, [1.0, 2.0])]) == sorted([(i, c, 1, 0, None, None, 0.0) for i in ("a", None) for c in (1, 2)], key=str)
    got = w([("a", [0.0, 1.0]), ("b", [1.0, 1.0]), ("a", [0.0, 1.0]), ("z", [7.0])])
    assert [(x[0], x[1], x[2], x[3]) for x in got] == [("a", 1, 2, 4096), ("a", 1, 2, 4096), ("a", 2, 2, 4096), ("a", 2, 2, 4096), ("b", 1, 2, 4096), ("b", 2, 2, 4096), ("z", 1, 1, 0)]
    assert [abs(x[4]) if x[4] is not None else None for x in got] == [1, 1, None, None, 1, None, None] and [x[5] for x in got[:4]] == [1, 1, 0, 0]
    large = w([("a", [3e38, 1.0]), ("b", [-3e38, 2.0]), ("c", [5.0, 3.0])])
    assert [(x[0], x[3]) for x in large] == [("a", None)] * 2 + [("b", None)] * 2 + [("c", 640**2 + 192**2)] * 2


def test_query(spark):
    rows = queries.queries()["op11_refined_whitening"](spark, "/root/testdata/sf0.001").collect()
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    compare(rows, {r.vec_id: [float(c) for c in r.embedding] for r in table}, 16)
