"""Filters and resampling against direct sums, over block edges; what sines keep."""

import numpy as np
import pytest

from siglex.operators import filters, signals


def rows_of(spark, arrays):
    rows = [("s", k, "c", t, float(v), k % 2) for k, a in enumerate(arrays) for t, v in enumerate(a)]
    return spark.createDataFrame(rows, "subject string, trial long, channel string, t int, x double, label int").repartition(3)


def collected(df, n):
    out = {}
    for r in df.collect():
        out.setdefault(r.trial, {})[r.t] = r.x
        assert r.label == r.trial % 2
    return [np.array([out[k][t] for t in range(len(out[k]))]) for k in range(n)]


@pytest.mark.parametrize("block", [16, 50, 8192])
def test_convolution_and_polyphase_over_block_edges(spark, monkeypatch, block):
    monkeypatch.setattr(filters, "BLOCK", block)
    r = np.random.default_rng(block)
    arrays = [r.normal(size=n) for n in (500, 1, 16, 77)]
    kernel = r.normal(size=31)
    got = collected(filters.convolved(rows_of(spark, arrays), kernel), 4)
    for x, y in zip(arrays, got, strict=True):
        assert np.allclose(y, np.convolve(x, kernel)[15 : 15 + len(x)])
    for up, down in ((1, 2), (2, 3), (3, 1), (4, 5)):
        half = 10 * max(up, down)
        h = up * filters._kaiser_sinc(0.5 / max(up, down), half, 5.0)
        got = collected(filters.rational(rows_of(spark, arrays), up, down), 4)
        for x, y in zip(arrays, got, strict=True):
            zeros = np.zeros(len(x) * up)
            zeros[::up] = x
            want = np.convolve(zeros, h)[half : half + len(zeros)][::down]
            assert len(y) == -(-len(x) * up // down) and np.allclose(y, want)


def test_half_a_hertz_is_an_edge(spark):
    rate, n = 64.0, 64 * 60
    t = np.arange(n) / rate
    hz = (0.2, 1.0, 10.0, 16.0, 31.0)
    s = rows_of(spark, [np.sin(2 * np.pi * f * t) for f in hz])
    got = collected(signals.cleaned(s, rate, 0.5, 25.0, (16.0, 60.0)), len(hz))
    inner = [20 * np.log10(np.sqrt(2 * np.mean(y[1000:-1000] ** 2)) + 1e-12) for y in got]
    assert inner[0] < -40 and abs(inner[1]) < 0.1 and abs(inner[2]) < 0.1 and inner[3] < -40 and inner[4] < -40
    assert np.allclose(got[1][1000:-1000], np.sin(2 * np.pi * t)[1000:-1000], atol=0.01)  # no shift of phase
    half = collected(signals.cleaned(s, rate, 0.5, 25.0, (16.0,), to_rate=32.0), len(hz))
    assert len(half[0]) == n // 2 and np.allclose(half[1][500:-500], np.sin(2 * np.pi * t[::2])[500:-500], atol=0.02)
