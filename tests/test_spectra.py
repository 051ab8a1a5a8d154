"""Batched spectra and rank selection against plain numpy."""

import random

import numpy as np
import pytest

from siglex.operators import ranks, spectra


def rows_of(spark, arrays, gaps=()):
    rows = [("s", k, "c", t, None if (k, t) in gaps else float(v)) for k, a in enumerate(arrays) for t, v in enumerate(a)]
    return spark.createDataFrame(rows, "subject string, trial long, channel string, t int, x double").repartition(3)


@pytest.mark.parametrize(("size", "hop", "block"), [(16, 8, 64), (16, 5, 16), (256, 128, 8192), (7, 7, 21)])
def test_frames_of_blocks(spark, monkeypatch, size, hop, block):
    monkeypatch.setattr(spectra, "BLOCK", block)
    r = np.random.default_rng(size)
    arrays = [r.normal(size=n) for n in (1000, size - 1, size, 333)]
    gaps = {(0, 90), (3, 5)}
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    want = {}
    for k, a in enumerate(arrays):
        for f in range((len(a) - size) // hop + 1 if len(a) >= size else 0):
            if not any((k, t) in gaps for t in range(f * hop, f * hop + size)):
                w = a[f * hop : f * hop + size]
                want[k, f] = np.abs(np.fft.rfft((w - w.mean()) * hann)) ** 2 / size
    got = {(x.trial, x.frame): np.array(x.power) for x in spectra.spectra(rows_of(spark, arrays, gaps), size, hop, detrend=True).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    mean = {(x.trial, x.bin): x.power for x in spectra.mean_power(rows_of(spark, arrays, gaps), size, hop).collect()}
    for k in {k for k, _ in want}:
        assert np.allclose([mean[k, b] for b in range(size // 2 + 1)], np.mean([v for (j, _), v in want.items() if j == k], axis=0))


def test_no_plan_explodes_over_bins(spark):
    plan = spectra.binned(rows_of(spark, [[1.0] * 64]), 16, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1  # samples to the one or two blocks that hold them


@pytest.mark.parametrize("least", [1, 10, 1 << 16])
def test_ranks(spark, least):
    r = random.Random(least)
    for values in ([], [3.0], [2.5] * 50, [r.gauss(0, 1) for _ in range(400)] + [1e9, -1e12, 0.0, -0.0] + [0.25] * 300, [float(k // 7) for k in range(200)]):
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "z double").repartition(3)
        order, n = sorted(values), len(values)
        wanted = sorted({0, n - 1, n // 2, n // 3, min(5, n - 1)} - {-1}) if n else [0, 4]
        assert ranks.ranked(df, "z", wanted, least) == {k: order[k] for k in wanted if n}
        shares = [k / 16 for k in range(17)]
        assert np.allclose(ranks.quantiles(df, "z", shares, least), np.quantile(values, shares) if n else [])
