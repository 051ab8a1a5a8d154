"""Fixtures of the survey, properties of the models, and queries against their SQL on the smallest tables."""

import math
import random

import duckdb
import numpy as np
import pytest

from siglex.operators import bpe, pipelines, signals, stats
from siglex.plans import registry
from siglex.sources import tables

SF = "/root/testdata/sf0.001"


def fold(seq, merges, base):
    seq = list(seq)
    for k, (left, right) in enumerate(merges):
        out, i = [], 0
        while i < len(seq):
            hit = i + 1 < len(seq) and (seq[i], seq[i + 1]) == (left, right)
            out.append(base + k if hit else seq[i])
            i += 2 if hit else 1
        seq = out
    return seq


def test_all_merges_at_once_are_the_fold_in_rank_order():
    r = random.Random(1)
    for seed in range(60):
        base = r.randint(1, 4)
        merges = bpe.random_merges(base, r.randint(1, 2), seed) if base == 1 else bpe.random_merges(base, r.randint(1, 12), seed)
        seq = [r.randrange(base) for _ in range(r.randint(0, 60))]
        assert bpe.apply_merges(np.array(seq, np.int64), merges, base).tolist() == fold(seq, merges, base)
    assert bpe.apply_merges(np.array([1, 1, 1, 2, 3]), [(1, 1), (2, 3), (1, 5)], 4).tolist() == [4, 6]


def test_lazy_selection_passes_over_touched_pairs(spark):
    seqs = spark.createDataFrame([([0, 1, 0, 1, 0, 1, 2],), ([1, 2],), ([1, 2],)], "toks array<int>")
    assert bpe.train(seqs, 3, 5) == [(0, 1), (1, 2)]
    assert bpe.train(seqs, 3, 5, selection="lazy_heap") == [(0, 1), (3, 3)]


def test_vocabularies_survive_writing(spark, tmp_path):
    bpe.save_vocabulary(spark, [(0, 1), (2, 2)], 2, str(tmp_path / "v"))
    assert bpe.load_vocabulary(spark, str(tmp_path / "v")) == ([(0, 1), (2, 2)], 2)
    assert len(set(bpe.random_merges(4, 20))) == 20


def test_results_keep_a_declared_schema(spark, tmp_path):
    place = str(tmp_path / "r")
    tables.append_results(spark.createDataFrame([("a", "1", "x")], "dataset string, acc string, extra string"), place, ["dataset", "acc", "seed"])
    tables.append_results(spark.createDataFrame([("b", "7")], "dataset string, seed string"), place, ["dataset", "acc", "seed"])
    assert sorted(map(tuple, spark.read.parquet(place).collect())) == [("a", "1", None), ("b", None, "7")]
    made = []

    def rows():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.materialised(spark, str(tmp_path), {"bins": 16}, rows).count() == 3
    assert made == [1]


def _waves(spark, n=64, rate=64.0):
    rows = [(k % 4, k, "e", t, math.sin(2 * math.pi * (4 if k // 4 % 2 else 20) * t / rate + k), k // 4 % 2) for k in range(40) for t in range(n)]
    return spark.createDataFrame(rows, "subject int, trial int, channel string, t int, x double, label int")


def test_filters_keep_their_band(spark):
    s = _waves(spark)
    power = lambda d: {r.label: r.p for r in d.where("t between 20 and 43").groupBy("label").agg({"x": "var_pop"}).withColumnRenamed("var_pop(x)", "p").collect()}
    low = power(signals.convolved(s, signals.bandpass_kernel(1.0, 8.0, 64.0, 33)))
    assert low[1] > 0.3 and low[0] < 0.01
    assert power(signals.cleaned(s, 64.0, 0.5, 31.0, (20.0, 50.0), 63))[1] > 0.3


def test_fourier_resampling_of_a_sine_is_the_sine(spark):
    for n, m in ((64, 32), (64, 24), (32, 64)):
        x, y = (np.cos(2 * np.pi * 3 * np.arange(k) / k + 0.4) for k in (n, m))
        rows = spark.createDataFrame([(k, (k * x).tolist()) for k in (1, 2)] + [(3, [1.0])], "k int, x array<double>")
        got = {r.k: r.x for r in signals.resampled(rows, n, m).collect()}
        assert got.keys() == {1, 2} and all(np.allclose(got[k], k * y) for k in got)


def test_models_tell_two_states_apart(spark):
    s = _waves(spark)
    rows = pipelines.histogram_rows(pipelines.tokenised(pipelines.coded(s), 16, 20), 20)
    for model in ("logreg", "lda"):
        assert pipelines.validated(rows, model, 2).first().accuracy > 0.9
    assert pipelines.validated(pipelines.psd_rows(s, 64.0, {"low": (1.0, 8.0), "high": (12.0, 31.0)}), "logreg", 2).first().accuracy > 0.95
    folds = {r.subject: r.fold for r in stats.grouped_folds(s.select("subject", "trial", "label").distinct(), 2).collect()}
    assert sorted(folds.values()) == [0, 0, 1, 1]


def test_perfect_and_useless_scores(spark):
    rows = spark.createDataFrame([("a", k > 5, float(k)) for k in range(12)] + [("b", k % 2 == 0, 1.0) for k in range(12)] + [("c", True, 0.3)], "g string, hit boolean, score double")
    assert {r.g: r.auc for r in stats.auc(rows, ["g"]).collect()} == {"a": 1.0, "b": 0.5, "c": 0.5}


CHEAP = [
    "dataset_registry", "label_map_composite", "stage_names", "relayout_4d", "assemble_truncated", "budgeted_sequences", "results_csv", "quantize_adaptive", "bandpass_notch", "resample_fft", "welch_psd",
    "bpe_train_small", "bpe_train_lazy", "bpe_by_key", "hist_masked", "jaccard_sources", "power_law_ks", "method_pairs", "bootstrap_draws", "classifier_pairs", "auc_binary", "report_gap", "report_status", "pivot_results", "loso_splits",
]


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem", "events", "documents", "embeddings", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = db.execute(registry.oracle_sql()[name])
    columns = sorted(d[0] for d in found.description)
    want = found.fetchdf()[columns]
    got = registry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == columns and len(got) == len(want) > 0
    rows = lambda f: sorted(([v for v in row if not isinstance(v, float)], [v for v in row if isinstance(v, float)]) for row in f[columns].astype({c: str for c in columns if f[c].dtype == object}).itertuples(index=False))
    key = lambda f: [(str(a), tuple(round(v, 4) for v in b)) for a, b in f]
    one, two = sorted(rows(got), key=lambda x: key([x])), sorted(rows(want), key=lambda x: key([x]))
    for (a, x), (b, y) in zip(one, two, strict=True):
        assert [str(v) for v in a] == [str(v) for v in b] and np.allclose(x, y, rtol=1e-6, atol=2e-6, equal_nan=True)
