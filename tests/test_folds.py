"""Fits inside folds: nothing of a held-out subject enters them; probabilities and their sums."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siglex.operators import folds, stats, studies
from siglex.operators import pipelines as P
from siglex.sources.shared import written


def rows_of(spark, changed=None, subjects=6, trials=40, classes=3):
    r = np.random.default_rng(4)
    out = []
    for s in range(subjects):
        for t in range(trials):
            y = t % classes
            x = r.normal(size=4) + np.array([2.0 * (y == 0), 2.0 * (y == 1), 0, 1000])
            out.append((s, s * 1000 + t, y, (x * (50 if s == changed else 1)).tolist()))
    return spark.createDataFrame(out, "subject int, trial long, label int, features array<double>").repartition(3)


def samples_of(spark, changed=None):
    r = np.random.default_rng(5)
    out = []
    for s in range(4):
        for t in range(8):
            y = t % 2
            mix = np.array([[1.0 + y, 0, 0.2], [0, 2.0 - y, 0.1], [0.3, 0.3, 1]])
            x = r.normal(size=(40, 3)) @ mix * (1 if s != changed else np.array([1, -9, 4]))
            out += [(s, s * 100 + t, f"c{c}", k, float(x[k, c]), y) for k in range(40) for c in range(3)]
    return spark.createDataFrame(out, "subject int, trial long, channel string, t int, x double, label int").repartition(3)


FOLDS = [(s, s // 2) for s in range(6)]


def test_a_held_out_subject_changes_nothing_in_its_folds_fit(spark):
    of = spark.createDataFrame(FOLDS, "subject int, fold int")
    fits = []
    for changed in (None, 5):  # held out by fold 2
        held = folds.placed(rows_of(spark, changed), of)
        fits.append((*folds.scales(held, 3), folds.components(held, 3, 2), folds.codebooks(held, 3, 5, rounds=3), folds.logistic(held, 3, steps=3).weights))
    for one, other in zip(*fits, strict=True):
        assert np.allclose(one[2], other[2], rtol=1e-6, atol=1e-6)  # a shift common to all folds leaves rounding in the components
        assert not np.allclose(one[0], other[0])
    of = spark.createDataFrame([(s, s % 2) for s in range(4)], "subject int, fold int")
    (one, names), (other, _) = (folds.spatial_filters(samples_of(spark, c), of, 2, 2) for c in (None, 3))  # held out by fold 1
    assert names == ["c0", "c1", "c2"] and one[1].keys() == {"0:0", "0:1", "1:0", "1:1"}
    assert all(np.allclose(one[1][c], other[1][c]) for c in one[1]) and not all(np.allclose(one[0][c], other[0][c]) for c in one[0])
    tokens = []
    for c in (None, 3):
        coded = P.coded(folds.zscored(samples_of(spark, c)))
        tokens.append({(r.subject, r.trial): r.features for r in studies.token_rows(coded, of, 2, 16, 17).where("model = 1 and fold <> 1").collect()})
    assert tokens[0] == tokens[1]


def test_fits_against_numpy(spark):
    of = spark.createDataFrame(FOLDS, "subject int, fold int")
    rows = rows_of(spark)
    held = folds.placed(rows, of)
    table = {f: [(np.array(r.features), r.label) for r in held.collect() if r.fold != f] for f in range(3)}
    mean, spread = folds.scales(held, 3)
    model = folds.logistic(held, 3, steps=60, tolerance=1e-6)
    pcs = folds.components(held, 3, 2)
    for f in range(3):
        x, y = np.array([v for v, _ in table[f]]), np.array([c for _, c in table[f]])
        assert np.allclose(mean[f], x.mean(0)) and np.allclose(spread[f], x.std(0))
        value, vector = np.linalg.eigh(np.cov(x.T, bias=True))
        assert np.allclose(np.abs((vector[:, ::-1][:, :2].T * pcs[f]).sum(1)), 1)
        z, w = (x - mean[f]) / spread[f], model.weights[f]
        p = model.probabilities(f, x)
        weight = len(y) / (3 * np.bincount(y, minlength=3))[y]
        inner = w[:-1] * spread[f][:, None]
        gradient = z.T @ ((p - np.eye(3)[y]) * weight[:, None]) / len(y) + inner / len(y)
        assert np.abs(gradient).max() < 1e-5  # the optimum of the same loss


def test_measures_are_sums_over_the_predictions(spark, tmp_path):
    of, n = studies.subject_folds(rows_of(spark), None)
    assert n == 6
    p = studies.predicted(rows_of(spark), of, n, steps=12)
    place = str(tmp_path / "p")
    p.write.parquet(place)
    assert p.count() == 240 and p.select("trial").distinct().count() == 240
    got = {r.fold: r for r in folds.measures(p, [0, 1, 2]).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW p AS SELECT * FROM '{place}/*.parquet'")
    want = db.execute("""
        WITH c AS (SELECT fold, y, probability FROM p), k AS (SELECT unnest(range(3)) AS k),
        pairs AS (SELECT a.fold, k, avg(CASE WHEN a.probability[k + 1] > b.probability[k + 1] THEN 1 WHEN a.probability[k + 1] = b.probability[k + 1] THEN 0.5 ELSE 0 END) AS auc FROM c a JOIN c b USING (fold), k WHERE a.y = k AND b.y <> k GROUP BY ALL),
        auc AS (SELECT fold, avg(auc) AS auc FROM pairs GROUP BY fold), n AS (SELECT fold, count(*) AS n FROM p GROUP BY fold),
        chance AS (SELECT fold, sum(a * b) / any_value(n) / any_value(n) AS pe FROM (SELECT fold, k, count(*) FILTER (y = k) AS a, count(*) FILTER (p = k) AS b FROM p, k GROUP BY ALL) JOIN n USING (fold) GROUP BY fold)
        SELECT fold, avg((y = p)::INT) AS accuracy, any_value(auc) AS auc, (avg((y = p)::INT) - any_value(pe)) / (1 - any_value(pe)) AS kappa FROM p JOIN auc USING (fold) JOIN chance USING (fold) GROUP BY fold""").fetchall()
    assert len(want) == 6
    for fold, accuracy, area, kappa in want:
        assert got[fold].accuracy == pytest.approx(accuracy) and got[fold].auc == pytest.approx(area) and got[fold].kappa == pytest.approx(kappa)
        assert accuracy > 0.5 and all(abs(sum(r.probability) - 1) < 1e-9 for r in p.collect())
    measured, confusion = studies.evaluated({"a": rows_of(spark)}, k=2, seeds=(1, 2), steps=4)
    assert measured.count() == 4 and confusion.agg(F.sum("n")).first()[0] == 480
    assert studies.summary(measured, ["condition"]).first().n_folds == 4


def test_running_sums(spark):
    r = np.random.default_rng(0)
    rows = [(int(k % 3), float(v), int(n)) for k, (v, n) in enumerate(zip(r.normal(size=200), r.integers(1, 9, 200), strict=True))]
    got = stats.running(spark.createDataFrame(rows, "g int, v double, n long"), ["g"], ["v"], ["n"]).collect()
    assert all(x.n_before == sum(n for g, v, n in rows if g == x.g and v < x.v) for x in got) and len(got) == 200
    scores = spark.createDataFrame([(0, i % 3 == 0, float(i // 4)) for i in range(60)] + [(1, True, 1.0)], "g int, hit boolean, score double")
    found = {x.g: x.auc for x in stats.auc_by_counts(scores, ["g"]).collect()}
    assert found == {0: pytest.approx({x.g: x.auc for x in stats.auc(scores, ["g"]).collect()}[0]), 1: None}


def test_spatial_studies(spark):
    s = samples_of(spark)
    z = folds.zscored(s)
    variance = studies.in_folds(lambda of, k: folds.spatial_rows(z, of, k, 1), z, 2, steps=6).collect()
    assert {x.fold for x in variance} == {0, 1} and np.mean([x.accuracy for x in variance]) > 0.8
    states = studies.spatial_states(s, ["c0", "c1", "c2"], 2, codes=3, vocabulary=4, steps=2).collect()
    assert len(states) == 4 and all(0 <= x.auc <= 1 for x in states)


def test_random_range_finder(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(150, 60)) * np.concatenate([[30, 20, 12, 8], np.full(56, 0.3)]) @ np.linalg.qr(r.normal(size=(60, 60)))[0] + 500
    found, variance = folds.wide_components(spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>").repartition(3), 4)
    value, vector = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(np.linalg.svd(found @ vector[:, ::-1][:, :4])[1], 1, atol=1e-9)  # no angle between the subspaces
    assert np.allclose(variance, value[::-1][:4], rtol=1e-9)


def test_transfer_has_every_source_and_target(spark):
    s = samples_of(spark).where("channel <> 'c2'")
    named = s.where("channel = 'c0'").withColumn("label", F.concat(F.lit("k"), F.col("label").cast("string")))
    got = studies.transfer({"a": s, "b": named}, 16, 18, 2, steps=3).collect()
    assert {(x.source, x.target, x.fold) for x in got} == {(a, b, f) for a in "ab" for b in "ab" for f in range(2)}
    assert all(0 <= x.accuracy <= 1 for x in got)


def test_gathered_trials_give_what_long_samples_give(spark):
    r = np.random.default_rng(8)
    rows = [(s, t, "xy"[t % 2], k, *r.normal(size=3).tolist()) for s in range(4) for t in range(4) for k in range(40 - 3 * s)]
    wide = spark.createDataFrame(rows, "subject int, trial int, label string, t int, a double, b double, c double").repartition(3)
    names = ["a", "b", "c"]
    long = wide.select("subject", "trial", F.inline(F.array(*(F.struct(F.lit(n).alias("channel"), F.col(n).alias("x")) for n in names))), "t", "label").where("not (channel = 'b' and t = 5)")
    wide = wide.withColumn("b", F.when(F.col("t") != 5, F.col("b")))
    of = spark.createDataFrame([(s, s % 2) for s in range(4)], "subject int, fold int")
    expected, _ = folds.spatial_filters(long, of, 2, 2)
    variances = {(q.model, q.subject, q.trial): q.features for q in folds.spatial_rows(long, of, 2, 2).collect()}
    views = folds.filtered(long, expected, names).withColumnRenamed("component", "channel")
    coded = {(f, q.subject, q.trial, q.channel): q.toks for f in range(2) for q in P.coded(views.where(F.col("model") == f).drop("model")).collect()}
    for steps in (long, wide):
        held = written(folds.series(steps, names), "series")
        trials = folds.moments(held, 3).join(of, "subject")
        filters = folds.patterns(trials, 3, 2, 2)
        assert all(np.allclose(filters[f][c], w, atol=1e-8) for f, own in expected.items() for c, w in own.items())
        got = {(q.model, q.subject, q.trial): q.features for q in folds.log_variances(trials, filters, 3, 2).collect()}
        assert set(got) == set(variances) and all(np.allclose(got[q], v, atol=1e-8) for q, v in variances.items())
        codes = folds.component_values(held, filters, 3, "toks", "int", lambda y, first, size: folds.uniform_codes(y, first, size, 16))
        found = {(q.model, q.subject, q.trial, q.channel): q.toks for q in codes.collect()}
        assert found == coded


def test_trials_are_shuffled_once_for_all_components(spark):
    """The components of a step meet in its row; before, a row for each step, channel, fold and component was shuffled."""
    wide = spark.createDataFrame([(0, 0, 1, k, float(k), 1.0) for k in range(9)], "subject int, trial int, label int, t int, a double, b double")
    held = written(folds.series(wide, ["a", "b"]), "series")
    views = folds.component_values(held, {0: {"1:0": np.array([1.0, 2.0])}, 1: {"1:0": np.array([0.0, 1.0])}}, 2, "x", "double", lambda y, *_: y)
    assert "Exchange" not in views._jdf.queryExecution().executedPlan().toString()
    assert {q.model: q.x for q in views.collect()} == {0: [k + 2.0 for k in range(9)], 1: [1.0] * 9}
