"""Studies by properties: conditions that must agree do, a planted difference is found, shuffles agree with the normal law."""

import numpy as np
import pytest

from siglex.operators import studies


def waves(spark, seed, subjects=4, trials=10):
    """Slow and fast waves: what the tokens should tell apart."""
    r, out = np.random.default_rng(seed), []
    for s in range(subjects):
        for t in range(trials):
            x = np.sin(np.arange(64) * (0.1 if t % 2 else 0.9) + r.uniform(0, 6)) + 0.1 * r.normal(size=64)
            out += [(s, s * 100 + t, "c0", k, float(v), t % 2) for k, v in enumerate(x)]
    return spark.createDataFrame(out, "subject int, trial long, channel string, t int, x double, label int").repartition(3)


def test_improvements_agree_where_they_must(spark):
    got = studies.improvements({"a": waves(spark, 1)}, "uniform", 8, 14, 18, pairs=10, windows=2, transforms=("raw",), classifiers=("logreg",), k=2, steps=20).toPandas()
    assert set(got["part"]) == {"S1", "S2", "S3", "S4", "S5", "S6"} and (got.groupby(["part", "condition"]).size() == 2).all()
    of = {(p, c): g.sort_values("fold")["accuracy"].tolist() for (p, c), g in got.groupby(["part", "condition"])}
    assert of["S1", "merged_raw"] == of["S2", "raw"] == of["S4", "own"] == of["S6", "level_one"]
    assert of["S4", "universal"] == of["S4", "own"]  # all data sets are this one
    assert min(np.mean(of[k]) for k in (("S1", "merged_raw"), ("S5", "bigrams"), ("S6", "both_levels"))) > 0.9


def test_hierarchy_finds_the_feature_that_grows_with_the_level(spark):
    r = np.random.default_rng(3)
    rows = [(f, k, float(v)) for k in range(60) for f, v in (("grows", k + 5 * r.normal()), ("free", r.normal()), ("flat", 1.0))]
    got = {q.feature: q for q in studies.hierarchy(spark.createDataFrame(rows, "feature string, token int, v double"), "token", "v", "feature", 199).collect()}
    assert set(got) == {"grows", "free"}  # what does not vary has no correlation
    assert got["grows"].p_shuffled == pytest.approx(1 / 200) and got["grows"].p_bonferroni < 0.01
    assert got["free"].p_shuffled == pytest.approx(got["free"].p, abs=0.15)


def test_forests_of_improvements_tell_waves_apart(spark):
    got = studies.improvements({"a": waves(spark, 2)}, "uniform", 8, 14, 18, transforms=("raw", "binary"), classifiers=("forest",), k=2, parts=("S2",)).toPandas()
    assert len(got) == 4 and set(got["model"]) == {"forest"} and got["auc"].isna().all()
    assert got.query("condition == 'raw'")["accuracy"].min() > 0.9
