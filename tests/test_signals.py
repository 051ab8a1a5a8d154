import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from siglex.operators import bpe, models, signals


def scan(seq, left, right, new):
    out, i = [], 0
    while i < len(seq):
        if i + 1 < len(seq) and (seq[i], seq[i + 1]) == (left, right):
            out.append(new)
            i += 2
        else:
            out.append(seq[i])
            i += 1
    return out


def greedy(seqs, base, vocabulary):
    seqs, merges = [list(s) for s in seqs], []
    while base + len(merges) < vocabulary:
        n = {}
        for s in seqs:
            for p in zip(s, s[1:], strict=False):
                n[p] = n.get(p, 0) + 1
        best = min(n, key=lambda p: (-n[p], p), default=None)
        if best is None or n[best] < 2:
            break
        seqs = [scan(s, *best, base + len(merges)) for s in seqs]
        merges.append(best)
    return merges


def test_merge_forms_agree(spark):
    r = random.Random(1)
    seqs = [[r.randint(0, 2) for _ in range(r.randint(0, 12))] for _ in range(20)] + [[1] * k for k in range(2, 7)]
    rows = [(k, i, t) for k, s in enumerate(seqs) for i, t in enumerate(s)]
    tokens = spark.createDataFrame(rows, "k int, pos int, tok int")
    for left, right in ((0, 1), (1, 1), (2, 0)):
        want = {k: scan(s, left, right, 9) for k, s in enumerate(seqs)}
        assert all(bpe.merged(np.array(s, int), left, right, 9).tolist() == want[k] for k, s in enumerate(seqs))
        got = {r.k: r.toks for r in bpe.sequences(bpe.apply_merge(tokens, ["k"], left, right, 9), ["k"]).collect()}
        assert got == {k: w for k, w in want.items() if w}


def test_exact_training_is_one_at_a_time_greedy(spark):
    r = random.Random(2)
    seqs = [[min(5, int(r.expovariate(0.6))) for _ in range(40)] for _ in range(15)]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(seqs)], "k int, toks array<int>")
    merges = bpe.train(df, 6, 20)
    assert merges == greedy(seqs, 6, 20)
    out = {r.k: r.toks for r in bpe.tokenise(df, merges, 6).collect()}
    vocabulary = {r.token: list(r.base_seq) for r in bpe.vocabulary_table(spark, merges, 6).collect()}
    assert [[b for t in out[k] for b in vocabulary[t]] for k in range(len(seqs))] == seqs


def test_constant_and_single_rows(spark):
    rows = [(1, 0, "c", t, 5.0, 0) for t in range(4)] + [(2, 0, "c", 0, 3.0, 0)]
    z = signals.zscore(spark.createDataFrame(rows, "subject int, trial int, channel string, t int, x double, label int"))
    assert {r.z for r in z.collect()} == {0.0}
    assert {r.code for r in signals.quantise(z, "mu_law", 64).collect()} == {31}
    assert {r.code for r in signals.quantise(z, "adaptive", 8).collect()} == {0}


@pytest.mark.parametrize("name", ["load_summary", "pair_counts", "kfold_splits"])
def test_registered_queries_run(spark, name):
    from siglex.plans import registry

    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_wide_steps_are_normalised_as_long_ones(spark):
    r = np.random.default_rng(11)
    rows = [(s, "A", t, float(r.normal(s, 2)), 3.0 if s else float(t)) for s in range(3) for t in range(20)]
    wide = spark.createDataFrame(rows, "subject int, trial string, t int, a double, b double")
    long = wide.select("subject", "trial", "t", F.inline(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("x")) for c in "ab"))))
    got = {(q.subject, q.t): (q.a, q.b) for q in signals.zscore_columns(wide, ["a", "b"], ["subject", "trial"]).collect()}
    expected = {(q.subject, q.t, q.channel): q.z for q in signals.zscore(long).collect()}
    assert all(got[s, t]["ab".index(c)] == z for (s, t, c), z in expected.items()) and len(expected) == 120


def test_spatial_tokens_reads_lineitem_without_long_rows(spark, monkeypatch):
    monkeypatch.setattr(models.T, "lineitem_multi", None)
    got = models.spatial_tokens(spark, "/root/testdata/sf0.001").toPandas()
    sizes = models.T.table(spark, "/root/testdata/sf0.001", "lineitem").groupBy("l_suppkey", "l_returnflag").count().toPandas()
    both = got.merge(sizes, left_on=["subject", "trial"], right_on=["l_suppkey", "l_returnflag"])
    assert len(both) == len(got) == len(sizes) and (both["n_tokens"] <= both["count"]).all() and both["n_tokens"].sum() < both["count"].sum()
