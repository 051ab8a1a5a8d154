"""Training by differences against one merge at a time."""

import os
import random

import numpy as np
import pytest

from siglex.operators import bpe, merges
from siglex.sources import shared


def one_at_a_time(seqs, base, vocabulary, lazy=False):
    seqs, out, first = [list(s) for s in seqs], [], None
    while base + len(out) < vocabulary:
        counts = {}
        for s in seqs:
            for p in zip(s, s[1:], strict=False):
                counts[p] = counts.get(p, 0) + 1
        first = first if first is not None else dict(counts)
        if lazy:
            counts = {p: n for p, n in counts.items() if max(p) >= base or n == first[p]}
        best = min(counts, key=lambda p: (-counts[p], p), default=None)
        if best is None or counts[best] < 2:
            break
        total = 0
        for k, s in enumerate(seqs):
            t, i = [], 0
            while i < len(s):
                hit = i + 1 < len(s) and (s[i], s[i + 1]) == best
                t.append(base + len(out) if hit else s[i])
                i += 2 if hit else 1
            seqs[k] = t
            total += len(t)
        out.append((*best, counts[best], total))
    return out


@pytest.mark.parametrize(("seed", "lazy"), [(1, False), (2, False), (3, True), (4, False)])
def test_equals_one_merge_at_a_time(spark, monkeypatch, seed, lazy):
    monkeypatch.setattr(merges, "REWRITE", 5)
    monkeypatch.setattr(merges, "CHUNK", 200)
    r = random.Random(seed)
    base = r.randint(1, 5)
    seqs = [[min(base - 1, int(r.expovariate(1))) for _ in range(r.randint(0, 40))] for _ in range(40)]
    seqs += [seqs[0]] * 9 + [[], [0], [0] * 25] + [seqs[3][::-1]] * 4
    df = spark.createDataFrame([(s,) for s in seqs] + [(None,)], "toks array<int>").repartition(3)
    held = lambda: {d for d in os.listdir(shared.folder(spark).removeprefix("file:")) if "merge-state" in d}
    before, progress = held(), []
    got = bpe.train(df, base, base + 30, selection="lazy_heap" if lazy else "greedy", progress=progress)
    want = one_at_a_time(seqs, base, base + 30, lazy)
    assert got == [x[:2] for x in want] and len(want) > 5
    assert [(p[1], p[2], p[4], p[5]) for p in progress] == want
    assert held() <= before  # tables of past rounds are gone


def test_changes_of_a_plan_are_differences_of_counts():
    r = np.random.default_rng(5)
    count = lambda s, w: {p: int(w[(s[:-1] == p[0]) & (s[1:] == p[1])].sum()) for p in {*zip(s[:-1].tolist(), s[1:].tolist(), strict=True)} if min(p) >= 0}
    for _ in range(60):
        seq = np.where(r.random(50) < 0.1, -1, r.integers(0, 3, 50))
        weight = r.integers(1, 4, 50)[np.cumsum(seq == -1)]
        plan = [(0, 0), (1, 2), (3, 3), (4, 0)]
        now, w = seq, weight
        for k, (left, right) in enumerate(plan):
            at = merges.places(now, left, right)
            after, keep = now.copy(), np.ones(len(now), bool)
            after[at], keep[at + 1] = 3 + k, False
            after, w2 = after[keep], w[keep]
            old, new = count(now, w[:-1]), count(after, w2[:-1])
            found: dict = {}
            for step, l, rr, n in merges.traced(seq, weight, plan, 3):
                for p in zip(l.tolist(), rr.tolist(), n.tolist(), strict=True) if step == k else ():
                    found[p[:2]] = found.get(p[:2], 0) + p[2]
            found.pop((-1, -1), None)
            assert {p: n for p, n in found.items() if n} == {p: new.get(p, 0) - old.get(p, 0) for p in {*old, *new} if new.get(p, 0) != old.get(p, 0)}
            now, w = after, w2


def test_tokens_must_lie_below_the_base(spark):
    with pytest.raises(ValueError, match="not below"):
        bpe.train(spark.createDataFrame([([0, 5, 0, 5],)], "toks array<int>"), 3, 5)
    assert bpe.train(spark.createDataFrame([], "toks array<int>"), 3, 5) == []


def test_waves_are_the_fold_in_rank_order():
    r = random.Random(9)
    for seed in range(400):
        base = r.randint(1, 4)
        seq = [r.randrange(base) for _ in range(r.randint(0, 80))]
        if seed % 2:
            learnt = [x[:2] for x in one_at_a_time([seq, seq], base, base + 15)]
        else:
            learnt = bpe.random_merges(base, r.randint(1, 2 if base == 1 else 12), seed)
        text = [r.randrange(base) if r.random() > 0.05 else -1 for _ in range(r.randint(0, 120))]
        want = np.array(text, np.int64)
        for k, pair in enumerate(learnt):
            want = bpe.merged(want, *pair, base + k)
        assert bpe.apply_merges(np.array(text, np.int64), learnt, base).tolist() == want.tolist()
    assert bpe.apply_merges(np.array([0, 1, 2, 1]), [(0, 1), (3, 2), (2, 1)], 3).tolist() == [4, 1]
    assert bpe.apply_merges(np.array([0, 1, 3, 3]), [(0, 1), (3, 3)], 3).tolist() == [4, 3]


def test_a_smaller_vocabulary_is_the_head_of_a_larger_one(spark):
    r = random.Random(7)
    seqs = spark.createDataFrame([([r.randint(0, 3) for _ in range(60)],) for _ in range(9)], "toks array<int>")
    learnt = bpe.train(seqs, 4, 20)
    assert all(bpe.prefix(learnt, 4, v) == bpe.train(seqs, 4, v) for v in (4, 7, 12))
