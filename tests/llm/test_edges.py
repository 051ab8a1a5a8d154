"""Entropy windows and toxicity against brute force; nulls, ties, repeated rows, long texts and empty tables of several operators."""

import random
from math import log2

import pytest
from pyspark.sql import functions as F

from siglex.llm import decontamination, fingerprints, secrets, sharding, toxicity


@pytest.mark.parametrize("alphabet", [b"ab", b"0123456789abcdef", bytes(range(48, 123))])
def test_entropy_windows_against_counting(alphabet):
    r = random.Random(len(alphabet))
    for _ in range(60):
        s, window, bits = bytes(r.choices(alphabet, k=r.randint(0, 70))), r.randint(2, 24), r.uniform(0.2, 4.2)
        inside = set()
        for a in range(len(s) - window + 1):
            w = s[a : a + window]
            if -sum(w.count(c) / window * log2(w.count(c) / window) for c in set(w)) >= bits:
                inside |= set(range(a, a + window))
        got = secrets.windows_above(s, window, bits)
        assert {p for a, b in got for p in range(a, b)} == inside
        assert all(b < c for (_, b), (c, _) in zip(got, got[1:], strict=False))


def test_entropy_stands_beside_base_spans(spark):
    key = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    rows = [(1, f'token = "{key}"'), (1, f'token = "{key}"'), (2, f"só {key.upper()} x"), (3, "0123456789abcdef0123456789abcdef"), (4, "a" * 60), (5, "word " * 60_000 + key), (None, None)]
    docs = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, spans string")
    got = [(r.doc_id, r.spans) for r in secrets.find_secrets(docs).collect()]
    both = f"assign:0:{9 + len(key)},hex:9:{9 + len(key)},entropy_hex:9:{9 + len(key)}"
    assert got.count((1, both)) == 2 and (2, f"entropy_hex:3:{3 + len(key)}") in got and (3, "hex:0:32") in got and (4, "hex:0:60") in got
    assert (5, f"hex:300000:{300_000 + len(key)},entropy_hex:300000:{300_000 + len(key)}") in got and (None, "") in got
    assert secrets.find_secrets(docs.where(F.lit(False))).count() == 0


def _toxic_corpus(n, seed=7):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 7)))
    bad = ["zorquan", "vexxil", "kruppo"]
    docs, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        words = [word() for _ in range(r.randint(5, 60))]
        if toxic:
            words[r.randrange(len(words))] = r.choice(bad).upper() if k % 8 else r.choice(bad)
        docs.append((k, " ".join(words), "xx", k))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = _toxic_corpus(600)
    d = spark.createDataFrame(docs, "doc_id long, text string, score string, predicted int").repartition(3)
    got = {r.doc_id: r for r in toxicity.toxicity(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [k for k in got if got[k].held_out]
    assert len(got) == 600 and 60 < len(held) < 180
    assert sum(got[k].predicted == labels[k][2] for k in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_toxicity_takes_no_held_out_label(spark):
    docs, labels = _toxic_corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, n int").select("doc_id", "text")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    turned = table.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda t: sorted((r.doc_id, r.score) for r in toxicity.toxicity(d, t).collect())
    assert score(table) == score(turned)


def test_toxicity_of_nulls_ties_long_texts_and_empty_tables(spark):
    docs, labels = _toxic_corpus(120)
    docs += [(None, None, "x", 0), (900, "", "x", 0), (901, "zorquan " * 40_000, "x", 0), (902, "vexxil abc", "x", 0), (902, "vexxil abc", "x", 0)]
    labels += [(None, 1, 1), (3, None, None), (4, 0, 0), (4, 0, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string, y int")
    t = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(d, t).collect()
    score = {}
    for r in rows:
        score.setdefault(r.doc_id, []).append(r.score)
    assert len(rows) == len(docs) and score[None] == score[900] and len(set(score[902])) == 1 and len(score[902]) == 2
    kept = toxicity.clean_documents(d, t)
    assert kept.columns == d.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {k for k, s in score.items() if s[0] < 0.5}
    assert toxicity.toxicity(d.where(F.lit(False)), t).count() == 0
    one = toxicity.toxicity(d, t.where("toxic = 0")).collect()
    assert len({r.score for r in one}) == 1 and one[0].predicted == 0
    assert {r.predicted for r in toxicity.toxicity(d, t.where(F.lit(False))).collect()} <= {0, 1}


def test_leaks_of_repeated_rows_long_texts_and_ties(spark):
    item = "the seventh traveller carried 12 copper lamps across the frozen river before the bells of the old town rang"
    pad = "some quite other words that stand in no question at all and go on "
    rows = [(1, f"{pad * 3000} {item} {pad}"), (2, item), (2, item), (3, item.capitalize()), (None, None), (4, pad * 20)]
    d = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(1, item), (2, item), (None, item), (3, None), (4, "")], "item_id long, text string")
    got = decontamination.leaks(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.item_id is not None} == {(k, i) for k in (1, 2, 3) for i in (1, 2)}
    clean = decontamination.without_leaks(d, b)
    assert clean.columns == d.columns and sorted((r.doc_id or 0) for r in clean.collect()) == [0, 4]
    assert decontamination.leaks(d.where(F.lit(False)), b).count() == 0 and decontamination.without_leaks(d, b.where(F.lit(False))).count() == len(rows)


def test_fingerprints_of_one_row_repeated_rows_and_none(spark):
    schema = "doc_id long, text string, fingerprint int"
    alone = fingerprints.fingerprints(spark.createDataFrame([(5, "ab cd", 1)], schema)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0 and alone[0].n_chars == 5
    same = fingerprints.fingerprints(spark.createDataFrame([(1, "x y", 1), (1, "x y", 1), (2, None, 1), (3, "é" * 200_000, 1)], schema)).collect()
    assert len(same) == 4 and len({r.fingerprint for r in same if r.doc_id == 1}) == 1 and max(r.n_chars for r in same) == 200_000
    assert fingerprints.fingerprints(spark.createDataFrame([], schema)).count() == 0


def test_shards_of_long_and_equal_texts(spark):
    rows = [(k, "z" * 500_000 if k == 3 else "same", k) for k in range(30)]
    got = sharding.feistel_shards(spark.createDataFrame(rows, "doc_id long, text string, slot int"), 7).collect()
    assert sorted(sum(r.shard == s for r in got) for s in range(7)) == [4, 4, 4, 4, 4, 5, 5] and max(r["size"] for r in got) == 500_008
