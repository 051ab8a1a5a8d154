import os
import random
import re

import numpy as np
from pyspark.sql import functions as F

from siglex.llm import ngram_join
from siglex.llm.components import components
from siglex.llm.scratch import written


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeÉß") for _ in range(r.randint(1, 5)))
    common = [word() for _ in range(60)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "a b c d", "A b\nc d", "x " * 30]
    bases = [[word() for _ in range(r.randint(20, 90))] for _ in range(12)]
    for b in bases:
        for _ in range(r.randint(1, 9)):
            t = list(b)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = word()
            if r.random() < 0.4:
                a = r.randint(0, 40)
                t += common[a : a + r.randint(1, 20)]
            texts.append(r.choice([" ", "\n", " \x0b "]).join(w.upper() if r.random() < 0.1 and w.isascii() else w for w in t))
    for _ in range(15):
        texts.append(" ".join([word() for _ in range(5)] + common + [word() for _ in range(r.randint(5, 30))]))
    return texts + texts[9:14]


def test_components_match_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts)


def test_large_bucket_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    texts = corpus(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_nulls_empty_table_and_extra_columns(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(None, text, 1, "z"), (4, text, 1, "z"), (4, text, 1, "z"), (9, None, 1, "z")], "doc_id long, text string, n long, key string")
    rows = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs).collect())
    assert rows == [(-1, 3, 4), (4, 3, 4), (4, 3, 4), (9, 0, 9)]
    assert ngram_join.similar_components(docs.where(F.lit(False))).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(0, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows = components(links.unionByName(spark.createDataFrame([(100, 101), (7, 7)], "a long, b long"))).collect()
    assert {r.node: r.component for r in rows} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_tables_have_a_place_for_every_shared_shingle(spark, monkeypatch):
    """A table of fixed size fills up, so that every shingle of a prefix is a key and the keys outgrow the disk."""
    monkeypatch.setattr(ngram_join, "TABLE_BITS", 4)
    r = random.Random(9)
    texts = [" ".join(f"w{r.randint(0, 10**6)}" for _ in range(200)) for _ in range(20)]
    docs = spark.createDataFrame([(2 * i + j, t + f" end{j} of it all") for i, t in enumerate(texts) for j in range(2)], "doc_id long, text string")
    shared, frequent = ngram_join.shared_tables(docs, 8)
    places = np.unpackbits(np.frombuffer(shared, np.uint8))
    assert places.sum() > 1000 and places.mean() < 2 / 3  # some 4000 shingles of two documents
    assert not np.frombuffer(frequent, np.uint8).any()


def test_tables_of_the_join_go_after_their_last_use(spark, monkeypatch):
    made = []
    monkeypatch.setattr(ngram_join, "written", lambda df, label: made.append((label, w := written(df, label))) or w)
    docs = spark.createDataFrame([(i, f"one two three four five six {i // 2}") for i in range(40)], "doc_id long, text string")
    rows = ngram_join.similar_components(docs)
    assert len({r.component_id for r in rows.collect()}) == 20
    left = [label for label, w in made if os.path.exists(w.inputFiles()[0].removeprefix("file://"))]
    assert "points" in left and not set(left) & {"shared-shingles", "keys", "members", "sets", "labelled", "rest", "bucket-pairs"}
