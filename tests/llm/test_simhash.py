"""SimHash components against brute force over whole texts and over dense groups of fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siglex.llm import queries, simhash


def brute_print(text, width=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_roots(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeÉß") for _ in range(r.randint(1, 5)))
    out = [None, "", " \t\n", "one", "ONE", "one two three", "a b c d", "A b\nc d", "x " * 700]
    for _ in range(8):
        base = [word() for _ in range(r.randint(30, 400))]
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word()
            out.append(r.choice(" \n\t").join(w))
    return out + ["long " + " ".join(word() for _ in range(30_000))]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    corpus = texts(seed)
    prints = [brute_print(t) for t in corpus]
    roots = brute_roots(prints)
    docs = spark.createDataFrame([(k, t, "c", 0) for k, t in enumerate(corpus)], "doc_id long, text string, fp string, component int").repartition(3)
    got = sorted(simhash.simhash_components(docs).collect())
    assert [(x.doc_id, x.fingerprint, x.component_id) for x in got] == [(k, f"{prints[k]:016x}", roots[k]) for k in range(len(corpus))]
    assert len(set(roots)) < len(set(prints))


@pytest.mark.parametrize(("blocks", "limit", "stars"), [(5, 4096, 16), (5, 20, 3), (6, 8, 1), (7, 40, 2)])
def test_dense_groups_in_cells(spark, blocks, limit, stars):
    r = random.Random(blocks * limit)
    centre = r.getrandbits(64)
    prints = {0, 1, (1 << 64) - 1, centre}
    for _ in range(150):
        prints.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 9))))
        prints.add(r.getrandbits(64) & r.getrandbits(64) & r.getrandbits(64) & r.getrandbits(64))
    prints = sorted(prints)
    nodes = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    found = simhash.links(nodes, blocks, limit, stars).collect()
    at = {int(np.uint64(p).astype(np.int64)): k for k, p in enumerate(prints)}
    root = simhash._roots(len(prints), np.array([at[x.a] for x in found]), np.array([at[x.b] for x in found]))
    assert root.tolist() == brute_roots(prints)


def test_edges(spark):
    kinds = "doc_id string, text string"
    rows = [("b", "same words here today"), ("b", "same words here today"), (None, "same  words HERE today"), ("c", None), (None, "")]
    got = [tuple(x) for x in simhash.simhash_components(spark.createDataFrame(rows, kinds)).collect()]
    one, zero = f"{brute_print(rows[0][1]):016x}", "0" * 16
    assert sorted(got, key=str) == sorted([("b", one, "b"), ("b", one, "b"), (None, one, "b"), ("c", zero, "c"), (None, zero, "c")], key=str)
    assert simhash.simhash_components(spark.createDataFrame([], kinds)).count() == 0
    only = simhash.simhash_components(spark.createDataFrame([(None, "x")], kinds)).collect()
    assert [(x.doc_id, x.component_id) for x in only] == [(None, None)]


def test_query(spark):
    got = queries.queries()["op12_simhash_pivots"](spark, "/root/testdata/sf0.001").collect()
    docs = sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text")).collect())
    prints = [brute_print(t) for _, t in docs]
    roots = brute_roots(prints)
    assert sorted((x.doc_id, x.fingerprint, x.component_id) for x in got) == [(docs[k][0], f"{prints[k]:016x}", docs[roots[k]][0]) for k in range(len(docs))]
