"""Periodic runs against brute force; the grouping phase against its definition."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from siglex.llm import periodic, queries


def brute_lyndon(s):
    n, out = len(s), []
    for i in range(n):
        j = i + 1
        while j < n and s[i:] < s[j:]:
            j += 1
        out.append(j - i)
    return out


def brute_runs(w, least, times):
    n, out, seen = len(w), [], set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and w[e] == w[e + q]:
                e += 1
            span = (i, e + q)
            if e + q - i >= max(least, times * q) and span not in seen:
                seen.add(span)
                out.append((i, e + q - i, q))
            i = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_lyndon_array(seed):
    r = random.Random(seed)
    for _ in range(80):
        s = [r.randrange(1 + seed) for _ in range(r.randint(0, 40))]
        assert periodic.lyndon_array(np.array(s, np.int64)).tolist() == brute_lyndon(s)


@pytest.mark.parametrize(("least", "times"), [(24, 3), (5, 3), (3, 3), (7, 4)])
def test_runs(least, times):
    r = random.Random(least)
    for k in range(150):
        w = [r.choice(b"abcdefgh"[: 2 + k % 5]) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            q, at = r.randint(1, 12), r.randint(0, len(w))
            root = [r.choice(b"abc") for _ in range(q)]
            w[at:at] = (root * 30)[: r.randint(q, 5 * q + 30)]
        words = [bytes([x]) for x in w]
        got = periodic.runs(words, least, times)
        assert got == brute_runs(w, least, times)
        dropped = {i for s, n, q in got for i in range(s + q, s + n)}
        assert periodic.collapsed(words, got) == [x for i, x in enumerate(words) if i not in dropped]


def test_edges_and_long_texts(spark):
    tail = [str(k) for k in range(7_000)]
    long = " ".join([*(str(-k) for k in range(1, 20_000)), *tail * 4, "end"])
    rows = [(1, None), (2, ""), (None, "\n\t "), (3, "x " * 24), (3, "x " * 24), (4, "X x " * 30), (5, long), (6, "a b " * 23)]
    docs = spark.createDataFrame([(*x, "c", 0) for x in rows], "doc_id long, text string, runs string, n_words int").repartition(2)
    got = {(x.doc_id, x.n_words): x for x in periodic.periodic_runs(docs).collect()}
    assert periodic.periodic_runs(docs).count() == len(rows)
    assert got[1, 0].runs == [] and got[2, 0].text == "" and (None, 0) in got
    assert [tuple(r) for r in got[3, 24].runs] == [(0, 24, 1)] and got[3, 24].text == "x"
    assert got[4, 60].text == "X x" and got[6, 23].runs == []
    assert [tuple(r) for r in got[5, 48_000].runs] == [(19_999, 28_000, 7_000)]
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {x.doc_id: x for x in queries.queries()["op13_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        words = [x for x in re.split(r"[\x20\x09-\x0D]+", d.text or "") if x]
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        found = brute_runs(words, 24, 3)
        planted += bool(found)
        dropped = {i for s, m, q in found for i in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        x = got[d.doc_id]
        assert (x.n_runs, x.start, x.length, x.period) == (len(found), *(best or (None,) * 3))
        assert x.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert x.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in found))
        assert x.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in dropped))
    assert planted > 5
