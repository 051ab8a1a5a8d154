import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siglex.llm import repeats

LENGTH = 48


def brute(texts, length):
    seen, out = {}, []
    raws = [(t or "").encode() for t in texts]
    for raw in raws:
        for p in range(len(raw) - length + 1):
            seen[raw[p : p + length]] = seen.get(raw[p : p + length], 0) + 1
    for raw in raws:
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            if seen[raw[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), spans, kept))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß ") for _ in range(r.randint(1, 9)))
    passage = [" ".join(word() for _ in range(30)) for _ in range(4)]
    texts = [None, "", "short", "ab" * 200, "z" * 150, "z" * 90]
    for _ in range(40):
        parts = [" ".join(word() for _ in range(r.randint(0, 20)))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passage)
            a = r.randint(0, 60)
            parts += [p[a : a + r.randint(20, 200)], word()]
        texts.append(r.choice([" ", "", "\n"]).join(parts))
    return texts + texts[6:12]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removes_what_brute_force_removes(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs, LENGTH).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, LENGTH)


def test_empty_null_ids_and_extra_columns(spark):
    docs = spark.createDataFrame([(None, "q" * 60, "x", 1)], "doc_id long, text string, d1 string, spans long")
    row = repeats.remove_repeats(docs, LENGTH).first()
    assert (row.n_bytes, row.n_removed, row.n_spans) == (60, 60, 1)
    assert repeats.remove_repeats(docs.where(F.lit(False)), LENGTH).count() == 0


def test_merge_is_sorted_and_carries_prefixes():
    r = random.Random(5)
    lists = [sorted(bytes(r.choices(b"ab", k=r.randint(0, 12))) for _ in range(r.randint(0, 30))) for _ in range(5)]
    merged = list(repeats.merge([iter(repeats.Run.of(x)) for x in lists]))
    flat = [s for _, _, s in merged]
    assert flat == sorted(s for x in lists for s in x)
    for (_, _, a), (k, _, b) in zip(merged, merged[1:], strict=False):
        assert k == repeats.common(a, b)


@pytest.mark.parametrize("seed", range(6))
def test_a_cut_copy_beside_longer_ones_of_other_tasks(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh ", k=60))
    passage, tail = word() + word(), "\n" + word()[:20]
    texts = [[before + passage + end for before, end in part] for part in ([("x", ""), ("zy", tail)], [("q", tail)])]
    rows, raws = [], [t.encode() for part in texts for t in part]
    for part in texts:
        held = {}
        for t in part:
            raw = t.encode()
            a = raw.index(passage.encode()[80:])
            held.setdefault((raw[a : a + LENGTH], raw[max(0, a - LENGTH + repeats.GRAM) : a][::-1]), []).append((raws.index(raw), 0, a))
        rows += [row for batch in repeats.sent({0: held}) for row in batch.to_pylist()]
    got = {(s["d1"], s["begin"], s["end"]) for batch in repeats.spans_of(rows, LENGTH) for s in batch.to_pylist()}
    for i, raw in enumerate(raws):
        if raws.index(raw) == i:
            a = raw.index(passage.encode()[80:])
            windows = [p for p in range(max(0, a - LENGTH + repeats.GRAM), a + 1) if p + LENGTH <= len(raw)]
            many = {p for p in windows if sum(raw[p : p + LENGTH] in x for x in raws) > 1}
            assert many == {p for p in windows if any(d == i and b <= p and p + LENGTH <= e for d, b, e in got)}


def test_both_ways_of_comparing_contexts_agree(monkeypatch):
    for seed in range(30):
        r = random.Random(seed)
        some = lambda: "".join(r.choices("ab", (9, 1), k=r.randint(0, LENGTH))).encode()
        contexts = sorted({(b"x" * repeats.GRAM + some()[: LENGTH - repeats.GRAM], some()[: LENGTH - repeats.GRAM]) for _ in range(r.randint(1, 40))}, key=lambda c: c[0] + repeats.END + c[1])
        order = sorted(range(len(contexts)), key=lambda i: contexts[i][1])
        near = lambda x: np.array([0] + [repeats.common(a, b) for a, b in zip(x, x[1:], strict=False)])
        given = (np.array([len(a) for a, _ in contexts]), np.array([len(b) for _, b in contexts]), near([a for a, _ in contexts]), near([contexts[i][1] for i in order]), np.array(order))
        many = np.array([r.random() < 0.2 for _ in contexts])
        marks = []
        for paired in (0, 256):
            monkeypatch.setattr(repeats, "PAIRED", paired)
            rows = repeats.repeated_ranges(*given, many, LENGTH).tolist()
            marks.append({(i, s) for i, low, high in rows for s in range(low, high + 1)})
        brute = {
            (i, s) for i, (a, b) in enumerate(contexts) for s in range(LENGTH - repeats.GRAM + 1) if len(a) >= LENGTH - s and len(b) >= s
            and (many[i] or any(j != i and x[: LENGTH - s] == a[: LENGTH - s] and len(x) >= LENGTH - s and y[:s] == b[:s] and len(y) >= s for j, (x, y) in enumerate(contexts)))
        }
        assert marks[0] == marks[1] == brute


def long_corpus(seed):
    """Passages of 400 bytes and more at starts, middles and ends of texts, with NUL bytes, cut copies and a periodic text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghé\0", k=r.randint(1, 9)))
    passages = [" ".join(word() for _ in range(r.randint(90, 160))) for _ in range(5)]
    texts = [None, "", "z" * 3000, "ab" * 900]
    for _ in range(120):
        p = r.choice(passages)
        cut = p[r.randint(0, 30) : len(p) - r.randint(0, 60)]
        texts.append(r.choice(["", word(), word() + " " + word()]) + cut + r.choice(["", "\n" + word(), word()]))
    return texts + texts[4:14]


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_whole_length_over_several_tasks(spark, parts):
    texts = long_corpus(parts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs, 400).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 400)


def test_repeated_rows_null_ids_and_a_long_periodic_text(spark):
    rows = [(None, "q" * 60), (None, "q" * 60), (7, "w" * 60), (7, "w" * 60), (8, "k" * 300_000)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), LENGTH).collect())
    assert got == [(0, 60, 60), (0, 60, 60), (7, 60, 60), (7, 60, 60), (8, 300_000, 300_000)]
