"""Features keyed by content, annotated spans, and curves over many units."""

import random
from collections import Counter
from datetime import datetime, timedelta

from siglex.operators import signals, stats
from siglex.plans import registry
from siglex.sources import tables


def test_a_changed_row_makes_new_features(spark, tmp_path):
    rows = [(k, f"v{k}", [float(k)]) for k in range(50)]
    kinds = "k int, s string, a array<double>"
    one = spark.createDataFrame(rows, kinds).repartition(4)
    same = spark.createDataFrame(rows[::-1], kinds).repartition(2).select("a", "k", "s")
    other = spark.createDataFrame([*rows[:-1], (49, "v49", [49.5])], kinds)
    assert tables.content_digest(one) == tables.content_digest(same) != tables.content_digest(other)
    assert tables.content_digest(one.union(one)) != tables.content_digest(one) != tables.content_digest(one.limit(0))
    made = []

    def features(of):
        made.append(of)
        return of.groupBy().count()

    sizes = [tables.materialised(spark, str(tmp_path), {"bins": 4}, lambda d=d: features(d), (d,)).first()[0] for d in (one, same, other, one.union(one), one)]
    assert sizes == [50, 50, 50, 100, 50] and len(made) == 3
    assert len([p for p in tmp_path.iterdir() if p.is_dir()]) == 3  # nothing is left aside


def test_span_chunks(spark):
    t0 = datetime(2024, 1, 1)
    at = lambda s: t0 + timedelta(seconds=s)
    spans = [("u", at(5), at(70), "a"), ("u", at(50), at(111), "b"), ("u", at(0), at(29), "short"), ("w", at(0), at(30), "a"), ("u", at(5), None, "open")]
    samples = [("u", at(s), float(s)) for s in range(0, 140, 3)] + [("w", at(29), 1.0), ("w", at(30), 2.0), ("x", at(1), 3.0), ("u", None, 4.0)]
    got = signals.span_chunks(spark.createDataFrame(samples, "subject string, ts timestamp, x double"), spark.createDataFrame(spans, "subject string, start timestamp, end timestamp, label string"), 30)
    want = sorted((s, x, label, k) for s, ts, x in samples if ts for o, a, b, label in spans if o == s and b for k in range(int((b - a).total_seconds()) // 30) if a + timedelta(seconds=30 * k) <= ts < a + timedelta(seconds=30 * k + 30))
    assert sorted((r.subject, r.x, r.label, r.chunk) for r in got.collect()) == want and {w[2] for w in want} == {"a", "b"}


def test_heaps_curve_is_cut_to_its_points(spark):
    r = random.Random(1)
    rows = [(u, min(99, int(r.expovariate(0.1)))) for u in range(300) for _ in range(r.randint(1, 4))]
    got = stats.heaps(spark.createDataFrame(rows, "u int, tok int").repartition(5), "u", 40).orderBy("u").collect()
    assert len(got) == 40 and got[-1].u == 299
    for x in got:
        seen = [tok for u, tok in rows if u <= x.u]
        assert (x.n_tokens, x.n_unique) == (len(seen), len(set(seen)))


def test_heaps_curve_has_every_unit(spark, tmp_path):
    r = random.Random(2)
    rows = [(u, min(99, int(r.expovariate(0.1)))) for u in range(300) for _ in range(r.randint(1, 4))]
    got = stats.heaps(spark.createDataFrame(rows, "u int, tok int").repartition(5), "u").orderBy("u").collect()
    sizes, seen = Counter(u for u, _ in rows), [set(tok for v, tok in rows if v <= u) for u in range(300)]
    assert [tuple(x) for x in got] == [(u, sum(sizes[v] for v in range(u + 1)), len(seen[u])) for u in range(300)]
    texts = [(u, "ab" + chr(97 + u % 26), "x", "y") for u in range(450)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    curve = registry.queries()["heaps_curve"](spark, str(tmp_path)).orderBy("trial").collect()
    assert [tuple(x) for x in curve] == [(u, 3 * u + 3, min(26, max(2, u + 1))) for u in range(450)]
