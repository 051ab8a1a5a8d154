import hashlib
import re
import zlib

from pyspark.sql import functions as F

from siglex.llm import decontamination, fingerprints, line_dedup, queries, secrets, sharding


def test_shards_are_a_permutation(spark):
    for n in (1, 2, 3, 23, 25, 100):
        x = spark.range(n).select(sharding.feistel(F.col("id"), n, 5).alias("p"))
        assert sorted(r.p for r in x.collect()) == list(range(n))
    docs = spark.createDataFrame([(k % 40 if k % 7 else None, None if k % 11 == 0 else f"té{k}", k) for k in range(101)], "doc_id long, text string, shard int")
    rows = sharding.feistel_shards(docs, 6).collect()
    for s in range(6):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (16, 17)
    assert sorted(r.text_crc32 for r in rows) == sorted(zlib.crc32((r.text or "").encode()) for r in docs.collect())
    assert sharding.feistel_shards(docs.where(F.lit(False)), 6).count() == 0


def test_lines_of_several_documents_go(spark):
    texts = ["Foo \nbar\n\nbaz", "foo\nqux", " FOO\n\nÉ", None, "", "x\n" * 200 + "foo", "foo"]
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)] + [(6, "foo", "c")], "doc_id long, text string, bitmap string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs, min_documents=4).collect()}
    assert got[0] == (4, 1, "bar\n\nbaz") and got[2] == (3, 1, "\nÉ") and got[3] == got[4] == (1, 0, "")
    assert got[5] == (202 - 1, 1, "\n".join(["x"] * 200)) and got[6] == (1, 1, "")
    first = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, min_documents=2, keep_first=True).collect()}
    assert first[0].startswith("Foo") and first[1] == "qux"
    assert line_dedup.without_repeated_lines(docs.where(F.lit(False))).count() == 0


def test_secrets_against_the_patterns(spark):
    key = "aB3xK9pQ7mZ2vL8wR5tY1nC6"
    texts = [f"é password = 'hunter22' x token:abc {key}", "AKIA" + "A1B2" * 4, "0" * 23 + " " + "a1" * 12, None, "", "secret=token=abcdefg", "id 550e8400-e29b-41d4-a716-446655440000"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_hex int")
    got = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    for k, t in enumerate(texts):
        base = []
        for kind, pattern, group, least in (("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)):
            base += [(m.start(), kind, m.end()) for m in re.finditer(pattern, t or "") if len(m[group]) >= least]
        order = ("assign", "access", "hex")
        said = ",".join(f"{kind}:{a}:{b}" for a, kind, b in sorted(base, key=lambda x: (x[0], order.index(x[1]))))
        assert got[k].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert "entropy_base64" in got[0].spans and got[6].spans == ""


def test_fingerprints_follow_the_next_document(spark):
    texts = {1: "Alpha  beta", 2: "alpha BETA", 5: None, 7: "ﬁn é", 9: "x"}
    docs = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, k int").repartition(3)
    for bits in (128, 1):
        got = {r.doc_id: r for r in fingerprints.fingerprints(docs, bits).collect()}
        ids = sorted(texts)
        for k, nxt in zip(ids, [*ids[1:], ids[0]], strict=True):
            t, u = texts[k] or "", texts[nxt] or ""
            h = len(t) // 2
            assert got[k].edited_sha256 == hashlib.sha256((t[: len(t) - h] + u[:h]).encode()).hexdigest() and got[k].n_chars == len(t)
        assert got[1].near_next == 1.0 and got[2].near_next == 0.0
        assert got[1].fingerprint == got[2].fingerprint and len({r.fingerprint for r in got.values()}) == 4


def test_reparameterised_leaks_and_clean_documents(spark):
    item = "If Mary buys 12 apples and later Mary sells 5 apples how many apples are left over"
    docs = [(1, "Some words before. If Anna buys 31 apples and later Anna sells 7 apples how many apples are left over? yes"), (2, "nothing to see here at all, truly nothing that repeats any of it"), (3, None), (4, ""), (5, item.lower())]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, window int")
    b = spark.createDataFrame([(10, item), (11, "too short"), (12, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontamination.leaks(d, b).collect()}
    assert (1, 10) in got and not got[(1, 10)] and not {2, 3, 4} & {k for k, _ in got}
    assert sorted(r.doc_id for r in decontamination.without_leaks(d.where("doc_id < 5"), b).collect()) == [2, 3, 4]
    assert decontamination.leaks(d, b.where(F.lit(False))).count() == 0


def _leaks(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontamination.leaks(d, b).collect()}


def test_one_changed_slot_costs_only_its_windows(spark):
    item = "if a train leaves at 3 and moves along the long green valley for a while and then it waits until 3 before it goes on through the hills and the woods to the far sea"
    got = _leaks(spark, [f"So: {item.replace('until 3', 'until 4')}", f"So: {item}", "if 5 or 6 in one of these"], [item, "if 3 or 3 in one of these"])
    assert set(got) == {(0, 0), (1, 0)}
    assert got[(1, 0)].coverage == 1 and got[(1, 0)].verbatim
    assert not got[(0, 0)].verbatim and got[(0, 0)].n_windows >= got[(1, 0)].n_windows - 8


def test_verbatim_copies_of_any_passage(spark):
    items = ["What is the capital of France?", "Anna Berta Carla Dora Emma Frida Gerda Hanna Ida", "12 7 9 31 44 8 15 16 23 42", "Blue whale", "Zygote", "?!"]
    docs = [f"Quiz\n{x}" for x in items] + ["see (blue  WHALE). Then", "Quiz\nWhat is the capital of Spain?", "Quiz\nWho is the capital of France?", "blue sky and whale", "12 7 9 31 44 8 15 16 24 42 12 7 9"]
    got = _leaks(spark, docs, items)
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (6, 3), (7, 0), (10, 2)}
    assert all(got[(k, k)].verbatim and got[(k, k)].coverage == 1 for k in range(5)) and not got[(7, 0)].verbatim
    assert _leaks(spark, ["one Zygote"], ["Zygote", "?!"]).keys() == {(0, 0)}
    middle = "then they found out that in the end Mary had the keys to every door of the house"
    assert _leaks(spark, ["Yes. Mary had the keys to every door of"], [middle]).keys() == {(0, 0)}


def test_shards_keep_the_column_size(spark, tmp_path):
    spark.createDataFrame([(1, "té"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op2_feistel_shards(spark, str(tmp_path))
    assert dict(rows.dtypes)["size"] == "bigint" and {r.doc_id: r["size"] for r in rows.collect()} == {1: 11, 2: 8}  # 8 besides the bytes of the text
