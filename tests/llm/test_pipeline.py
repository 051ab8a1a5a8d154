"""The stages of the pipeline, each on the rows that the one before kept.

Line dedup, n-gram join and packing against plain Python; the toxicity stage
against the operator's predictions; decontamination by conditions that must hold.
"""

import os
import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from siglex.llm import toxicity
from tests.llm.test_ngram_join import brute

DATA = "/root/testdata/sf0.001"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def without_common_lines(texts):
    split = {k: (t or "").split("\n") for k, t in texts.items()}
    found = Counter(x for lines in split.values() for x in {key(y) for y in lines})
    return {k: "\n".join(x for x in lines if not (key(x) and found[key(x)] >= 10)) for k, lines in split.items()}


def first_of_each(texts):
    ids = sorted(texts)
    return {ids[i] for i, (_, least) in enumerate(brute([texts[k] for k in ids])) if least == i}


def test_stages_against_plain_python(spark, tmp_path):
    tables = {"in": spark.read.parquet(f"{DATA}/documents.parquet")}
    docs, columns = tables["in"], tables["in"].columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        tables[name] = docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "best_fit_packing"]
    assert all(tables[n].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])
    texts = {n: {r.doc_id: r.text for r in t.select("doc_id", "text").collect()} for n, t in tables.items() if n != "best_fit_packing"}

    scores = toxicity.toxicity(tables["in"], spark.read.parquet(f"{DATA}/labels.parquet")).collect()
    clean = {r.doc_id for r in scores if r.predicted == 0}
    assert texts["toxicity"] == {k: t for k, t in texts["in"].items() if k in clean}

    assert texts["line_dedup"] == without_common_lines(texts["toxicity"])

    assert set(texts["ngram_join"]) == first_of_each(texts["line_dedup"])
    assert texts["ngram_join"].items() <= texts["line_dedup"].items()

    assert texts["decontamination"].items() <= texts["ngram_join"].items()
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if r.text]
    holds = {k for k, t in texts["ngram_join"].items() if any(len(x.split()) >= 8 and x in " ".join((t or "").lower().split()) for x in items)}
    assert holds and not holds & set(texts["decontamination"])
    parts = {" ".join(x.split()[i : i + 5]) for x in items for i in range(len(x.split()) - 4)}
    for k in set(texts["ngram_join"]) - set(texts["decontamination"]) - holds:  # none goes that has nothing of an item
        w = texts["ngram_join"][k].lower().split()
        assert any(" ".join(w[i : i + 5]) in parts for i in range(len(w) - 4))

    import tokenizers

    from siglex.llm.queries import tokenizer_path

    whole = tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    wanted = {k: len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in texts["decontamination"].items()}
    pieces, got = defaultdict(list), Counter()
    for r in docs.collect():
        got[r.doc_id] += r["length"]
        pieces[r.sequence_id].append((r.offset, r["length"]))
    assert got == wanted
    for held in pieces.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(pieces) <= -(-sum(wanted.values()) // 2048) + 1


def test_nulls_ties_repeated_rows_and_clashing_columns(spark, tmp_path):
    r = random.Random(5)
    text = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))
    near = text(60)
    rows = [(1, near), (2, near + " ending"), (2, near + " ending"), (3, None), (3, None), (4, ""), (None, text(30)), (5, text(6000)), (6, " \n\t"), (None, near)]
    rows += [(10 + k, f"Shared line of ten\n{text(12)}") for k in range(10)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, component long, d1 long, salt int, line string"
    docs = spark.createDataFrame([(i, t, "xx", "s", None if t is None else len(t), "r", 0.1, 7, 8, 9, "l") for i, t in rows], schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        before = Counter((q.doc_id, q.text) for q in docs.select("doc_id", "text").collect())
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "best_fit_packing":
            pieces = Counter(q.doc_id for q in docs.where("piece = 0").collect())
            assert pieces == Counter(k for (k, _), n in before.items() for _ in range(n))
            break
        assert docs.columns == schema.replace(",", "").split()[::2]
        after = Counter((q.doc_id, q.text) for q in docs.select("doc_id", "text").collect())
        if name == "line_dedup":
            assert sum(after.values()) == sum(before.values()) and not any("Shared" in (t or "") for _, t in after)
            assert after[3, None] == before[3, None] and after[4, ""] == before[4, ""]
        if name == "ngram_join":
            held = [(k, t) for k, t in before if t and near in t]
            assert [p for p in after if p in held] == ([min(held, key=lambda p: (p[0] is None, p[0]))] if held else [])
            assert all(after[p] == (before[p] if not (p[1] or "").split() else 1) for p in set(before) - set(held))
        if name == "decontamination":
            assert after == before


def test_an_empty_table_stays_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0
