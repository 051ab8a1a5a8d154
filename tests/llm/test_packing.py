import pytest
from pyspark.sql import functions as F

from siglex.llm import packing

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def test_chunked_ids_are_the_tokenizers_ids():
    path = public.path("word_bpe_49k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    texts = ["", "Hello,  World!\n\tDon't", "É è 123 ½ á  x y", "<|endoftext|> ok", "x" * 300, "a\x1cb\x85c", "!!! &&&a*** b", "ÀÉÿß÷×µªº don'T we'LL 4²x", "<|ENDOFTEXT|>a<|endoftext|>"]
    texts += ["".join(chr(c) for c in (a, b, 101, a)) for a in (39, 65, 223, 247, 304, 769) for b in range(33, 600)]
    got = packing.ChunkTokenizer(path).ids(texts)
    import numpy as np

    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_plan_places_every_piece_once():
    histogram = {7: 5, 5: 9, 3: 11, 2: 4, 1: 13, 10: 2}
    seen, used = {}, {}
    for length, rank, n, first, offset in packing.plan(histogram, 10):
        for k in range(n):
            assert seen.setdefault((length, rank + k), True) is True
            used.setdefault(first + k, []).append((offset, length))
    assert len(seen) == sum(histogram.values())
    for slots in used.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= 10
    assert len(used) <= -(-sum(k * v for k, v in histogram.items()) // 10) + 1


def test_pack_nulls_and_empty_table(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a b c", 5), (2, "", 5)], "doc_id long, text string, length int")
    rows = packing.pack(docs, public.path("word_bpe_49k.json"), 4).collect()
    assert sorted(r["length"] for r in rows) == [1, 1, 1, 4]
    assert packing.pack(docs.where(F.lit(False)), public.path("word_bpe_49k.json"), 4).count() == 0


def test_odd_chunks_amid_plain_words_keep_their_places():
    import random

    import numpy as np

    r = random.Random(3)
    whole = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    parts = ["The", "don't", "ÀÉß.", "x’s", "“q”", "日本語", "é", "<|endoftext|>", "a<|startoftext|>b", "\x1c", "\xa0", "I'LL've", "''", "12½", " ", "", "zzz" * 20, "ª", "İ", "Σς", "|"]
    texts = ["".join(r.choice(parts) + r.choice([" ", "\n", "\t", "\r", "  ", ""]) for _ in range(r.randint(0, 30))) for _ in range(400)]
    got = packing.ChunkTokenizer(public.path("word_bpe_49k.json")).ids(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_met_again_and_again_goes_to_the_model_once(monkeypatch):
    monkeypatch.setattr(packing, "_memory", {})
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    tokenizer = packing.ChunkTokenizer(public.path("word_bpe_49k.json"))
    words, asked = tokenizer.known.words, []

    class Model:
        def tokenize(self, word, model=words.model):
            asked.append(word)
            return model.tokenize(word)

    words.model = Model()
    new = ["".join(chr(97 + (k // 26**i) % 26) for i in range(3)) for k in range(200)]
    tokenizer.ids([f"{w} often, Often; (often)" for w in new])
    assert asked.count("often") == 1
    assert len(words) <= 10 and len(words.earlier) <= 10
