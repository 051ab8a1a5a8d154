"""Operator 7: best-fit packing planned over the histogram of lengths.

Documents are tokenised once and cut into pieces; only the histogram of piece
lengths (at most ``capacity`` counts) reaches the driver. Best-fit decreasing
runs over counts and gives a plan of slots: so many sequences, from such a
number on, take pieces of a length at an offset. Pieces take planned slots by
their rank within their length.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siglex.llm.arrow_text import map_arrow
from siglex.llm.scratch import partitions, written

#: Words of late, words before these, and odd chunks (runs between blanks) that a worker remembers the ids of, each.
REMEMBERED = 100_000
LONGEST_REMEMBERED = 40

#: All but blanks and the characters on which Python's and the tokeniser's letters, digits and lower case agree: printable ASCII and Latin-1 letters.
_ODD = "[^ -~À-ÖØ-öø-ÿ]"
_WORDS = re.compile("[a-zß-öø-ÿ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^ a-zß-öø-ÿ0-9]+")

#: The steps of a tokeniser file for which ``_WORDS`` is the cut.
_STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)

_memory: dict[str, TextIds] = {}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """Word in lower case -> little-endian unsigned 32-bit ids, by the tokeniser's own model.

    Once full, these words become the earlier ones, and those met again come back.
    """

    def __init__(self, tokenizer: Tokenizer) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.model, self.letters, self.earlier = tokenizer.model, {}, {}
        alphabet = ByteLevel(add_prefix_space=False, use_regex=False)
        for tail in range(0x80, 0xC0):  # UTF-8 of the Latin-1 letters; bytes of ASCII stand for themselves
            self.letters[0xC3], self.letters[tail] = alphabet.pre_tokenize_str(bytes((0xC3, tail)).decode())[0][0]

    def __missing__(self, word: str) -> bytes:
        ids = self.earlier.get(word)
        if ids is None:
            ids = _packed([t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))])
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.earlier = self.copy()
                self.clear()
            self[word] = ids
        return ids


class ChunkIds(dict):
    """Chunk -> ids by the whole tokeniser."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, chunk: str) -> bytes:
        ids = _packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        if len(chunk) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = ids
        return ids


class TextIds:
    """Text -> ids; stretches of plain chunks are cut into words here, all other chunks go through the whole tokeniser.

    The cut is that of ``_STEPS``; with a tokeniser of other steps no chunk is
    plain. Chunks that hold a special token are not plain either.
    """

    def __init__(self, tokenizer: Tokenizer) -> None:
        steps = json.loads(tokenizer.to_str())
        self.chunks, self.words = ChunkIds(tokenizer), WordIds(tokenizer) if steps["normalizer"] == _STEPS[0] and steps["pre_tokenizer"] == _STEPS[1] else None
        self.special = [t["content"] for t in steps["added_tokens"]]
        self.odd, self.odd_or_special = re.compile(_ODD), re.compile("|".join([_ODD, *map(re.escape, self.special)]))

    def __call__(self, text: str) -> bytes:
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        chunk, word = self.chunks.__getitem__, self.words.__getitem__ if self.words is not None else None
        if word is None:
            return b"".join(map(chunk, text.split(" ")))
        out, at = [], 0
        odd = self.odd_or_special if any(x in text for x in self.special) else self.odd
        for found in odd.finditer(text):
            if found.start() >= at:
                begin, end = max(at, text.rfind(" ", at, found.start()) + 1), text.find(" ", found.end())
                out += map(word, _WORDS.findall(text[at:begin].lower()))
                at = len(text) if end < 0 else end
                out.append(chunk(text[begin:at]))
        out += map(word, _WORDS.findall(text[at:].lower()))
        return b"".join(out)


class ChunkTokenizer:
    """Token ids of whole texts, through memories of words and of white-space-separated chunks.

    The pre-tokeniser drops white space and never joins across it, so the ids
    of a text are those of its chunks in order. Chunks are cut at blank, tab and
    line ends only; any other white space stays inside a chunk, for the
    tokeniser to see.
    """

    def __init__(self, path: str) -> None:
        if path not in _memory:
            from tokenizers import Tokenizer

            _memory[path] = TextIds(Tokenizer.from_file(path))
        self.known = _memory[path]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [self.known(t) for t in texts]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Narrow rows (doc_id, piece, start, length, ids_crc32) of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = ChunkTokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = []
                for doc_id, ids in zip(part.column(0).to_pylist(), tokenizer.ids(pc.fill_null(part.column(1), "").to_pylist()), strict=True):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[a : a + 4 * capacity]
                        out.append((doc_id, k, a // 4, len(own) // 4, zlib.crc32(own)))
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (part.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, count, first sequence, offset) of best-fit decreasing over counts.

    Sequences that are filled alike are one entry (first, count) under their
    free room. A longest-first pass puts each length where least room is left.
    """
    rooms: list[int] = []  # free rooms, ascending
    entries: dict[int, list[tuple[int, int]]] = {}
    rows, n = [], 0

    def put(room: int, first: int, count: int) -> None:
        if count and room:
            if room not in entries:
                insort(rooms, room)
                entries[room] = []
            entries[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # open as many sequences as pieces of this length fill
                room, (first, count) = capacity, (n, -(-left // (capacity // length)))
                n += count
            else:
                room = rooms[at]
                first, count = entries[room].pop()
                if not entries[room]:
                    del entries[room], rooms[at]
            each = room // length
            full = min(count, left // each)
            for k in range(each if full else 0):
                rows.append((length, rank + k * full, full, first, capacity - room + k * length))
            put(room - each * length, first, full)
            rank, left = rank + each * full, left - each * full
            first, count = first + full, count - full
            if count and left:  # fewer than ``each`` pieces remain: one sequence takes them
                for k in range(left):
                    rows.append((length, rank + k, 1, first, capacity - room + k * length))
                put(room - left * length, first, 1)
                first, count, left = first + 1, count - 1, 0
            put(room, first, count)
    return rows


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``.

    Null and empty texts are documents of the end id alone. Repeated rows are
    packed each. An empty table gives an empty result. Other columns are not
    read. Ranks are dealt within (length, salt) and shifted by the counts of the
    salts before, so a length that very many pieces have is ranked by many tasks.
    """
    spark = docs.sparkSession
    rows = written(pieces(docs, tokenizer_path, capacity), "pieces")
    salts = min(1024, partitions(spark))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = rows.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))  # capacity * salts rows at most
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    planned = plan(histogram, capacity)
    schema = "length long, first_rank long, n long, first_sequence long, offset long"
    slots = spark.createDataFrame(planned, schema)
    if len(planned) <= 200_000:  # 40 bytes each
        slots = F.broadcast(slots)
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")
    ranked = rows.withColumn("nth", F.row_number().over(within)).join(shifts, ["length", "salt"]).withColumn("rank", F.col("nth") - 1 + F.col("shift"))
    fits = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    return (
        ranked.join(slots.withColumnRenamed("length", "of"), (F.col("length") == F.col("of")) & fits)
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")
    )
