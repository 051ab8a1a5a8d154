"""Operator 10: exact fingerprints of canonical texts.

A text is canonicalised (NFKC, case folding, white space to single blanks) and
its fingerprint is the 128-bit xxhash of the canonical bytes. Buckets of equal
digests with two rows or more are checked byte by byte, as the least and the
greatest canonical text of the bucket, which Spark combines map-side, so that
no bucket is gathered; digests that fail are extended by a SHA-256.
"""

from __future__ import annotations

import hashlib
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglex.llm.arrow_text import has_bits, map_arrow
from siglex.llm.scratch import bit_table, partitions, written

TABLE_BITS = 23
LEAST = -(1 << 63)  # stands for a null doc_id in the order of documents


def canonical(text: str) -> bytes:
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def _digest(canon: bytes, bits: int) -> int:
    return xxhash.xxh3_128_intdigest(canon) >> (128 - bits)


def _hex(digest: int) -> str:
    return f"{digest:032x}"


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _texts(batch: pa.RecordBatch) -> list[str]:
    return pc.fill_null(batch.column(1), "").to_pylist()


def digests(docs: DataFrame, bits: int = 128) -> DataFrame:
    """Narrow rows (k, tie, digest, low) of all documents: order key, tie-breaker, digest, its low 64 bits."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            each = [_digest(canonical(t), bits) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_tie(t) for t in texts], pa.int64()), pa.array([_hex(d) for d in each], pa.string()), pa.array([_signed(d) for d in each], pa.int64())],
                ["k", "tie", "digest", "low"],
            )

    return map_arrow(docs.select(F.coalesce("doc_id", F.lit(LEAST)).cast("long").alias("k"), "text"), made, "k long, tie long, digest string, low long")


def _tie(text: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(text.encode()))


def colliding(docs: DataFrame, narrow: DataFrame, bits: int = 128) -> DataFrame:
    """Digests whose bucket holds canonical texts that differ in a byte.

    Only rows of buckets of two or more travel (a bit table of fixed size lets
    through all of these and few others).
    """
    several = narrow.groupBy("digest").agg(F.count("*").alias("n"), F.first("low").alias("low")).where("n > 1")
    table = docs.sparkSession.sparkContext.broadcast(bit_table(several, F.col("low"), TABLE_BITS))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, shrink = np.frombuffer(table.value, np.uint8), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            names, packs = [], []
            canons = [canonical(t) for t in _texts(batch)]
            each = [_digest(c, bits) for c in canons]
            lows = np.array([d & ((1 << 64) - 1) for d in each], np.uint64)
            for i in np.flatnonzero(has_bits(seen, lows)).tolist():
                names.append(_hex(each[i]))
                packs.append(shrink.compress(canons[i]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(packs, pa.binary())], ["digest", "canon"])

    rows = map_arrow(docs.select("doc_id", "text"), packed, "digest string, canon binary")
    return rows.groupBy("digest").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).where("a <> b").select("digest")


def fingerprints(docs: DataFrame, bits: int = 128) -> DataFrame:
    """Per row: doc_id, n_chars, fingerprint, and the same of an edited text and the next document.

    The edited text has its last half replaced by the head of the next document
    by doc_id (nulls first, ties by a hash of the text; after the last comes the
    first, so a single document follows itself). ``near_*`` is 1.0 where the
    canonical texts are byte for byte equal, else 0.0. Null texts are empty;
    repeated rows are rows like others; an empty table gives an empty result.
    Other columns are not read. ``bits`` < 128 is for tests of collisions.
    """
    spark = docs.sparkSession
    narrow = written(digests(docs, bits), "digests")
    clash = written(colliding(docs, narrow, bits), "colliding")
    n = 4 * partitions(spark)
    firsts = sorted(
        (r.at.k, r.at.tie)
        for r in narrow.repartitionByRange(n, "k", "tie").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("k", "tie")).alias("at")).collect()
    )

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for doc_id, text in zip(ids, _texts(batch), strict=True):
                key = (LEAST if doc_id is None else doc_id, _tie(text))
                at = max(bisect_right(firsts, key) - 1, 0)
                packed = shrink.compress(text.encode())
                out.append((at, 0, *key, doc_id, packed))
                if key == firsts[at]:  # the bucket before looks ahead to it
                    out.append(((at - 1) % len(firsts), 1, *key, doc_id, packed))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["bucket", "ahead", "k", "tie", "doc_id", "packed"])

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        held: tuple | None = None
        for batch in batches:
            out = []
            for bucket, ahead, doc_id, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "ahead", "doc_id", "packed")), strict=True):
                text = expand.decompress(packed).decode()
                row = (bucket, doc_id, text, canonical(text))
                if held is not None and held[0] == bucket:
                    out.append(_edited_row(held, row, bits))
                held = None if ahead else row
            cols = list(zip(*out, strict=True)) or [[]] * 9
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 5, pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], NAMES)

    blocks = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), dealt, "bucket int, ahead int, k long, tie long, doc_id long, packed binary")
    ordered = blocks.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "ahead", "k", "tie")
    rows = map_arrow(ordered, edited, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, canon_sha256 string, edited_canon_sha256 string, near_edited double, near_next double")
    if not clash.isEmpty():
        for name, more in (("fingerprint", "canon_sha256"), ("edited_fingerprint", "edited_canon_sha256")):
            bad = clash.select(F.col("digest").alias(name), F.lit(True).alias("bad"))
            rows = rows.join(bad, name, "left").withColumn(name, F.when(F.col("bad"), F.concat_ws("-", name, more)).otherwise(F.col(name))).drop("bad")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "canon_sha256", "edited_canon_sha256", "near_edited", "near_next"]


def _edited_row(held: tuple, following: tuple, bits: int) -> tuple:
    _, doc_id, text, canon = held
    half = len(text) // 2
    edited = text[: len(text) - half] + following[2][:half]
    other = canonical(edited)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(text), sha(edited.encode()), _hex(_digest(canon, bits)), _hex(_digest(other, bits)), sha(canon), sha(other), float(canon == other), float(canon == following[3]))
