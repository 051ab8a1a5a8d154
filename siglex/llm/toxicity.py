"""Operator 6: character n-gram linear classifier with naive Bayes scaling.

Features are the distinct hashed character n-grams of a text. Each is scaled by
the log-count ratio of the naive Bayes model of the training labels, and a
logistic regression is trained on the scaled features. Counting and feature
extraction run on Spark over a bounded, documented sample of labelled rows;
the model is two arrays of fixed size; every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglex.llm.arrow_text import LOWER, distinct, map_arrow, owner, packed, runs
from siglex.llm.scratch import written

GRAMS = (3, 4, 5, 6)
BITS = 21
BLOCK = 1 << 15
SAMPLE_TASKS = 12  # the sample is bounded; each task counts it in arrays of fixed size


@dataclass(frozen=True)
class Model:
    """Sparse weights: ``weight[slot[hash]]``; slot 0 is no feature."""

    slot: np.ndarray  # int16 of 2**BITS
    weight: np.ndarray
    bias: float


def held_out(doc_id: Column) -> Column:
    """Remainder 0 of the crc32 of the id as text; a null id is as the empty text, so held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def grams(starts: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, buckets at every place) of the n-grams of the lower-cased bytes."""
    eight = packed(LOWER[data], 8)
    for n in GRAMS:
        if len(data) >= n:
            value = eight[: len(data) - n + 1] & np.uint64((1 << (8 * n)) - 1)
            value += np.uint64(n << 56)
            value *= np.uint64(0x9E3779B97F4A7C15)
            value >>= np.uint64(64 - BITS)
            yield n, value.view(np.int64)


def _rows(starts: np.ndarray, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, whether the n-gram stays inside it) of n-grams at places ``at``."""
    row = np.searchsorted(starts, at, "right") - 1
    return row, at + n <= starts[row + 1]


def distinct_grams(starts: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, row = [], owner(starts)
    for n, bucket in grams(starts, data):
        own = row[: len(bucket)]
        inside = own == row[n - 1 :]
        keys.append((own[inside] << BITS) | bucket[inside])
    both = distinct(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


def training_sample(docs: DataFrame, labels: DataFrame, rows_per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """Labelled, not held-out documents: at most ``rows_per_class`` of each class, by the hash of doc_id.

    Also the number of such labelled rows of each class, for the prior. Rows
    with a null id or label are left out; several labels of an id count as
    toxic if one does. The sample is bounded, so it is broadcast to the texts.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y")).where("y in (0, 1)")
    counts = dict(known.groupBy("y").count().collect())
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("y", "text")
    return written(rows.repartition(SAMPLE_TASKS), "toxicity-sample"), counts


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = 4000, features: int = 4096) -> Model:
    """The model of a bounded sample; with one class or none, a constant score of the share of label 1."""
    sample, counts = training_sample(docs, labels, rows_per_class)
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    prior = float(np.log(share / (1 - share)))
    constant = Model(np.zeros(1 << BITS, np.int16), np.zeros(1), prior)
    if not counts.get(0) or not counts.get(1):
        return constant

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int32)
        for batch in batches:
            y = batch.column(0).to_numpy()
            for first, starts, data in runs(batch.column(1)):
                own = y[first : first + len(starts) - 1]
                row, bucket = distinct_grams(starts, data)
                for c in (0, 1):
                    np.add.at(seen[c], bucket[own[row] == c], 1)
            n += np.bincount(y, minlength=2).astype(np.int32)
        if n.any():
            blocks = [(c, b, seen[c, b * BLOCK : (b + 1) * BLOCK].tobytes()) for c in (0, 1) for b in range((1 << BITS) // BLOCK)]
            blocks += [(c, -1, n[c : c + 1].tobytes()) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*blocks, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["y", "block", "counts"])

    def summed(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int32) for x in table.column("counts").to_pylist())
        return pa.table({"y": table.column("y")[:1], "block": table.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "y int, block int, counts binary"
    seen, n = np.zeros((2, 1 << BITS)), np.zeros(2)
    for r in map_arrow(sample, counted, schema).groupBy("y", "block").applyInArrow(summed, schema).collect():
        own = np.frombuffer(r.counts, np.int32)
        if r.block < 0:
            n[r.y] = own[0]
        else:
            seen[r.y, r.block * BLOCK : (r.block + 1) * BLOCK] = own
    if not n.all():
        return constant
    rate = (seen + 0.5) / (n[:, None] + 1)
    ratio = np.log(rate[1] / rate[0])
    both = seen.sum(0) / n.sum()
    z = np.abs(seen[1] / n[1] - seen[0] / n[0]) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n[0] + 1 / n[1]))
    z[seen.sum(0) < 2] = 0
    best = np.argsort(-z, kind="stable")[:features]
    best = best[z[best] > 2]
    slot = np.zeros(1 << BITS, np.int16)
    slot[best] = np.arange(1, len(best) + 1)
    if not len(best):
        return constant
    taken = sample.sparkSession.sparkContext.broadcast(slot)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, starts, data in runs(batch.column(1)):
                row, own = _hits(taken.value, starts, data)
                cut = np.searchsorted(row, np.arange(len(starts)))
                out += [own[cut[i] : cut[i + 1]].astype(np.int16).tobytes() for i in range(len(starts) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["y", "own"])

    rows = map_arrow(sample, extracted, "y int, own binary").collect()  # at most 2 * rows_per_class rows of 2 * features bytes
    own = [np.frombuffer(r.own, np.int16).astype(np.int64) for r in rows]
    y = np.array([r.y for r in rows], float)
    scale = np.concatenate([[0.0], ratio[best]])
    weight, bias = _logistic(own, y, scale, np.array([counts[0], counts[1]]) / n)
    return Model(slot, weight * scale, bias)


def _logistic(own: list[np.ndarray], y: np.ndarray, scale: np.ndarray, importance: np.ndarray, l2: float = 2e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over all rows; ``importance`` restores the classes' shares."""
    col = np.concatenate(own) if own else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    value = scale[col]
    c = importance[y.astype(int)]
    c = c / c.sum()
    w, b = np.zeros(len(scale)), 0.0
    m, v = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for t in range(1, steps + 1):
        s = np.bincount(row, value * w[col], len(own)) + b
        g = c * (1 / (1 + np.exp(-np.clip(s, -40, 40))) - y)
        grad = np.append(np.bincount(col, value * g[row], len(scale)) + l2 * w / len(scale) ** 0.5, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _hits(slot: np.ndarray, starts: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature), ordered, of the features that occur."""
    keys = []
    for n, bucket in grams(starts, data):
        f = slot[bucket]
        at = np.flatnonzero(f)
        row, inside = _rows(starts, n, at)
        keys.append((row[inside] << 16) | f[at[inside]])
    both = distinct(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return both >> 16, both & 0xFFFF


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score in 0..1 of every row of ``docs``, over its whole text; null texts are empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            s = np.zeros(batch.num_rows)
            for first, starts, data in runs(batch.column(1)):
                row, f = _hits(m.slot, starts, data)
                s[first : first + len(starts) - 1] = np.bincount(row, m.weight[f], len(starts) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(s + m.bias, -40, 40))))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), scored, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, rows_per_class: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Labels are learnt only from rows that are not held out; label, language,
    source and id are no inputs of a score. Null and empty texts get the bias
    alone. Repeated rows get equal scores; an empty table gives an empty
    result. Other columns are not read.
    """
    model = train(docs, labels, rows_per_class)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, rows_per_class: int = 4000) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below 0.5.

    Null and empty texts have the score of the bias alone. Equal texts, repeated
    rows among them, stay or go together; null ids count like others. An empty
    table gives an empty result; without labels of both classes the score is the
    share of label 1, so all rows stay unless most labels are toxic.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows_per_class))
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for first, starts, data in runs(batch.column(at)):
                row, f = _hits(m.slot, starts, data)
                keep[first : first + len(starts) - 1] = np.bincount(row, m.weight[f], len(starts) - 1) + m.bias < 0
            yield batch.filter(pa.array(keep))

    return map_arrow(docs, kept, docs.schema)
