"""Training of byte-pair merges by count differences.

Sequences are held once each with a weight (how often they occur), dealt to
shards. The driver keeps the exact count of every pair, a square of the
vocabulary's size, and beside each pair the shards that hold it (one bit a shard). A
round plans the next merges from estimated counts, and one job over the shards
that hold a planned pair applies the plan step by step and sums by how much each
step changes each count. The driver then repeats the choice with exact counts and
keeps the steps that one-at-a-time training takes too; the first always is one of
them. Nothing is counted anew, and only every ``REWRITE`` merges are the
sequences written again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglex.operators import bpe
from siglex.sources import shared

Merges = list[tuple[int, int]]
REWRITE = 64  # merges after which sequences are written as they stand
SHARDS = 64  # bits of a long
LARGEST = 8192  # vocabulary; the driver holds three squares of it
CHUNK = 1 << 20  # tokens that a task works on at once
TOKENS = -1  # stands for both ids where the number of tokens changes


def places(seq: np.ndarray, left: int, right: int) -> np.ndarray:
    """Where a greedy pass from the left replaces the pair."""
    at = np.flatnonzero((seq[:-1] == left) & (seq[1:] == right))
    if left == right and len(at):
        run = np.cumsum(np.concatenate([[True], at[1:] != at[:-1] + 1])) - 1
        first = at[np.concatenate([[True], run[1:] != run[:-1]])]
        at = at[(at - first[run]) % 2 == 0]
    return at


def _pairs_at(seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those of the places where a pair starts, once each."""
    at = np.unique(at)
    at = at[(at >= 0) & (at < len(seq) - 1)]
    return at[(seq[at] >= 0) & (seq[at + 1] >= 0)]


def traced(seq: np.ndarray, weight: np.ndarray, plan: Merges, first: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(step, left, right, change of weight) of the pairs that each merge of a plan touches; the token count too, under ``TOKENS``.

    Separators are negative. Pairs that hold no replaced token are the same before and after.
    """
    for step, (left, right) in enumerate(plan):
        at = places(seq, left, right)
        if not len(at):
            continue
        old = _pairs_at(seq, np.concatenate([at - 1, at, at + 1]))
        yield step, seq[old], seq[old + 1], -weight[old]
        yield step, np.array([TOKENS]), np.array([TOKENS]), -weight[at].sum(keepdims=True)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq.copy()
        seq[at] = first + step
        seq, weight = seq[keep], weight[keep]
        new = at - np.arange(len(at))
        new = _pairs_at(seq, np.concatenate([new - 1, new]))
        yield step, seq[new], seq[new + 1], weight[new]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches (toks, w) as one run of tokens with -1 behind each sequence, and a weight a token."""
    tokens, weights, size = [], [], 0
    for batch in batches:
        offsets = np.asarray(batch.column(0).offsets).astype(np.int64)
        flat = np.asarray(batch.column(0).values)[offsets[0] : offsets[-1]].astype(np.int64)
        tokens.append(np.insert(flat, offsets[1:] - offsets[0], -1))
        weights.append(np.repeat(batch.column(1).to_numpy(), np.diff(offsets) + 1))
        size += len(tokens[-1])
        if size >= CHUNK:
            yield np.concatenate(tokens), np.concatenate(weights)
            tokens, weights, size = [], [], 0
    if tokens:
        yield np.concatenate(tokens), np.concatenate(weights)


def _merged(seq: np.ndarray, weight: np.ndarray, merges: Merges, base: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """A run of tokens after merges; weights are those of the sequences."""
    out = bpe.apply_merges(seq, merges, base, first)
    lengths = np.diff(np.concatenate([[-1], np.flatnonzero(out == -1)]))
    return out, np.repeat(weight[seq == -1], lengths)


def _changes(state: DataFrame, done: Merges, plan: Merges | None, base: int, first: int) -> DataFrame:
    """(step, l, r, n, shards): changes of every step of a plan after ``done``; without a plan, the counts themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, own = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal own
            for batch in batches:
                own |= int(np.bitwise_or.reduce(np.int64(1) << np.unique(batch.column(2).to_numpy()).astype(np.int64))) if batch.num_rows else 0
                yield batch

        for seq, weight in _chunks(watched()):
            seq, weight = _merged(seq, weight, done, base, first)
            if plan is None:
                at = _pairs_at(seq, np.arange(len(seq) - 1))
                parts = [(0, seq[at], seq[at + 1], weight[at]), (0, np.array([TOKENS]), np.array([TOKENS]), weight[seq >= 0].sum(keepdims=True))]
            else:
                parts = list(traced(seq, weight, plan, base + first + len(done)))
            if parts:
                more = np.concatenate([(np.int64(s) << 40) | ((l.astype(np.int64) + 1) << 20) | (r.astype(np.int64) + 1) for s, l, r, _ in parts])
                keys, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, *(w for *_, w in parts)])).astype(np.int64)
        low = (1 << 20) - 1
        split = [keys >> 40, ((keys >> 20) & low) - 1, (keys & low) - 1]
        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in split), pa.array(counts), pa.array(np.full(len(keys), own, np.int64))], ["step", "l", "r", "n", "shards"])

    rows = state.mapInArrow(run, "step int, l int, r int, n long, shards long")
    return rows.groupBy("step", "l", "r").agg(F.sum("n").alias("n"), F.bit_or("shards").alias("shards"))


class _State:
    """Weighted distinct sequences in shards, as one table of the shared folder that is replaced now and then."""

    def __init__(self, seqs: DataFrame):
        self.spark, self.first, self.place = seqs.sparkSession, 0, ""
        self.shards = min(SHARDS, max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        held = seqs.select(F.col("toks").cast("array<int>").alias("toks")).where("toks is not null").groupBy("toks").agg(F.count("*").alias("w"))
        self._write(held.repartition(self.shards).select("toks", "w", (F.spark_partition_id() % self.shards).alias("shard")))

    def _write(self, rows: DataFrame) -> None:
        old, self.place = self.place, shared.path(self.spark, "merge-state")
        rows.write.option("compression", "zstd").partitionBy("shard").parquet(self.place)
        if old:
            shared.removed(self.spark, old)

    def rows(self, mask: int | None = None) -> DataFrame:
        """Rows (toks, w, shard), of the shards in a mask only; other shards' files are not opened."""
        table = self.spark.read.schema("toks array<int>, w long, shard int").parquet(self.place)
        if mask is not None:
            table = table.where(F.col("shard").isin([k for k in range(self.shards) if mask >> k & 1]))
        return table.select("toks", "w", "shard")

    def advance(self, done: Merges, base: int) -> None:
        """Write the sequences as they are after merges that were found since the last time."""
        held = bpe.tokenise(self.rows(), done, base, self.first)
        self.first += len(done)
        self._write(held)

    def close(self) -> None:
        shared.removed(self.spark, self.place)


def _best(counts: np.ndarray, used: int, allowed: np.ndarray | None) -> tuple[int, int, float]:
    """The most frequent pair, the least (l, r) of equals."""
    part = counts[:used, :used]
    if allowed is not None:
        part = np.where(allowed[:used, :used], part, 0)
    l, r = divmod(int(part.argmax()), used)
    return l, r, part[l, r]


def planned(counts: np.ndarray, used: int, steps: int, allowed: Callable[[np.ndarray], np.ndarray | None]) -> Merges:
    """Merges in the order that greedy training would take if a pair's neighbours did not depend on it."""
    c, plan = counts.astype(np.float32), []
    for new in range(used, used + steps):
        left, right, n = _best(c, new, allowed(c))
        if n <= 1:
            break
        plan.append((left, right))
        outgoing, incoming = max(c[left, :new].sum(), 1), max(c[:new, right].sum(), 1)
        n = n * outgoing / (outgoing + n) if left == right else n
        before, behind = c[:new, left] * min(1, n / outgoing), c[right, :new] * min(1, n / incoming)
        before[right], behind[left] = (0, 0) if left == right else (before[right], behind[left])
        c[:new, new] += before
        c[:new, left] -= before
        c[new, :new] += behind
        c[right, :new] -= behind
        c[left, right] = max(0, c[left, right] - 2 * n) if left == right else 0
        np.maximum(c, 0, out=c)
    return plan


def scattered(counts: np.ndarray, used: int, steps: int) -> Merges:
    """Up to so many of the most frequent pairs, leaving out those that share a token with a taken one in the way that changes its count."""
    part = counts[:used, :used].ravel()
    order = np.lexsort((np.arange(len(part)), -part))
    lefts, rights, out = set(), set(), []
    for k in order.tolist():
        l, r = divmod(k, used)
        if len(out) == steps or part[k] <= 1:
            break
        if l not in rights and r not in lefts:
            out.append((l, r))
            lefts.add(l)
            rights.add(r)
    return out


def train(seqs: DataFrame, base: int, vocabulary: int, relaxed: int, selection: str, progress: list | None) -> Merges:
    """See ``bpe.train``."""
    if vocabulary > LARGEST:
        raise ValueError(f"a vocabulary of {vocabulary}: the driver counts pairs of at most {LARGEST} ids")
    state = _State(seqs)
    counts, holders = np.zeros((vocabulary, vocabulary), np.int64), np.zeros((vocabulary, vocabulary), np.int64)
    merges: Merges = []
    total, window = 0, 8

    def taken_in(rows: pa.Table, step: int, below: int) -> int:
        of = rows.filter(pc.equal(rows["step"], step))
        l, r, n, shards = (of[c].to_numpy() for c in ("l", "r", "n", "shards"))
        pair = l >= 0
        if pair.any() and max(l[pair].max(), r[pair].max()) >= below:
            raise ValueError(f"a token is not below {base}")
        counts[l[pair], r[pair]] += n[pair]
        holders[l[pair], r[pair]] |= shards[pair]
        return int(n[~pair].sum())

    try:
        total += taken_in(_changes(state.rows(), [], None, base, 0).toArrow(), 0, base)
        first_counts = counts.copy() if selection == "lazy_heap" else None

        def allowed(c: np.ndarray) -> np.ndarray | None:
            if first_counts is None:
                return None
            whole = np.abs(c - first_counts) < 0.5
            whole[base:], whole[:, base:] = True, True
            return whole

        while base + len(merges) < vocabulary:
            used, left_over = base + len(merges), vocabulary - base - len(merges)
            plan = scattered(counts, used, min(relaxed, left_over)) if relaxed else planned(counts, used, min(window, left_over), allowed)
            if not plan:
                break
            of_pair = [holders[p] if max(p) < used else 0 for p in plan]
            for k, (l, r) in enumerate(plan):  # a pair with a planned id lies where that id is made
                of_pair[k] = of_pair[k] or np.bitwise_and.reduce([of_pair[x - used] for x in (l, r) if x >= used])
            mask = int(np.bitwise_or.reduce(of_pair)) & ((1 << SHARDS) - 1)
            rows = _changes(state.rows(mask), merges[state.first :], plan, base, state.first).toArrow()
            kept = 0
            for step, pair in enumerate(plan):
                l, r, n = _best(counts, used + step, allowed(counts))
                if n <= 1 or not relaxed and (l, r) != pair:
                    break
                before = int(counts[pair])
                total += taken_in(rows, step, vocabulary)
                merges.append(pair)
                kept += 1
                if progress is not None:
                    progress.append((len(merges) - 1, *pair, base + len(merges) - 1, before, total))
            if not kept:
                break
            window = max(8, 2 * kept)
            if len(merges) - state.first >= REWRITE and base + len(merges) < vocabulary:
                state.advance(merges[state.first :], base)
    finally:
        state.close()
    return merges
