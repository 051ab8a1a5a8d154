"""Byte-pair vocabularies over integer sequences: distributed training and application.

Sequences are long rows (key columns, pos, tok) for the relational operators and
arrays of ints, one row each, for the fast path. A vocabulary is a list of merges
(left, right) in rank order; merge ``k`` has the id ``base + k``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siglex.operators import ranks
from siglex.sources.shared import written

Merges = list[tuple[int, int]]


def pair_counts(tokens: DataFrame, key: list[str], by: list[str] | None = None) -> DataFrame:
    """(l, r, n): adjacent pairs, overlaps included; ``by`` keeps several vocabularies apart."""
    w = Window.partitionBy(*key).orderBy("pos")
    pairs = tokens.withColumn("r", F.lead("tok").over(w)).where("r is not null")
    return pairs.groupBy(*(by or []), F.col("tok").alias("l"), "r").agg(F.count("*").alias("n"))


def apply_merge(tokens: DataFrame, key: list[str], left: int, right: int, new: int) -> DataFrame:
    """Greedy left-to-right replacement of one pair; in runs of equal tokens every second place starts a merge."""
    w = Window.partitionBy(*key).orderBy("pos")
    t = tokens.withColumn("nxt", F.lead("tok").over(w))
    if left == right:
        t = t.withColumn("_i", F.row_number().over(w)).withColumn("_g", F.col("_i") - F.row_number().over(Window.partitionBy(*key, "tok").orderBy("pos")))
        t = t.withColumn("_k", F.row_number().over(Window.partitionBy(*key, "tok", "_g").orderBy("pos")))
        t = t.withColumn("hit", (F.col("tok") == left) & F.coalesce(F.col("nxt") == right, F.lit(False)) & (F.col("_k") % 2 == 1)).drop("_i", "_g", "_k")
    else:
        t = t.withColumn("hit", (F.col("tok") == left) & F.coalesce(F.col("nxt") == right, F.lit(False)))
    t = t.withColumn("gone", F.coalesce(F.lag("hit").over(w), F.lit(False))).where("not gone")
    out = t.withColumn("tok", F.when(F.col("hit"), F.lit(new)).otherwise(F.col("tok")))
    return out.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).select(*key, "pos", "tok")


def sequences(tokens: DataFrame, key: list[str], value: str = "tok", order: str = "pos") -> DataFrame:
    """One row for each key with its tokens as an array."""
    return tokens.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value].cast("int")).alias("toks"))


def exploded(seqs: DataFrame, key: list[str], column: str = "toks") -> DataFrame:
    return seqs.select(*key, F.posexplode(column).alias("pos", "tok"))


def merged(seq: np.ndarray, left: int, right: int, new: int) -> np.ndarray:
    """One merge on one array; agrees with apply_merge."""
    at = np.flatnonzero((seq[:-1] == left) & (seq[1:] == right))
    if left == right and len(at):
        run = np.cumsum(np.concatenate([[True], at[1:] != at[:-1] + 1])) - 1
        first = at[np.concatenate([[True], run[1:] != run[:-1]])]
        at = at[(at - first[run]) % 2 == 0]
    if not len(at):
        return seq
    out = seq.copy()
    out[at] = new
    keep = np.ones(len(seq), bool)
    keep[at + 1] = False
    return out[keep]


NEVER = np.iinfo(np.int64).max


def _chosen(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of places ``at`` (ascending) with their ranks, those that merge if each rank takes what it can, in order, from the left."""
    out = []
    while len(at):
        next_to = np.concatenate([[False], at[1:] == at[:-1] + 1])
        starts = np.flatnonzero(~next_to | np.concatenate([[True], rank[1:] != rank[:-1]]))
        own, joined = rank[starts], next_to[starts]
        left = np.where(joined, np.concatenate([[NEVER], own[:-1]]), NEVER)
        right = np.where(np.append(joined[1:], False), np.append(own[1:], NEVER), NEVER)
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at))))
        taken = ((own < left) & (own < right))[run] & ((np.arange(len(at)) - starts[run]) % 2 == 0)
        out.append(at[taken])
        beside = np.concatenate([taken[1:] & next_to[1:], [False]]) | np.concatenate([[False], taken[:-1]]) & next_to
        at, rank = at[~taken & ~beside], rank[~taken & ~beside]
    return np.sort(np.concatenate(out)) if out else at


def apply_merges(seq: np.ndarray, merges: Merges, base: int, first: int = 0) -> np.ndarray:
    """All merges in rank order, negative values as separators.

    A wave takes the least rank that is there and those after it, up to the first
    that may read an id the wave makes; what these ranks merge is settled by the
    pairs as they stand, so they go together. Ranks are looked up again
    only beside what was merged.
    """
    if not merges or len(seq) < 2:
        return seq
    pairs = np.array(merges, np.int64)
    keys = (pairs[:, 0] << 32) | pairs[:, 1]
    order = np.argsort(keys)
    keys = keys[order]
    reader = np.full(len(merges), NEVER)  # the first rank that reads what a rank makes
    for k in range(len(merges) - 1, -1, -1):
        for x in merges[k]:
            if x >= base + first:
                reader[x - base - first] = k

    def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = np.where((left < 0) | (right < 0), -1, (left.astype(np.int64) << 32) | right)
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[place] == key, order[place], NEVER)

    rank = ranks(seq[:-1], seq[1:])
    seq = seq.copy()
    while len(seq) > 1:
        known = np.flatnonzero(rank != NEVER)
        if not len(known):
            break
        there = np.flatnonzero(np.bincount(rank[known], minlength=1))
        bound = np.concatenate([[NEVER], np.minimum.accumulate(reader[there])])
        over = np.flatnonzero(there >= bound[:-1])
        limit = bound[over[0]] if len(over) else NEVER
        known = known[rank[known] < limit]
        at = _chosen(known, rank[known])
        seq[at] = base + first + rank[at]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        rank = np.concatenate([rank, [NEVER]])[keep][:-1]
        new = at - np.arange(len(at))
        new = np.concatenate([new - 1, new])
        new = new[(new >= 0) & (new < len(rank))]
        rank[new] = ranks(seq[new], seq[new + 1])
    return seq


def tokenise(seqs: DataFrame, merges: Merges, base: int, first: int = 0, column: str = "toks") -> DataFrame:
    """``toks`` merged; all sequences of a batch are joined with separators and merged at once."""
    at = seqs.columns.index(column)
    schema = seqs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(at)
            offsets = np.asarray(col.offsets)
            flat = np.asarray(col.values)[offsets[0] : offsets[-1]].astype(np.int64)
            offsets = offsets - offsets[0]
            joined = np.insert(flat, offsets[1:], -1)  # a separator after every sequence
            out = apply_merges(joined, merges, base, first)
            ends = np.flatnonzero(out == -1)
            new = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(new), pa.array(out[out != -1].astype(np.int32)))
            columns = [lists if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return seqs.mapInArrow(run, schema)


def train(seqs: DataFrame, base: int, vocabulary: int, relaxed: int = 0, selection: str = "greedy", progress: list | None = None) -> Merges:
    """Merges up to ``vocabulary`` ids by greedy counts; ties by (l, r). Stops where no pair occurs twice.

    Training is by count differences over weighted distinct sequences (``merges``): equal to
    one merge at a time, with a job for some merges each. ``relaxed`` > 0 takes up to so many
    merges a round without looking at what they do to each other's order, an
    approximation. ``selection="lazy_heap"`` takes a pair of base ids only while all
    of its first occurrences are still there. ``progress`` receives rows (step, l, r,
    new_id, pair_count, total_tokens after the step). Tables of the training are removed.
    """
    from siglex.operators import merges

    if selection not in ("greedy", "lazy_heap"):
        raise ValueError(f"unknown selection {selection!r}")
    return merges.train(seqs, base, vocabulary, relaxed, selection, progress)


def best_by(tokens: DataFrame, key: list[str], by: list[str], new: int) -> tuple[DataFrame, DataFrame]:
    """One round for several vocabularies side by side: (best pair of each, tokens with it applied)."""
    best = written(best_pairs(pair_counts(tokens, key, by).where("n > 1"), by).withColumn("new_id", F.lit(new)), "best-pairs")
    return best, applied_by(tokens, key, by, best)


def applied_by(tokens: DataFrame, key: list[str], by: list[str], pairs: DataFrame) -> DataFrame:
    """Tokens with one pair (by, l, r, new_id) merged for each vocabulary; rows without a pair stay."""
    w = Window.partitionBy(*key).orderBy("pos")
    t = tokens.join(F.broadcast(pairs.select(*by, F.col("l").alias("_l"), F.col("r").alias("_r"), F.col("new_id").alias("_new"))), by, "left")  # one row a vocabulary
    t = t.withColumn("_next", F.lead("tok").over(w)).withColumn("_g", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*key, "tok").orderBy("pos")))
    t = t.withColumn("_k", F.row_number().over(Window.partitionBy(*key, "tok", "_g").orderBy("pos")))
    hit = F.coalesce((F.col("tok") == F.col("_l")) & (F.col("_next") == F.col("_r")) & ((F.col("_l") != F.col("_r")) | (F.col("_k") % 2 == 1)), F.lit(False))
    t = t.withColumn("_hit", hit).withColumn("_gone", F.coalesce(F.lag("_hit").over(w), F.lit(False))).where("not _gone")
    return t.withColumn("tok", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("tok"))).withColumn("pos", (F.row_number().over(w) - 1).cast("int")).select(*tokens.columns)


def train_by(tokens: DataFrame, key: list[str], by: list[str], base: int, merges: int) -> tuple[DataFrame, DataFrame]:
    """(by, rank, l, r, n, new_id) of ``merges`` merges for each vocabulary, and the tokens after them; all advance in one round."""
    table = None
    for k in range(merges):
        best, tokens = best_by(tokens, key, by, base + k)
        tokens = written(tokens, "by-round")
        best = best.withColumn("rank", F.lit(k))
        table = best if table is None else table.unionByName(best)
    return table, tokens


def train_discriminative(tokens: DataFrame, key: list[str], label: str, base: int, merges: int, alpha: float, top_k: int) -> DataFrame:
    """(rank, l, r, n, score): each round merges the best scored of the ``top_k`` most frequent pairs."""
    table = None
    for k in range(merges):
        scored = discriminative_pairs(tokens, key, label, alpha, top_k).withColumn("score", F.round("score", 9))
        best = written(scored.orderBy(F.desc("score"), F.desc("n"), "l", "r").limit(1).select(F.lit(k).alias("rank"), "l", "r", "n", "score"), "best-pair")
        table = best if table is None else table.unionByName(best)
        one = best.select("l", "r", F.lit(base + k).alias("new_id"), F.lit(1).alias("_one"))
        tokens = written(applied_by(tokens.withColumn("_one", F.lit(1)), key, ["_one"], one).drop("_one"), "by-round")
    return table


def best_pairs(counts: DataFrame, by: list[str]) -> DataFrame:
    """The first pair of each vocabulary by (-n, l, r)."""
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "l", "r")
    return counts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def discriminative_pairs(tokens: DataFrame, key: list[str], label: str, alpha: float, top_k: int) -> DataFrame:
    """(l, r, n, spread, score): of the ``top_k`` most frequent pairs, count^(1-alpha) * deviation of class rates^alpha."""
    counts = pair_counts(tokens, key, [label])
    totals = counts.groupBy(label).agg(F.sum("n").alias("total"))
    classes = totals.select(label, "total")
    head = counts.groupBy("l", "r").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "l", "r").limit(top_k)
    grid = head.join(F.broadcast(classes))  # top_k rows by classes
    rated = grid.join(counts, ["l", "r", label], "left").withColumn("rate", F.coalesce("n", F.lit(0)) / F.col("total"))
    return rated.groupBy("l", "r").agg(F.max("all").alias("n"), F.stddev_pop("rate").alias("spread")).withColumn("score", F.pow("n", F.lit(1 - alpha)) * F.pow("spread", F.lit(alpha)))


def merge_table(spark: SparkSession, merges: Merges, base: int) -> DataFrame:
    return spark.createDataFrame([(k, l, r, base + k) for k, (l, r) in enumerate(merges)], "rank int, l int, r int, new_id int")


def progress_table(spark: SparkSession, progress: list, tokens: int) -> DataFrame:
    """(step, l, r, new_id, pair_count, total_tokens, compression) of a training that began with so many tokens."""
    rows = spark.createDataFrame(progress, "step int, l int, r int, new_id int, pair_count long, total_tokens long")
    return rows.withColumn("compression", F.lit(tokens) / F.col("total_tokens"))


def vocabulary_table(spark: SparkSession, merges: Merges, base: int) -> DataFrame:
    """(token, base_seq, base_len) of every id."""
    known = {k: [k] for k in range(base)}
    for k, (l, r) in enumerate(merges):
        known[base + k] = known[l] + known[r]
    return spark.createDataFrame([(t, s, len(s)) for t, s in known.items()], "token int, base_seq array<int>, base_len int")


def random_merges(base: int, n: int, seed: int = 42) -> Merges:
    """Distinct random pairs of known ids, a control vocabulary."""
    rng, out, seen = np.random.default_rng(seed), [], set()
    while len(out) < n:
        pair = tuple(int(x) for x in rng.integers(0, base + len(out), 2))
        if pair not in seen:
            seen.add(pair)
            out.append(pair)
    return out


def flat_view(seqs: DataFrame, key: list[str], order: str, budget: int, separator: int, padding: int, length: int) -> DataFrame:
    """Sequences of a key joined: an equal budget for each channel, separators between, padded to ``length``."""
    cut = seqs.withColumn("toks", F.slice("toks", 1, budget))
    rows = cut.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, "toks"))).alias("parts"))
    joined = F.flatten(F.transform("parts", lambda p, i: F.when(i == 0, p["toks"]).otherwise(F.concat(F.array(F.lit(separator)), p["toks"]))))
    return rows.select(*key, F.slice(F.concat(joined, F.array_repeat(F.lit(padding), length)), 1, length).alias("flat"))


def prefix(merges: Merges, base: int, vocabulary: int) -> Merges:
    """The merges of a smaller vocabulary: train once, cut often."""
    return merges[: max(0, vocabulary - base)]


def subsample(seqs: DataFrame, key: list[str], cap: int, seed: int = 42) -> DataFrame:
    """As many sequences as keep about ``cap`` tokens: n * cap / total of them, by a hash of the key; all if they fit."""
    size = seqs.agg(F.count("*").alias("n"), F.sum(F.size("toks")).alias("total")).first()
    if not size.total or size.total <= cap:
        return seqs
    keep = max(1, size.n * cap // size.total)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in key)).cast("binary"))
    marked = seqs.withColumn("_h", F.conv(F.substring(order, 1, 13), 16, 10).cast("double"))  # 52 bits, whole in a double
    last = ranks.ranked(marked, "_h", [keep - 1])[keep - 1]
    below = marked.where(F.col("_h") < last)
    ties = marked.where(F.col("_h") == last).orderBy(order, *key).limit(keep - below.count())
    return below.unionByName(ties).drop("_h")


def first_of_each(seqs: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """At most ``n`` sequences of each data set."""
    w = Window.partitionBy(*by).orderBy(*order)
    return seqs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def by_corpus_size(seqs: DataFrame, order: list[str], sizes: tuple[int | None, ...], base: int, vocabulary: int) -> DataFrame:
    """(n_sequences, rank, l, r, new_id, n, total_tokens): a vocabulary for each corpus size, of the first sequences in ``order``; None takes all."""
    table = None
    for size in sizes:
        some = written(seqs if size is None else seqs.orderBy(*order).limit(size), "corpus-size")
        progress: list = []
        train(some, base, vocabulary, progress=progress)
        rows = seqs.sparkSession.createDataFrame(progress, "rank int, l int, r int, new_id int, n long, total_tokens long").withColumn("n_sequences", F.lit(some.count()))
        table = rows if table is None else table.unionByName(rows)
    return table


def save_vocabulary(spark: SparkSession, merges: Merges, base: int, path: str) -> None:
    merge_table(spark, merges, base).withColumn("base", F.lit(base)).coalesce(1).write.mode("overwrite").json(path)


def load_vocabulary(spark: SparkSession, path: str) -> tuple[Merges, int]:
    """(merges, base); a vocabulary is as long as its merges, which the driver holds in any case."""
    rows = spark.read.schema("rank int, l int, r int, new_id int, base int").json(path).orderBy("rank").collect()
    return [(x.l, x.r) for x in rows], (rows[0].base if rows else 0)


def two_level(seqs: DataFrame, base: int, first: int, second: int) -> tuple[Merges, Merges, DataFrame]:
    """Merges of level one (up to ``first`` ids), of level two over its tokens (up to ``second``), and the level-two sequences."""
    one = train(seqs, base, first)
    level = written(tokenise(seqs, one, base), "level-one")
    two = train(level, base + len(one), second)
    return one, two, tokenise(level, two, base + len(one))


def channel_view(seqs: DataFrame, key: list[str], column: str, length: int, padding: int) -> DataFrame:
    """Each channel's sequence cut or padded to ``length``, and which places hold a token."""
    full = F.slice(F.concat(column, F.array_repeat(F.lit(padding), length)), 1, length)
    return seqs.select(*key, full.alias("toks"), F.least(F.size(column), F.lit(length)).alias("n_tokens"))


def component_view(seqs: DataFrame, key: list[str], order: str, separator: int, padding: int, length: int) -> DataFrame:
    """Sequences of a key joined in order, a separator after each, padded or cut to ``length``."""
    rows = seqs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, "toks"))).alias("parts"))
    joined = F.flatten(F.transform("parts", lambda p: F.concat(p["toks"], F.array(F.lit(separator)))))
    return rows.select(*key, F.slice(F.concat(joined, F.array_repeat(F.lit(padding), length)), 1, length).alias("flat"))
