"""Operator 5: Jaccard join of shingle sets with a count-vector R-tree.

Every distinct set is a point: its shingles are hashed into groups and counted
by group. Two sets share at most the sum of the coordinate minima, and so do
two boxes of points; points are packed into the leaves of an R-tree, pairs of
boxes from the root down and then pairs of points whose bound is below what the
similarity asks for are dropped, and surviving pairs are verified with the sets
themselves. No pair is verified that the bound of its two vectors excludes.

One R-tree over all sets would prune little, as random sets of one size lie
alike in count space. So the points are first dealt to buckets by the shingles
of their prefix: in any common order of shingles, two sets of similarity t
share one of the first ``n - ceil(t n) + 1``. The order puts shingles of one
set first, then rare, then frequent ones, read off two bit tables with a
place or more for each value up to a bound; any order gives all pairs, this one small buckets. Members of a bucket
that are one component already need no comparison, which keeps large groups of
copies linear: rounds of linking to a few members of their buckets come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siglex.llm.arrow_text import LOWER, distinct, has_bits, map_arrow, mixed, runs
from siglex.llm.components import components, contracted
from siglex.llm.scratch import bit_table, dropped, partitions, shuffles_removed, written

WORDS = 5
GROUPS = 256
SATURATED = 255  # counts of a group that a byte holds; vectors beyond it bound nothing
STRIP = 2048
TABLE_BITS, MOST_BITS = 26, 29  # of a bit table's places, as powers of two
FREQUENT = 16
LEAF = 16
ROUNDS, PARTNERS = 3, 4  # of linking before the exact comparison
BLOCK = 2048  # members of a home that one task compares with as many others
LEVELS = 4  # counts of a group up to which minima are exact
PAIRS = 1 << 16  # that are held before they are given out

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        m = max(n, 1 << 18)
        for name, base in (("p", _P), ("q", _P_INVERSE)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["p"][:n], _powers["q"]


def words(starts: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word of a run, in order; A-Z lower-cased, words end at ASCII white space and rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    solid = ~_SPACE[data]
    new = np.zeros(len(data) + 1, bool)
    new[starts] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | new[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | new[1:-1]
    a, b = np.flatnonzero(begin), np.flatnonzero(end)
    p, q = _power(len(data))
    total = np.cumsum(_BYTE[LOWER[data]] * p)
    before = np.where(a > 0, total[a - 1], np.uint64(0))
    h = (total[b] - before) * q[a]
    return np.searchsorted(starts, a, "right") - 1, mixed(h ^ (b - a + 1).astype(np.uint64))


def shingle_sets(starts: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row of a run; fewer words than five are one shingle."""
    row, h = words(starts, data)
    n = np.bincount(row, minlength=len(starts) - 1)
    first = np.concatenate([[0], np.cumsum(n)])
    acc = h.copy()
    for k in range(1, WORDS):
        acc = mixed(acc[: len(h) - k] * _P + h[k:]) if len(h) > k else acc[:0]
    out = []
    for i in range(len(n)):
        if n[i] >= WORDS:
            out.append(distinct(acc[first[i] : first[i + 1] - WORDS + 1]))
        elif n[i]:
            whole = xxhash.xxh3_64_intdigest(h[first[i] : first[i + 1]].tobytes(), seed=int(n[i]))
            out.append(np.array([whole], np.uint64))
        else:
            out.append(h[:0])
    return out


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return tuple(x - (1 << 64) if x >> 63 else x for x in (d >> 64, d & ((1 << 64) - 1)))


def group_counts(shingles: np.ndarray) -> bytes:
    """The count vector of a set; all bytes ``SATURATED`` where a count does not fit."""
    counts = np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=GROUPS)
    return counts.astype(np.uint8).tobytes() if counts.max() < SATURATED else bytes([SATURATED]) * GROUPS


def _folded(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 32-bit rest) of shingle hashes, and so the value that the bit tables know."""
    b = np.uint64(buckets)
    return (h % b).astype(np.int64), ((h // b) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _known_as(bucket: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return mixed((bucket.astype(np.uint64) << np.uint64(32)) | rest)


def shared_tables(docs: DataFrame, buckets: int) -> tuple[bytes, bytes]:
    """Bit tables of the shingles of two documents or more, and of ``FREQUENT`` or more.

    Hashes travel as sorted blobs, one for each task and bucket, and are counted
    where they meet. An excess bit only moves a shingle back in the order.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, starts, data in runs(batch.column(0)):
                held += shingle_sets(starts, data)
                size += sum(map(len, held[-(len(starts) - 1) :]))
                if size > 1 << 20:
                    yield dealt(held)
                    held, size = [], 0
        if size:
            yield dealt(held)

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        bucket, rest = _folded(np.concatenate(held), buckets)
        order = np.argsort(bucket, kind="stable")
        rest, cut = rest[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), pa.array([rest[cut[i] : cut[i + 1]].tobytes() for i in range(buckets)], pa.binary())], ["bucket", "rests"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []
        for batch in batches:  # sorted by bucket
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket is not None and b != bucket:
                    yield often(bucket, blobs)
                    blobs = []
                bucket = b
                blobs.append(blob)
        if bucket is not None:
            yield often(bucket, blobs)

    def often(bucket: int, blobs: list[bytes]) -> pa.RecordBatch:
        x = np.sort(np.frombuffer(b"".join(blobs), np.uint32))
        at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
        n = np.diff(np.append(at, len(x)))
        own = at[n > 1]
        return pa.RecordBatch.from_arrays([pa.array(_known_as(np.full(len(own), bucket), x[own]).view(np.int64)), pa.array(n[n > 1] >= FREQUENT)], ["h", "frequent"])

    blobs = map_arrow(docs.select("text"), hashed, "bucket int, rests binary")
    rows = map_arrow(blobs.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket"), counted, "h long, frequent boolean")
    rows = written(rows, "shared-shingles")
    tables = tuple(bit_table(some, F.col("h"), table_bits(some.count())) for some in (rows, rows.where("frequent")))
    dropped(rows)
    return tables


def table_bits(values: int) -> int:
    """Places of a bit table as a power of two: one or two for each value, so that 37 % or more stay unset.

    A fixed size would fill up: then no shingle is known to be of one set, and all of a prefix are keys.
    """
    return min(MOST_BITS, max(TABLE_BITS, values.bit_length()))


def document_key() -> tuple[Column, Column]:
    """Two hashes of id and text; only rows equal in both share them."""
    return F.xxhash64("doc_id", "text").alias("d1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("d2")


def points(docs: DataFrame, tables: tuple[bytes, bytes], buckets: int) -> DataFrame:
    """(doc_id, d1, d2, s1, s2, n, vector, keys) of every row.

    That is: hashes of id and text, the digest of its set, its size, group
    counts and prefix keys.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tables)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, frequent = (np.frombuffer(t, np.uint8) for t in sent.value)
        for batch in batches:
            s1, s2, size, vectors, keys = [], [], [], [], []
            for _, starts, data in runs(batch.column(1)):
                sets = shingle_sets(starts, data)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                known = _known_as(*_folded(flat, buckets))
                rank = has_bits(shared, known).astype(np.int8)
                rank += (rank > 0) & has_bits(frequent, known)
                at = 0
                for s in sets:
                    n = len(s)
                    own = rank[at : at + n]
                    at += n
                    a, b = set_digest(s)
                    s1.append(a)
                    s2.append(b)
                    size.append(n)
                    vectors.append(group_counts(s))
                    prefix = n - (3 * n + 3) // 4 + 1
                    taken = np.argsort(own, kind="stable")[:prefix] if n > 1 else np.zeros(0, np.int64)
                    keys.append(s[taken[own[taken] > 0]].view(np.int64))
            cols = [pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(size, pa.int64()), pa.array(vectors, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *cols], ["doc_id", "d1", "d2", "s1", "s2", "n", "vector", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text", *document_key()), made, f"doc_id {kind}, d1 long, d2 long, s1 long, s2 long, n long, vector binary, keys array<bigint>")


def sets_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, vector, shingles) of the given classes (cid, s1, s2), from one text of each."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(classes, F.col("s2"), TABLE_BITS))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, given = np.frombuffer(table.value, np.uint8), set()
        for batch in batches:
            out = []
            for _, starts, data in runs(batch.column(0)):
                sets = shingle_sets(starts, data)
                ids = [set_digest(s) for s in sets]
                for i in np.flatnonzero(has_bits(wanted, np.array([b for _, b in ids], np.int64).view(np.uint64))).tolist():
                    if ids[i] not in given:  # exact copies in a task travel once
                        given.add(ids[i])
                        out.append((*ids[i], group_counts(sets[i]), sets[i].tobytes()))
                if len(given) > 1 << 16:
                    given = set()
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["s1", "s2", "vector", "shingles"])

    rows = map_arrow(docs.select("text"), made, "s1 long, s2 long, vector binary, shingles binary")
    return rows.join(classes, ["s1", "s2"]).dropDuplicates(["cid"]).select("cid", "vector", "shingles")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= 75 * union; the sets are compared only where the count vectors allow it."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, GROUPS) for c in (2, 3))
            n, m = (batch.column(c).to_numpy() for c in (4, 5))
            bound = np.minimum(x, y).sum(1, dtype=np.int64)
            bound = np.where((x[:, 0] == SATURATED) & (x.min(1) == SATURATED) | (y[:, 0] == SATURATED) & (y.min(1) == SATURATED), np.minimum(n, m), bound)
            keep = 7 * bound >= 3 * (n + m)
            left, right = batch.column(6), batch.column(7)
            for k in np.flatnonzero(keep).tolist():
                both = np.sort(np.concatenate([np.frombuffer(c[k].as_buffer(), np.uint64) for c in (left, right)]))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[k] = 100 * shared >= 75 * (len(both) - shared)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("cid").alias("b"), F.col("vector").alias("vy"), F.col("shingles").alias("y"))
    y = sets.select(F.col("cid").alias("a"), F.col("vector").alias("vx"), F.col("shingles").alias("x"))
    size = lambda c: F.octet_length(c) / 8
    rows = pairs.select("a", "b").join(x, "b").join(y, "a")  # last by a: a member that a large bucket offers is the b of many pairs
    return map_arrow(rows.select("a", "b", "vx", "vy", size("x").cast("long").alias("n"), size("y").cast("long").alias("m"), "x", "y"), checked, "a long, b long")


def _levels(v: np.ndarray, top: int) -> np.ndarray:
    """One coordinate for each group and level up to ``top``, 1 where the count reaches it.

    The product of two such rows is the sum of the minima of counts cut at ``top``.
    """
    return np.concatenate([v >= t for t in range(1, top + 1)], 1).astype(np.float32)


class Level:
    """Boxes of one level of the R-tree: neighbouring points (or boxes of the level below) under one bound."""

    def __init__(self, cuts: np.ndarray, high: np.ndarray, full: np.ndarray, least: np.ndarray, most: np.ndarray, top: int) -> None:
        self.cuts, self.high, self.full, self.least, self.most = cuts, high, full, least, most
        self.levels, self.above = _levels(high, top), np.maximum(high.astype(np.int64) - top, 0).sum(1)

    def over(self, top: int) -> Level:
        cuts = np.arange(0, len(self.high), LEAF)
        return Level(cuts, np.maximum.reduceat(self.high, cuts), np.logical_or.reduceat(self.full, cuts), np.minimum.reduceat(self.least, cuts), np.maximum.reduceat(self.most, cuts), top)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether boxes ``a`` (down) and ``b`` (across) may hold points of similarity 0.75: by sizes and by the summed coordinate minima."""
        bound = self.levels[a] @ self.levels[b].T + np.minimum(self.above[a][:, None], self.above[b])
        smaller = np.minimum(self.most[a][:, None], self.most[b])
        bound = np.where(self.full[a][:, None] | self.full[b], smaller, np.minimum(bound, smaller))
        sizes = (4 * self.most[a][:, None] >= 3 * self.least[b]) & (4 * self.most[b] >= 3 * self.least[a][:, None])
        return sizes & (7 * bound >= 3 * (self.least[a][:, None] + self.least[b]))


def overlap_pairs(n: np.ndarray, v: np.ndarray, label: np.ndarray, side: np.ndarray) -> Iterator[np.ndarray]:
    """Index pairs (i, j) with different labels whose overlap bound allows similarity 0.75, by an R-tree self-join.

    Points are packed by size band and then by their greatest coordinates;
    levels of boxes are built up to one root, and a pair of boxes whose bound
    is too low prunes all below it. Points with side 0 and 1 (two blocks of a
    large bucket) are compared across only; if all sides are equal, all with
    each other. The bound is the summed coordinate minima: a product of levels
    up to ``LEVELS``, and above them the smaller of the two rests. A saturated
    vector bounds by the smaller set.
    """
    band = np.floor(np.log(np.maximum(n, 1)) / np.log(4 / 3)).astype(np.int64)
    first = v.argmax(1)
    rest = v.copy()
    rest[np.arange(len(v)), first] = 0
    order = np.lexsort((rest.argmax(1), first, band))
    n, v, label, side = n[order], v[order], label[order], side[order]
    full = v.max(1) == SATURATED
    v = np.where(full[:, None], 0, v).astype(np.uint8)
    top = int(min(LEVELS, max(1, v.max())))
    cross = side.min() != side.max()
    tree = [Level(np.arange(len(n)), v, full, n, n, top)]
    while len(tree[-1].high) > 1:
        tree.append(tree[-1].over(top))

    def children(level: int, boxes: np.ndarray) -> np.ndarray:
        below = (tree[level].cuts[boxes][:, None] + np.arange(LEAF)).ravel()
        return below[below < len(tree[level - 1].high)]

    def search(level: int, a: int, against: np.ndarray) -> Iterator[np.ndarray]:
        """Pairs below box ``a`` and the boxes ``against`` (none before ``a``)."""
        against = against[tree[level].near(np.array([a]), against)[0]]
        i = children(level, np.array([a]))
        for at in range(0, len(against), STRIP // LEAF if level == 1 else max(1, len(against))):
            j = children(level, against[at : at + STRIP // LEAF] if level == 1 else against)
            if level > 1:
                for box in i.tolist():
                    yield from search(level - 1, box, j[j >= box])
                continue
            ok = (i[:, None] < j) & (label[i][:, None] != label[j])
            if cross:
                ok &= side[i][:, None] != side[j]
            if ok.any():
                p, q = np.nonzero(ok & tree[0].near(i, j))
                yield np.stack([order[i[p]], order[j[q]]], 1)

    if len(n) > 1:
        yield from search(len(tree) - 1, 0, np.zeros(1, np.int64))


def partners(labelled: DataFrame, turn: int) -> DataFrame:
    """For each class (key, cid, label), at most ``PARTNERS`` pairs (a, b) with a member of another label from its buckets.

    Every bucket offers one member, another one each turn, so the rows are in
    proportion to the classes however large a bucket is. Pairs that are not
    tried here are left to ``bucket_pairs``, unless the turns make them one component.
    """
    offered = labelled.groupBy("key").agg(F.min(F.struct(F.xxhash64("cid", F.lit(turn)).alias("h"), F.col("cid").alias("b"), "label")).alias("o"), F.min("label").alias("x"), F.max("label").alias("y"))
    offered = offered.where("x < y").select("key", "o.b", F.col("o.label").alias("other"))
    pairs = labelled.join(offered, "key").where("label <> other").select(F.col("cid").alias("a"), "b")
    nth = F.dense_rank().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b"), "b"))  # a pair of several buckets counts once
    return pairs.withColumn("nth", nth).where(F.col("nth") <= PARTNERS).select("a", "b").distinct()


def bucket_pairs(members: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of members (home, cid, label, n, vector, keys) that share a bucket and have different labels.

    Buckets of one home (their least label) share most members and are dealt
    together: a class comes once with all its keys there, and a task compares
    either each bucket of a home or, where that is less work, all members of the
    home once. A home is cut into blocks by class and dealt to a task for each
    pair of blocks, so neither a home nor a bucket meets in one task.
    """
    sizes = members.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    cells = (
        members.join(sizes, "home")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("home", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cid", "label", "n", "vector", "keys")
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []
        for batch in batches:  # sorted by cell
            cell = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            edges = np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1
            for a, b in zip([0, *edges], [*edges, len(cell)], strict=True):
                if a == b:
                    continue
                this = tuple(cell[a])
                if held is not None and this != held:
                    yield from found(parts)
                    parts = []
                held = this
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from found(parts)

    def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        side, cid, label, n = (t.column(c).to_numpy() for c in range(3, 7))
        v = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint8).reshape(-1, GROUPS)
        keys = t.column(8).combine_chunks()
        row = np.repeat(np.arange(len(cid)), keys.value_lengths().to_numpy())
        key = keys.flatten().to_numpy()
        order = np.argsort(key, kind="stable")
        row, key = row[order], key[order]
        edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        if len(cid) ** 2 <= (np.diff(edges) ** 2).sum():
            groups = [np.arange(len(cid))]
        else:
            groups = [row[a:b] for a, b in zip(edges, edges[1:], strict=False) if b - a > 1]
        for g in groups:  # pairs found in several buckets are made one by the caller
            held: list[np.ndarray] = []
            for pairs in overlap_pairs(n[g], v[g], label[g], side[g]):
                held.append(np.sort(cid[g][pairs], 1))
                if sum(map(len, held)) > PAIRS:
                    yield given(held)
                    held = []
            if held:
                yield given(held)

    def given(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate(held)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    spread = cells.repartition(partitions(members.sparkSession), "home", "i", "j").sortWithinPartitions("home", "i", "j")
    return map_arrow(spread, joined, "a long, b long").distinct()


def similar_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``, similarity 0.75 or more on five-word shingles.

    Also d1, d2 (hashes of id and text) and component, a number of the component
    that is there for null ids too (null for empty sets).

    Null texts, empty texts and texts of white space have an empty set and are
    linked with nothing, each its own component. Sets of one shingle are linked
    with equal ones. The component id is the least doc_id reached; null ids are
    passed over, and a component of null ids only has null. Repeated rows are
    members like others; an empty table gives an empty result. Other columns
    are not read.
    """
    with shuffles_removed(docs.sparkSession):
        return _components(docs)


def _components(docs: DataFrame) -> DataFrame:
    """``similar_components``; tables go when they were read for the last time."""
    buckets = 4 * partitions(docs.sparkSession)
    rows = written(points(docs, shared_tables(docs, buckets), buckets), "points")
    full = rows.where("n > 0")
    classes = written(
        full.groupBy("s1", "s2").agg(F.min("doc_id").alias("least_id"), F.first("n").alias("n")).withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    each = full.groupBy("s1", "s2").agg(F.min("vector").alias("vector"), F.min("keys").alias("keys")).where(F.size("keys") > 0)
    keyed = each.join(classes, ["s1", "s2"]).select("cid", "s1", "s2", "n", "vector", F.explode("keys").alias("key"))
    keyed = written(keyed.select("key", "cid"), "keys")
    several = keyed.groupBy("key").agg(F.min("cid").alias("x"), F.max("cid").alias("y")).where("x < y").select("key")
    members = written(keyed.join(several, "key"), "members")
    dropped(keyed)
    in_buckets = members.select("cid").distinct().join(classes, "cid").select("cid", "s1", "s2")
    sets = written(sets_of(docs, in_buckets), "sets")
    labelled, links = members.withColumn("label", F.col("cid")), None
    for turn in range(ROUNDS):
        new, before, old = written(verified(partners(labelled, turn), sets), "new-links"), links, labelled
        links = written(contracted(new if links is None else links.unionByName(new)), "links")
        labels = links.groupBy(F.col("a").alias("cid")).agg(F.min("b").alias("component"))
        labelled = written(members.join(labels, "cid", "left").select("key", "cid", F.coalesce("component", "cid").alias("label")), "labelled")
        dropped(new, *([old, before] if turn else []))
    dropped(members)
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key", F.col("x").alias("home"))
    vectors = full.join(classes.select("s1", "s2", "cid"), ["s1", "s2"]).groupBy("cid").agg(F.min("n").alias("n"), F.min("vector").alias("vector"))
    at_home = labelled.join(open_keys, "key").groupBy("home", "cid").agg(F.min("label").alias("label"), F.collect_list("key").alias("keys"))  # no more keys than a prefix has
    rest = written(at_home.join(vectors, "cid"), "rest")
    dropped(labelled)
    pairs = written(bucket_pairs(rest), "bucket-pairs")
    more = written(verified(pairs, sets), "more-links")
    dropped(rest, pairs, sets)
    final = components(links.unionByName(more))
    of_class = classes.join(final.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = of_class.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = written(of_class.join(least, "component").select("s1", "s2", "component", "component_id"), "named")
    return (
        rows.select("doc_id", "d1", "d2", "s1", "s2", F.col("n").alias("n_shingles"))
        .join(named, ["s1", "s2"], "left")
        .select("doc_id", "d1", "d2", "component", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each component the one of least doc_id (ties by a hash of the text).

    Rows with an empty set are all kept. Null ids come last in a component.
    """
    rows = written(similar_components(docs), "components")
    first = rows.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "d1", "d2")).alias("one"))
    keep = first.select(F.col("one.d1").alias("d1"), F.col("one.d2").alias("d2"), F.lit(True).alias("once")).unionByName(
        rows.where("component is null").select("d1", "d2", F.lit(False).alias("once")).distinct()
    )
    keyed = docs.select(F.struct("*").alias("row"), *document_key())
    kept = keyed.join(written(keep, "kept"), ["d1", "d2"])
    nth = F.row_number().over(Window.partitionBy("d1", "d2").orderBy("d1"))  # a row that is there several times stays once
    return kept.withColumn("nth", nth).where("nth = 1 or not once").select("row.*")
