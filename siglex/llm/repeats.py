"""Operator 9: repeated byte strings by a distributed sort of suffix contexts.

Content picks the suffixes that are sorted: in every window of ``length``
bytes the least hashed 32-byte gram is an anchor, so both ends of a repeat
hold an anchor at the same place. Tasks sort the contexts of anchors whose
gram occurs again (what follows the anchor, then what stands before it,
backwards), front-code the sorted run (length of the prefix shared with the
line before, then the rest), and exchange the runs by gram. A loser tree that
carries common-prefix lengths merges the runs and never compares a prefix that
is known to agree; so equal contexts of many documents stand once in a run. The
merged order and its common-prefix lengths tell, for every window around an
anchor, whether it occurs twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglex.llm.arrow_text import has_bits, map_arrow, mixed, owner, packed, runs
from siglex.llm.scratch import bit_table, partitions, written

GRAM = 32
TABLE_BITS = 26
HELD = 1 << 26  # bytes of contexts and owners in a run
PAIRED = 256  # distinct contexts of a gram that are compared two by two; more go by intervals
#: Fixed value: ends what follows an anchor; UTF-8 never holds this byte, so one order holds for sorting and merging.
END = b"\xff"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes at every place (one for each place where 32 bytes are left)."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = packed(data, 8)
    out = np.zeros(n, np.uint64)
    for k in range(4):
        out = mixed(out ^ eight[8 * k : 8 * k + n])
    return out


def sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """min or max of every ``width`` neighbours, by doubling."""
    have, step = x, 1
    while 2 * step <= width:
        have = best(have[: len(have) - step], have[step:])
        step *= 2
    return best(have[: len(x) - width + 1], have[width - step : width - step + len(x) - width + 1])


def anchors(starts: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes) of the anchors of a run of rows: the least gram of every window of ``length`` bytes inside a row."""
    wide = length - GRAM + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.maximum(gram_hashes(data), np.uint64(1))
    least = sliding(h, wide, np.minimum)
    row = owner(starts)
    least[row[: len(least)] != row[length - 1 :]] = 0  # windows that leave their row
    padded = np.concatenate([np.zeros(wide - 1, np.uint64), least, np.zeros(wide - 1, np.uint64)])
    own = sliding(padded, wide, np.maximum)[: len(h)]
    at = np.flatnonzero(h == own)
    return at, h[at]


class Run:
    """A sorted, front-coded run: of each string, the prefix shared with the one before and the rest."""

    def __init__(self, shared: np.ndarray, sizes: np.ndarray, rest: bytes) -> None:
        self.shared, self.sizes, self.rest = shared, sizes, rest

    @classmethod
    def of(cls, strings: list[bytes]) -> Run:
        shared, rest, last = [], [], b""
        for s in strings:
            k = common(last, s)
            shared.append(k)
            rest.append(s[k:])
            last = s
        return cls(np.array(shared, np.uint16), np.array([len(r) for r in rest], np.uint16), b"".join(rest))

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        at, last = 0, b""
        for k, n in zip(self.shared.tolist(), self.sizes.tolist(), strict=True):
            last = last[:k] + self.rest[at : at + n]
            at += n
            yield k, last


def common(a: bytes, b: bytes, k: int = 0) -> int:
    """Length of the common prefix, of which ``k`` bytes are known."""
    n = min(len(a), len(b))
    if a[k:n] == b[k:n]:
        return n
    step = 32
    while a[k : k + step] == b[k : k + step]:
        k += step
        step *= 2
    x = int.from_bytes(a[k : k + step], "little") ^ int.from_bytes(b[k : k + step], "little")
    return min(n, k + ((x & -x).bit_length() - 1) // 8)


def merge(sources: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """(shared prefix with the string before, source, string) in sorted order.

    A loser tree. Each contender carries the length of the prefix it shares
    with the last winner of its path; the longer one is smaller without any
    comparison, and equal ones are compared only from there on.
    """
    size = 1
    while size < len(sources):
        size *= 2
    heads: list[tuple[int, bytes] | None] = [next(s, None) for s in sources] + [None] * (size - len(sources))
    shared = [0] * size  # with the last string given out
    tree = [0] * size

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser then carries its prefix shared with the winner."""
        if heads[x] is None or heads[y] is None:
            return (y, x) if heads[x] is None else (x, y)
        if shared[x] != shared[y]:
            return (x, y) if shared[x] > shared[y] else (y, x)
        a, b = heads[x][1], heads[y][1]
        k = common(a, b, shared[x])
        if k == len(a) == len(b):
            winner, loser = (x, y) if x < y else (y, x)
        else:
            winner, loser = (x, y) if a[k : k + 1] < b[k : k + 1] else (y, x)
        shared[loser] = k
        return winner, loser

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    first = build(1)
    while heads[first] is not None:
        yield shared[first], first, heads[first][1]
        heads[first] = next(sources[first], None)
        if heads[first] is not None:
            shared[first] = heads[first][0]
        node = (first + size) // 2
        while node:
            first, tree[node] = play(first, tree[node])
            node //= 2


def agreements(shared: np.ndarray) -> np.ndarray:
    """Common prefix lengths of every two of a sorted list, from those of neighbours; -1 with itself."""
    m = len(shared)
    out = np.full((m, m), -1, np.int64)
    for i in range(m - 1):
        out[i, i + 1 :] = out[i + 1 :, i] = np.minimum.accumulate(shared[i + 1 :])
    return out


def repeated_ranges(after: np.ndarray, before: np.ndarray, shared: np.ndarray, shared_before: np.ndarray, order: np.ndarray, many: np.ndarray, length: int) -> np.ndarray:
    """Rows (i, least, most) of the distinct contexts ``i`` of one gram.

    Windows that begin ``s`` bytes before the anchor occur twice for every
    ``least <= s <= most``. ``after`` and ``before`` are lengths of what stands
    on both sides, in ascending order of what follows, with ``shared`` prefixes;
    ``shared_before`` are those in ``order``, the ascending order of what stands
    before. A context that is there ``many`` times repeats all its windows.
    """
    m, reach = len(after), length - GRAM
    least, most = np.maximum(length - after, 0), np.minimum(before, reach)
    alone = np.flatnonzero(many & (least <= most))
    own = np.column_stack([alone, least[alone], most[alone]])
    if many.all() or m < 2:
        return own
    if m == 2:
        low, high = max(0, length - int(shared[1])), min(reach, int(shared_before[1]))
        rows = [(i, low, high) for i in (0, 1) if not many[i] and low <= high]
        return np.concatenate([own, np.array(rows, np.int64).reshape(-1, 3)])
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    if m <= PAIRED:
        low = np.maximum(length - agreements(shared), 0)
        high = np.minimum(agreements(shared_before)[place][:, place], reach)
        i, j = np.nonzero((low <= high) & ~many[:, None])
        width = reach + 3
        steps = np.bincount(i * width + low[i, j] + 1, minlength=m * width) - np.bincount(i * width + high[i, j] + 2, minlength=m * width)
        inside = np.cumsum(steps) > 0  # every row of steps sums to none
        at = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2) + 1
        return np.concatenate([own, np.column_stack([at[:, 0] // width, at[:, 0] % width - 1, at[:, 1] % width - 2])])
    ends = np.unique(np.concatenate([[0, reach + 1], shared_before + 1, before + 1, length - shared, length - after]))
    ends = ends[(ends >= 0) & (ends <= reach + 1)]
    out, since = [own], np.full(m, -1)
    for low in ends:  # between two ends nothing changes
        if low <= reach:
            fits = np.flatnonzero((least <= low) & (low <= most))
            same_after = np.cumsum(shared < length - low)[fits]
            same_before = np.cumsum(shared_before < low)[place[fits]] if low else 0
            key = same_after * (m + 1) + same_before
            by = np.argsort(key, kind="stable")
            equal = key[by][1:] == key[by][:-1]
            twice = np.zeros(len(fits), bool)
            twice[by[1:]] = equal
            twice[by[:-1]] |= equal
            now = np.zeros(m, bool)
            now[fits[twice]] = True
            now &= ~many
        else:
            now = np.zeros(m, bool)
        closed = np.flatnonzero((since >= 0) & ~now)
        out.append(np.column_stack([closed, since[closed], np.full(len(closed), low - 1)]))
        since = np.where(now, np.where(since < 0, low, since), -1)
    return np.concatenate(out)


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """Rows (d1, d2, begin, end) of bytes covered by a string of ``length`` that starts elsewhere too; they may overlap."""
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} or more")
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text")
    buckets = 4 * partitions(spark)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, starts, data in runs(batch.column(1)):
                _, h = anchors(starts, data, length)
                own, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], ["h", "n"])

    again = map_arrow(keyed, hashed, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    table = spark.sparkContext.broadcast(bit_table(again, F.col("h"), TABLE_BITS))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(table.value, np.uint8)
        held: dict[int, dict] = {}
        size = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, starts, data in runs(batch.column(1)):
                at, h = anchors(starts, data, length)
                keep = has_bits(seen, h)
                at, h = at[keep], h[keep]
                row = np.searchsorted(starts, at, "right") - 1
                raw = data.tobytes()
                keys: dict[int, tuple] = {}
                for a, r, g in zip(at.tolist(), row.tolist(), h.tolist(), strict=True):
                    lo, hi = int(starts[r]), int(starts[r + 1])
                    if r not in keys:
                        keys[r] = document_key(ids[first + r], raw[lo:hi])
                    context = raw[a : min(hi, a + length)], raw[max(lo, a - length + GRAM) : a][::-1]
                    of = held.setdefault(g % buckets, {})
                    if context not in of:
                        of[context] = []
                        size += len(context[0]) + len(context[1])
                    of[context].append((*keys[r], a - lo))
                    size += 100  # of a Python tuple
                    if size > HELD:  # a sorted run is sent out and a new one begun
                        yield from sent(held)
                        held, size = {}, 0
        yield from sent(held)

    rows = map_arrow(keyed, contexts, "bucket int, n_after binary, n_before binary, n_owners binary, ids binary, shared binary, sizes binary, rest binary")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list] = {}
        bucket = None
        for batch in batches:  # sorted by bucket
            for r in batch.to_pylist():
                if bucket is not None and r["bucket"] != bucket:
                    yield from spans_of(own.pop(bucket), length)
                bucket = r["bucket"]
                own.setdefault(bucket, []).append(r)
        if bucket is not None:
            yield from spans_of(own.pop(bucket), length)

    return map_arrow(rows.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket"), merged, "d1 long, d2 long, begin long, end long")


def document_key(doc_id: object, text: bytes) -> tuple[int, int]:
    """Two signed 64-bit hashes of id and text: equal rows share them, and so their spans."""
    d = xxhash.xxh3_128_intdigest(repr(doc_id).encode() + b"\0" + text)
    return tuple(x - (1 << 64) if x >> 63 else x for x in (d >> 64, d & ((1 << 64) - 1)))


def sent(held: dict[int, dict]) -> Iterator[pa.RecordBatch]:
    """Sorted, front-coded runs of distinct contexts with their owners, one row for each bucket."""
    for bucket, of in held.items():
        order = sorted(of, key=lambda c: c[0] + END + c[1])
        run = Run.of([after + END + before for after, before in order])
        ids = np.array([owner for c in order for owner in of[c]], np.int64)
        n_after, n_before = (np.array([len(c[k]) for c in order], np.uint16) for k in (0, 1))
        n_owners = np.array([len(of[c]) for c in order], np.uint32)
        cells = [bucket, n_after.tobytes(), n_before.tobytes(), n_owners.tobytes(), ids.tobytes(), run.shared.tobytes(), run.sizes.tobytes(), run.rest]
        kinds = [pa.int32(), *[pa.binary()] * 7]
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], ["bucket", "n_after", "n_before", "n_owners", "ids", "shared", "sizes", "rest"])


def spans_of(rows: list[dict], length: int) -> Iterator[pa.RecordBatch]:
    """Merge the runs of one bucket and give out the covered spans of its grams."""
    sources, after_of, ids_of, ends_of = [], [], [], []
    for r in rows:
        sources.append(iter(Run(np.frombuffer(r["shared"], np.uint16), np.frombuffer(r["sizes"], np.uint16), r["rest"])))
        after_of.append(np.frombuffer(r["n_after"], np.uint16).tolist())
        ids_of.append(np.frombuffer(r["ids"], np.int64).reshape(-1, 3))
        ends_of.append([0, *np.cumsum(np.frombuffer(r["n_owners"], np.uint32)).tolist()])
    nth = [0] * len(sources)
    group: list[tuple] = []  # (after, shared, before) of distinct contexts
    owners: list[np.ndarray] = []
    whose: list[int] = []  # context of each array of owners
    out: list[np.ndarray] = []

    def closed() -> None:
        """Spans of the gram whose contexts are in ``group``."""
        counts = np.bincount(whose, [len(o) for o in owners], len(group)).astype(np.int64)
        if counts.sum() < 2:
            return
        befores = [g[2] for g in group]
        order = sorted(range(len(group)), key=befores.__getitem__)
        shared_before = np.array([0] + [common(befores[a], befores[b]) for a, b in zip(order, order[1:], strict=False)])
        lengths = np.array([(len(g[0]), len(g[2]), g[1]) for g in group])
        ranges = repeated_ranges(lengths[:, 0], lengths[:, 1], lengths[:, 2], shared_before, np.array(order), counts > 1, length)
        if not len(ranges):
            return
        ids, first, size = np.concatenate(owners), np.cumsum(counts) - counts, counts[ranges[:, 0]]
        which = np.repeat(np.arange(len(ranges)), size)
        ids = ids[np.repeat(first[ranges[:, 0]] - np.cumsum(size) + size, size) + np.arange(len(which))]
        out.append(np.column_stack([ids[:, :2], ids[:, 2] - ranges[which, 2], ids[:, 2] - ranges[which, 1] + length]))

    last = b""
    for shared, source, whole in merge(sources):
        k = nth[source]
        nth[source] += 1
        cut = after_of[source][k]
        after, before = whole[:cut], whole[cut + len(END) :]
        if group and after[:GRAM] != last[:GRAM]:
            closed()
            group, owners, whose = [], [], []
        agree = min(common(group[-1][0], after, min(shared, cut, len(group[-1][0]))), cut) if group else 0
        if not (group and agree == len(after) == len(group[-1][0]) and group[-1][2] == before):
            group.append((after, agree, before))
        owners.append(ids_of[source][ends_of[source][k] : ends_of[source][k + 1]])
        whose.append(len(group) - 1)
        last = after
    if group:
        closed()
    if out:
        rows_out = np.unique(np.concatenate(out), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(rows_out[:, i].copy()) for i in range(4)], ["d1", "d2", "begin", "end"])


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row of ``docs``.

    Every byte covered by a string of ``length`` bytes that starts anywhere else
    too (judged on the input) goes; matches never cross rows. Null texts are
    empty. Rows equal in doc_id and text are copies of each other like others.
    An empty table gives an empty result. Other columns are not read.
    """
    spans = repeated_spans(docs, length)
    per_document = written(spans.groupBy("d1", "d2").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans")), "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            keys = [document_key(i, t.encode()) for i, t in zip(batch.column(0).to_pylist(), text.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), text, *(pa.array(c, pa.int64()) for c in (zip(*keys, strict=True) if keys else ([], [])))], ["doc_id", "text", "d1", "d2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, at, kept, n = text.encode(), 0, [], 0
                end = -1
                for s in spans or ():
                    if s["begin"] > end:
                        n += 1
                        kept.append(raw[at : s["begin"]])
                    end = max(end, s["end"])
                    at = end
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((len(raw), len(raw) - len(left), n, left))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [*[pa.int64()] * 3, pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = map_arrow(docs.select("doc_id", "text"), keyed, f"doc_id {kind}, text string, d1 long, d2 long").join(per_document, ["d1", "d2"], "left")
    return map_arrow(rows.select("doc_id", "text", "spans"), cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
