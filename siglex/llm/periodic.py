"""Operator 13: periodic runs of words, by Lyndon roots from the grouping phase of suffix sorting.

A text's words become ids of its own. Stretches that can hold a run at all are
kept (``stretches``, an exact necessary condition on repeated word grams). On each,
the first phase of Baier's suffix sorter groups suffixes by their longest Lyndon
prefix (``lyndon_array``), once under the order of ids and once under the
reverse; every run has a root among these words, and a root that is repeated
is extended to both sides by common extensions (``runs_of``) into its run.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siglex.llm.arrow_text import map_arrow, mixed

Run = tuple[int, int, int]  # start, length, period
Words = list[bytes]


def lyndon_array(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each place.

    Groups of suffixes are taken from the greatest down. Each suffix of the group at hand
    points to the nearest place on its left in a lower group; places with pointers
    leave their group for one directly above it, by their number of pointers, and
    their word grows by the group's word for each pointer.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    members = [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(symbols[order])) + 1)] if n else []
    size = [1] * len(members)  # of a group's word
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    group = [0] * n
    for k, own in enumerate(members):
        for i in own:
            group[i] = k
    waits = list(range(n))  # waits[i] = i until i's group was taken, then a place further left or -1
    out = [0] * n
    now = len(members) - 1
    while now >= 0:
        own = [i for i in members[now] if group[i] == now]
        for i in own:
            waits[i] = i - 1
            out[i] = size[now]
        pointers: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and waits[j] != j:
                k = waits[j]
                waits[j] = waits[k] if k >= 0 else -1
                j = k
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in pointers.items():
            moved.setdefault((-times, group[j]), []).append(j)
        for less, old in sorted(moved):  # the most pointers first, as later ones go in between
            new, top = len(members), above[old]
            members.append(moved[less, old])
            size.append(size[old] - less * size[now])
            below.append(old)
            above.append(top)
            above[old] = new
            if top >= 0:
                below[top] = new
            for j in moved[less, old]:
                group[j] = new
        now = below[now]
    return np.array(out, np.int64)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many places from the first on agree, by doubling blocks."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        differ = a[at : min(at + step, n)] != b[at : min(at + step, n)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, 2 * step
    return n


def runs_of(symbols: np.ndarray, min_length: int, min_periods: int) -> list[Run]:
    """All maximal runs of least period p and length >= max(min_length, min_periods * p), by start and period.

    A root starts within the first period of its run, so in a run of three periods it stands twice
    in a row: a root (i, p) counts if it agrees with the next p places at three
    of them, and is then extended to the left and to the right of i and i + p.
    Roots inside the last run of their period are skipped.
    """
    if min_periods < 3:
        raise ValueError("a run of fewer than three periods may hold no root twice in a row")
    n = len(symbols)
    found: set[Run] = set()
    for ids in (symbols, symbols.max(initial=0) - symbols):
        period = lyndon_array(ids)
        i = np.flatnonzero(np.arange(n) + 2 * period <= n)
        p = period[i]
        for part in (lambda q: 0 * q, lambda q: q - 1, lambda q: q // 2):
            same = symbols[i + part(p)] == symbols[i + p + part(p)]
            i, p = i[same], p[same]
        last: dict[int, int] = {}
        for at, q in sorted(zip(i.tolist(), p.tolist(), strict=True)):
            if at + q <= last.get(q, 0):
                continue
            right = _common(symbols[at:], symbols[at + q :])
            back = _common(symbols[:at][::-1], symbols[: at + q][::-1])
            length = back + q + right
            last[q] = at - back + length
            if length >= max(min_length, min_periods * q):
                found.add((at - back, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(symbols: np.ndarray, min_length: int, min_periods: int) -> list[tuple[int, int]]:
    """Places [a, b) outside of which no run lies.

    In a run of length L >= max(min_length, min_periods * q) every word lies in a gram of half the
    repeated part (L - q words or more) that stands there twice, so words in
    no repeated gram belong to no run. Grams are told apart by a hash; equal hashes of
    different grams only leave more words in.
    """
    gram = max(1, (min_length - min_length // min_periods) // 2)
    if len(symbols) < max(min_length, min_periods):
        return []
    h, size = mixed(symbols.astype(np.uint64) + np.uint64(1)), 1
    for bit in bin(gram)[3:]:
        h, size = mixed(h[: len(h) - size] + np.uint64(3) * h[size:]), 2 * size
        if bit == "1":
            ids = mixed(symbols[size:].astype(np.uint64) + np.uint64(1))
            h, size = mixed(h[: len(ids)] + np.uint64(5) * ids), size + 1
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return []
    at = np.flatnonzero(np.isin(h, twice))
    steps = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + gram, -1)
    inside = np.concatenate([[0], (np.cumsum(steps)[:-1] > 0).astype(np.int8), [0]])
    edge = np.diff(inside)
    return [(a, b) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True) if b - a >= min_length]


def runs(words: Words, min_length: int, min_periods: int) -> list[Run]:
    """The runs of a sequence of words, by start and period."""
    if len(words) < min_length:
        return []
    known: dict[bytes, int] = {}
    symbols = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    out = [(a + start, length, q) for a, b in stretches(symbols, min_length, min_periods) for start, length, q in runs_of(symbols[a:b], min_length, min_periods)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: Words, found: list[Run]) -> Words:
    """The words without what a run holds after its first period."""
    if not found:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        steps[start + q] += 1
        steps[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps)[:-1] == 0).tolist()]


def periodic_runs(docs: DataFrame, min_length: int = 24, min_periods: int = 3, prepare: Callable[[object, Words], Words] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period; by start, then period), text without the repeated periods.

    Words are what stands between white space, compared byte for byte; ``text`` joins those that stay by
    one blank. A run is a longest stretch of least period q of at least ``min_length``
    words and ``min_periods`` * q. Null and empty texts have no words and no
    runs; repeated rows give repeated rows; an empty table gives an empty result; doc_id may be null and of any
    type; other columns are not read. ``prepare`` may change the words of a row first.
    Every row is worked on alone, in memory linear in its text, so there is no shuffle.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, texts = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "").to_pylist(), strict=True):
                words = text.encode().split()
                words = prepare(doc_id, words) if prepare else words
                own = runs(words, min_length, min_periods)
                counts.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                texts.append(b" ".join(collapsed(words, own)).decode())
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "text"])

    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("n_words long, runs array<struct<start:long,length:long,period:long>>, text string")])
    return map_arrow(docs.select("doc_id", "text"), made, schema)


def greatest(found: Column) -> Column:
    """The run of the greatest exact length / period, ties by start, then period; null without runs."""
    return F.reduce(found, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def listed(found: Column) -> Column:
    """All runs as lines ``start,length,period``."""
    return F.concat_ws("", F.transform(found, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))


def repeated_tail(doc_id: object, words: Words) -> Words:
    """In one of ten rows by crc32 of the id, the words from some place on repeat with a period that the checksum sets; a null id changes nothing."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]
