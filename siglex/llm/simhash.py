"""Operator 12: near-duplicates by SimHash fingerprints and pivot distance tables.

A text's words (A-Z lower-cased, split at white space) give shingles of four
words, repeats included; a bit of its fingerprint is set if it is set in over
half of their XXH64 hashes. Fingerprints that differ in at most four bits link.

Candidates come from distances to reference fingerprints. The references of a
band are the patterns with a single bit, in that band; their distances to a
fingerprint, less that of the zero pattern, spell the band's bits. Sixty-four
bits are dealt into ``blocks`` bands, and two fingerprints within four bits agree
in all distances to the references of ``blocks - 4`` bands at least, so that every
link meets in a group of equal distances. Inside a group rows are sorted by their
distance to the first of ``REFERENCES`` (patterns over all 64 bits) and swept: a
pair of which any coordinate of the table differs by more than four is discarded
(by the triangle inequality it lies further apart), and the survivors are
verified bit by bit. A group of more than ``limit`` fingerprints is never held
by one task: it is cut into cells (see ``_cells``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siglex.llm.arrow_text import map_arrow, mixed
from siglex.llm.components import components
from siglex.llm.scratch import partitions, written

NEAR = 4  # bits
#: Fingerprints over all 64 bits, of a fixed seed; a few more no longer discard anything of note.
REFERENCES = mixed(np.arange(1, 25, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LIMIT = 4096  # fingerprints of a group that one task sweeps
STARS = 16  # references chosen among the members of a larger group
FEW = 1 << 22  # fingerprints up to which five bands are selective enough
ONES = np.uint64(0x0101010101010101)
SPAN = 255  # hashes that a counter of one byte holds


def hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, in order; of the whole sequence if it is shorter; none without words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, n)
    each = xxhash.xxh64_intdigest
    return np.array([each(joined[a:b], 42) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def majority(each: list[np.ndarray]) -> np.ndarray:
    """For every array of hashes, the word of the bits set in over half of them; zero for none.

    Eight counters of a byte ride in one 64-bit word, over at most 255 hashes at a time.
    """
    sizes = np.array([len(h) for h in each], np.int64)
    out = np.zeros(len(each), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    sizes = sizes[some]
    flat = np.concatenate([each[i] for i in some])
    spans = -(-sizes // SPAN)
    first = np.concatenate([[0], np.cumsum(spans)[:-1]])
    at = np.repeat(np.cumsum(sizes) - sizes, spans) + SPAN * (np.arange(spans.sum()) - np.repeat(first, spans))
    for k in range(8):  # bits k, k + 8, ... of every hash
        counts = np.add.reduceat((flat >> np.uint64(k)) & ONES, at).astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits = np.add.reduceat(counts.astype(np.int64), first, axis=0) * 2 > sizes[:, None]
        for j in range(8):
            out[some] |= set_bits[:, j].astype(np.uint64) << np.uint64(8 * j + k)
    return out


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long; null texts are empty and have 0."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = majority([hashes(t, width) for t in pc.fill_null(batch.column(1), "").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select("doc_id", "text"), made, docs.select("doc_id").schema.add("fp", "long"))


def _groups(nodes: DataFrame, blocks: int) -> DataFrame:
    """(g, d, fp): every fingerprint once for each choice of ``blocks - NEAR`` bands; ``g`` hashes its distances there, ``d`` is the first coordinate of the table."""
    edge = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum((1 << edge[k + 1]) - (1 << edge[k]) for k in chosen) for chosen in combinations(range(blocks), blocks - NEAR)]
    keys = F.array(*(F.xxhash64(F.lit(c), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for c, m in enumerate(masks)))
    return nodes.select(F.explode(keys).alias("g"), _distance(F.col("fp"), F.lit(_signed(int(REFERENCES[0])))).alias("d"), "fp")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_pairs(g: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of linked fingerprints with equal ``g``; rows come sorted by ``g`` and their distance to the first reference."""
    table = [np.bitwise_count(fp ^ r).astype(np.int8) for r in REFERENCES]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    alive = np.arange(len(fp))
    for step in range(1, len(fp)):
        alive = alive[alive < len(fp) - step]
        alive = alive[(g[alive] == g[alive + step]) & (table[0][alive + step] - table[0][alive] <= NEAR)]
        if not len(alive):
            break
        a, b = alive, alive + step
        for coordinate in table[1:]:
            kept = np.abs(coordinate[a] - coordinate[b]) <= NEAR
            a, b = a[kept], b[kept]
            if not len(a):
                break
        kept = np.bitwise_count(fp[a] ^ fp[b]) <= NEAR
        found.append((a[kept], b[kept]))
    both = tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    return both[0], both[1]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place reachable from each of ``n`` places by pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    while (root != root[root]).any():
        root = root[root]
    return root


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of sorted rows (g, d, fp), as stars: a fingerprint with the first of those it is tied to in its group."""

    def links(g: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        root = _roots(len(fp), *near_pairs(g, fp.view(np.uint64)))
        tied = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[tied]), pa.array(fp[root[tied]])], ["a", "b"])

    g, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        g = np.concatenate([g, batch.column(0).to_numpy()])
        fp = np.concatenate([fp, batch.column(2).to_numpy()])
        whole = int(np.searchsorted(g, g[-1], "left")) if len(g) else 0  # the last group may go on
        if whole:
            yield links(g[:whole], fp[:whole])
            g, fp = g[whole:], fp[whole:]
    yield links(g, fp)


def _cells(rows: DataFrame, limit: int, stars: int) -> tuple[DataFrame, DataFrame]:
    """For groups (g, fp) beyond the limit: (links to references, rows (g, d, fp) of pairs of cells).

    Members of a group within four bits of one of its references, ``stars`` of its members, link to
    it and need no comparison among themselves. The others and each star's members
    are cut into cells of at most about half the limit by a hash; every two cells meet as a
    group of its own, except two of one star. Rows are copied as often as
    their cell has partners, which grows with the group over the limit.
    """
    w = Window.partitionBy("g").orderBy(F.xxhash64("fp"), "fp")
    chosen = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= stars).groupBy("g").agg(F.collect_list("fp").alias("refs"))
    near = F.filter("refs", lambda r: _distance(r, F.col("fp")) <= NEAR)
    star = F.array_min(near)
    labelled = written(rows.join(chosen, "g").select("g", "d", "fp", star.isNull().alias("free"), F.coalesce(star, F.lit(0)).alias("star")), "simhash-stars")
    part = ["g", "free", "star"]
    sizes = labelled.groupBy(*part).agg(F.ceil(F.count("*") * 2 / limit).cast("int").alias("n"))
    cells = sizes.select("g", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct("free", "star", k.alias("cell")))).alias("a"))
    meet = cells.join(cells.withColumnRenamed("a", "b"), "g").where((F.col("a") <= F.col("b")) & (F.col("a.free") | F.col("b.free") | (F.col("a.star") != F.col("b.star"))))
    sides = meet.select("g", F.xxhash64("g", "a", "b").alias("pair"), F.explode(F.array_distinct(F.array("a", "b"))).alias("own")).select("g", "pair", "own.*")
    placed = labelled.join(sizes, part).select(*part, "d", "fp", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int").alias("cell"))
    met = placed.join(sides, [*part, "cell"]).select(F.col("pair").alias("g"), "d", "fp")
    return labelled.where("not free and star <> fp").select(F.col("fp").alias("a"), F.col("star").alias("b")), met


def links(nodes: DataFrame, blocks: int | None = None, limit: int = LIMIT, stars: int = STARS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fp`` within four bits, enough of them to tie all that are tied by any.

    ``blocks`` is five bands up to ``FEW`` fingerprints and six beyond (a choice of speed; links do not depend on it).
    """
    blocks = blocks or (NEAR + 1 if nodes.count() <= FEW else NEAR + 2)
    rows = _groups(nodes, blocks)
    hot = written(rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("g"), "simhash-hot")
    out = None
    if not hot.isEmpty():
        out, met = _cells(rows.join(hot, "g"), limit, stars)
        rows = rows.join(hot, "g", "left_anti").unionByName(met)
    swept = map_arrow(rows.repartition(partitions(nodes.sparkSession), "g").sortWithinPartitions("g", "d", "fp"), _swept, "a long, b long")
    return swept if out is None else swept.unionByName(out)


def simhash_components(docs: DataFrame, width: int = 4, blocks: int | None = None, limit: int = LIMIT, stars: int = STARS) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (least doc_id that links reach, its own included).

    Null and empty texts, and texts of white space, have the fingerprint zero and link like any
    other. Equal fingerprints are one node, so copies and repeated rows share a component
    and are never paired. A null doc_id keeps its row and ties others; where a component
    has no other id, component_id is null. doc_id may be of any type that
    has an order. An empty table gives an empty result; other columns are not read.
    """
    prints = written(fingerprints(docs, width), "simhash-prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    tied = written(components(written(links(nodes.select("fp"), blocks, limit, stars), "simhash-links")), "simhash-components")
    linked = nodes.join(tied.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = nodes.join(tied.join(least, "component").select(F.col("node").alias("fp"), "component_id", F.lit(True).alias("in")), "fp", "left")
    classes = classes.select("fp", F.when(F.col("in"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
