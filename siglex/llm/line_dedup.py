"""Operator 8, native: line dedup by sorted hashes, returning keep bitmaps.

Every line becomes a narrow row (hash of its key, document, position). The
rows are pre-aggregated by hash and a salt of the document, so that a line
that a third of all documents hold is spread over all tasks; the at most
``salts`` rows left of each hash are range-partitioned by hash, sorted by
document and position and streamed once, which gives the first occurrence and
the number of documents. Lines to drop go back to their documents as bitmaps
of 64-bit words that hold only words with a set bit; texts move once, to meet
their bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siglex.llm.scratch import partitions, written

#: ASCII white space \x20 \x09-\x0D, and the ASCII letters.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; lower() does just that where all bytes are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _documents(docs: DataFrame) -> DataFrame:
    """Documents with a key made of doc_id and text: equal rows share it, and so their (equal) bitmaps."""
    return docs.select(
        F.struct("*").alias("row"),
        F.xxhash64("doc_id", "text").alias("d1"),
        F.xxhash64(F.lit(1), "text", "doc_id").alias("d2"),
    )


def line_verdicts(docs: DataFrame, min_documents: int, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Rows (d1, d2, word, bits): the lines that go, as 64-bit words of each document's bitmap.

    A line goes if its key has ``min_chars`` code points or more and stands in
    ``min_documents`` documents or more; with ``keep_first`` its first
    occurrence by (doc_id, position) stays.
    """
    salts = partitions(docs.sparkSession)
    lines = (
        _documents(docs)
        .select("row.doc_id", "d1", "d2", F.posexplode(_lines(F.col("row.text"))).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "d1", "d2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    salted = lines.groupBy("h1", "h2", F.pmod("d1", F.lit(salts)).alias("salt")).agg(
        F.count_distinct("d1", "d2").alias("n"),
        F.min(F.struct("doc_id", "pos", "d1", "d2")).alias("at"),
    )
    of_hash = Window.partitionBy("h1", "h2")
    dropped = (
        salted.repartitionByRange("h1", "h2")
        .withColumn("n_documents", F.sum("n").over(of_hash.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("nth", F.row_number().over(of_hash.orderBy("at")))
        .where((F.col("nth") == 1) & (F.col("n_documents") >= min_documents))
        .select("h1", "h2", F.col("at").alias("first"))
    )
    dropped = written(dropped, "dropped-lines")  # so that the join below reads plain exchanges, which AQE can split
    gone = lines.join(dropped, ["h1", "h2"])
    if keep_first:
        gone = gone.where(~((F.col("first.d1") == F.col("d1")) & (F.col("first.d2") == F.col("d2")) & (F.col("first.pos") == F.col("pos"))))
    return gone.groupBy("d1", "d2", F.expr("pos div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))


def dedup_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """row (a struct of all columns), doc_id, bitmap, n_lines, n_dropped and kept text of every row of ``docs``.

    ``bitmap`` has (word, bits) pairs of dropped lines, by word; null where all
    lines stay. Null and empty texts are one empty line, which stays, as its key
    has no code point (with ``min_chars=0`` it is a line like others). Each row
    counts as a document of its own unless doc_id and text are both equal, in
    which case the rows count as one. An empty table gives an empty result.
    Other columns are carried in ``row`` only, so they cannot clash.
    """
    words = line_verdicts(docs, min_documents, min_chars, keep_first)
    bitmaps = words.groupBy("d1", "d2").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("bitmap"))
    places = F.flatten(
        F.transform(
            "bitmap",
            lambda w: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(F.getbit(w["bits"], k) == 1, (w["word"] * 64 + k).cast("int"))),
        )
    )
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.array_compact(places)),
        lambda i: F.get(F.col("lines"), i),
    )
    n_dropped = F.aggregate("bitmap", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w["bits"]))
    return (
        _documents(docs)
        .join(written(bitmaps, "keep-bitmaps"), ["d1", "d2"], "left")
        .withColumn("text", F.coalesce("row.text", F.lit("")))
        .withColumn("lines", _lines(F.col("text")))
        .select(
            "row",
            F.col("row.doc_id").alias("doc_id"),
            "bitmap",
            F.size("lines").cast("long").alias("n_lines"),
            F.coalesce(n_dropped, F.lit(0).cast("long")).alias("n_dropped"),
            F.when(F.col("bitmap").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        )
    )


def without_repeated_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``docs``, all columns, with the kept text (and its n_chars, if there is such a column); null texts stay null."""
    text = F.when(F.col("row.text").isNull(), F.lit(None)).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    rows = dedup_lines(docs, min_documents, min_chars, keep_first)
    return rows.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(g.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (g.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN g ON k.key = g.key GROUP BY doc_id
"""
