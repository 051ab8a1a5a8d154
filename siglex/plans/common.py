"""What the registered queries share: registration, common SQL and common pieces of Spark.

Every query reads whole tables. Doubles are rounded to six places and integers
are longs on both sides, so that two engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siglex.operators import bpe, signals
from siglex.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
BINS = 16
BANDS = {"low": (0.5, 4.0), "mid": (4.0, 12.0), "high": (12.0, 32.0)}


def plain(df: DataFrame) -> DataFrame:
    """Integers as longs, doubles rounded and without negative zero."""
    casts = {"int": lambda c: F.col(c).cast("long"), "double": lambda c: F.round(c, 6) + F.lit(0.0)}
    return df.select(*(casts.get(t, F.col)(c).alias(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            SQL[name] = "WITH " + sql if sql.lstrip()[:1] != "(" and not sql.lstrip().upper().startswith("SELECT") else sql
        return f

    return add


def r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0::DOUBLE AS {name}"


# --- shared pieces of SQL -------------------------------------------------
SIGNAL = "s AS (SELECT user_id AS subject, event_type AS channel, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS t, value::DOUBLE AS x, ts FROM events)"
ZSQL = SIGNAL + ", z AS (SELECT *, round((x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1e-8::DOUBLE), 9) AS z FROM s WINDOW w AS (PARTITION BY subject, channel))"
UNI = "least(greatest(floor((least(greatest(z, -4.0::DOUBLE), 4.0::DOUBLE) + 4.0::DOUBLE) / 8.0000000001::DOUBLE * {b}::DOUBLE), 0), {b} - 1)::BIGINT"
MUZ = "(least(greatest(z, -4.0::DOUBLE), 4.0::DOUBLE) / 4.0::DOUBLE)"
MU = f"(sign({MUZ}) * ln(1 + 255.0::DOUBLE * abs({MUZ})) / ln(256.0::DOUBLE))"
MUCODE = f"least(greatest(floor(({MU} + 1.0::DOUBLE) / 2.0000000001::DOUBLE * {{b}}::DOUBLE), 0), {{b}} - 1)::BIGINT"
MUVAL = "(sign(-1 + (code + 0.5) * 2.0 / {b}) / 255.0 * (pow(256.0, abs(-1 + (code + 0.5) * 2.0 / {b})) - 1) * 4.0)::DOUBLE"
CODES = ZSQL + f", c AS (SELECT subject, channel, t AS pos, {UNI.format(b=BINS)} AS tok FROM z)"
CH = """chars AS (SELECT lang AS dataset, source AS subject, doc_id AS trial, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL AND text <> ''),
alphabet AS (SELECT ch, row_number() OVER (ORDER BY encode(ch)) - 1 AS tok FROM (SELECT DISTINCT ch FROM chars)),
d AS (SELECT dataset, subject, trial, pos, tok FROM chars JOIN alphabet USING (ch))"""
EMB = "e AS (SELECT vec_id % 10 AS subject, vec_id AS trial, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS t FROM embeddings)"
LI = """li AS (SELECT l_suppkey AS subject, l_returnflag AS trial, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS t, l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax FROM lineitem)"""


def merge_sql(source: str, k: int, left: str, right: str, new: int, given: str = "") -> str:
    """CTEs that apply one merge to ``source`` (subject, channel, pos, tok), giving q{k}."""
    w = "(PARTITION BY subject, channel ORDER BY pos)"
    return f"""a{k} AS (SELECT *, lead(tok) OVER {w} AS nxt, row_number() OVER {w} - row_number() OVER (PARTITION BY subject, channel, tok ORDER BY pos) AS g FROM {source}),
b{k} AS (SELECT *, row_number() OVER (PARTITION BY subject, channel, tok, g ORDER BY pos) AS kk FROM a{k}),
h{k} AS (SELECT b{k}.subject, b{k}.channel, pos, tok, coalesce(tok = {left} AND nxt = {right} AND ({left} <> {right} OR kk % 2 = 1), false) AS hit FROM b{k}{given}),
g{k} AS (SELECT *, coalesce(lag(hit) OVER {w}, false) AS gone FROM h{k}),
q{k} AS (SELECT subject, channel, row_number() OVER {w} - 1 AS pos, CASE WHEN hit THEN {new} ELSE tok END AS tok FROM g{k} WHERE NOT gone)"""


def train_sql(m: int) -> str:
    parts, source = [CODES], "c"
    for k in range(m):
        parts.append(f"""p{k} AS (SELECT l, r, count(*) AS n FROM (SELECT tok AS l, lead(tok) OVER (PARTITION BY subject, channel ORDER BY pos) AS r FROM {source}) WHERE r IS NOT NULL GROUP BY l, r ORDER BY n DESC, l, r LIMIT 1)""")
        parts.append(merge_sql(source, k, f"p{k}.l", f"p{k}.r", BINS + k, f", p{k}"))
        source = f"q{k}"
    return ",\n".join(parts)


def train_by_sql(m: int) -> str:
    """CTEs of ``m`` merges for each channel: p{k} has one pair a channel."""
    parts, source = [CODES], "c"
    for k in range(m):
        parts.append(f"""p{k} AS (SELECT channel, l, r, n FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY n DESC, l, r) AS i FROM (SELECT channel, l, r, count(*) AS n FROM (SELECT channel, tok AS l, lead(tok) OVER (PARTITION BY subject, channel ORDER BY pos) AS r FROM {source}) WHERE r IS NOT NULL GROUP BY ALL)) WHERE i = 1 AND n > 1)""")
        parts.append(merge_sql(source, k, f"p{k}.l", f"p{k}.r", BINS + k, f" JOIN p{k} USING (channel)"))
        source = f"q{k}"
    return ",\n".join(parts)


def vocabulary_sql(m: int) -> str:
    """CTEs after train_sql: voc (id, seq), the base sequence of every id."""
    parts, source = [f"v0 AS (SELECT k::BIGINT AS id, [k] AS seq FROM (SELECT unnest(range({BINS})) AS k))"], "v0"
    for k in range(m):
        parts.append(f"v{k + 1} AS (SELECT * FROM {source} UNION ALL SELECT {BINS + k}, list_concat(x.seq, y.seq) FROM p{k}, {source} x, {source} y WHERE x.id = p{k}.l AND y.id = p{k}.r)")
        source = f"v{k + 1}"
    return ",\n" + ",\n".join(parts) + f", voc AS (SELECT * FROM {source})"


# --- pieces of Spark ------------------------------------------------------
def z_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.zscore(T.events_signal(spark, sf_dir))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.quantise(z_of(spark, sf_dir), "uniform", BINS).select("subject", "channel", F.col("t").alias("pos"), F.col("code").alias("tok"))


KEY = ["subject", "channel"]
MERGES = 4


def merges(spark: SparkSession, sf_dir: str) -> bpe.Merges:
    return bpe.train(bpe.sequences(codes(spark, sf_dir), KEY), BINS, BINS + MERGES)
