"""Queries of vocabularies, token views and token features."""

from __future__ import annotations

from pyspark.sql import functions as F

from siglex.operators import bpe, signals, stats
from siglex.plans.common import BINS, CODES, KEY, MERGES, codes, merge_sql, merges, query, r, train_by_sql, train_sql, vocabulary_sql
from siglex.sources import shared
from siglex.sources import tables as T

TABLE = " UNION ALL ".join(f"SELECT {k}::BIGINT AS rank, l, r, {BINS + k}::BIGINT AS new_id FROM p{k}" for k in range(MERGES))
LAST = f"q{MERGES - 1}"
VOCABULARY = BINS + MERGES


def _seqs(spark, sf):
    return bpe.sequences(codes(spark, sf), KEY)


def _tokens(spark, sf, of=None):
    return bpe.exploded(bpe.tokenise(_seqs(spark, sf), merges(spark, sf) if of is None else of, BINS), KEY)


@query("vocabulary_saved", train_sql(MERGES) + " " + TABLE)
def _(spark, sf):
    place = shared.path(spark, "vocabulary")
    bpe.save_vocabulary(spark, merges(spark, sf), BINS, place)
    return bpe.merge_table(spark, *bpe.load_vocabulary(spark, place))


@query("vocabulary_decoded", train_sql(MERGES) + vocabulary_sql(MERGES) + " SELECT id AS token, list_aggregate(seq, 'string_agg', ' ') AS base_seq, len(seq) AS base_len FROM voc")
def _(spark, sf):
    v = bpe.vocabulary_table(spark, merges(spark, sf), BINS)
    return v.select("token", F.array_join(F.transform("base_seq", lambda c: c.cast("string")), " ").alias("base_seq"), "base_len")


@query("training_progress", train_sql(MERGES) + ", whole AS (SELECT count(*) AS n FROM c) " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS step, p{k}.l, p{k}.r, {BINS + k}::BIGINT AS new_id, p{k}.n AS pair_count, (SELECT count(*) FROM q{k}) AS total_tokens, round(whole.n / (SELECT count(*) FROM q{k}), 9) AS compression FROM p{k}, whole" for k in range(MERGES)))
def _(spark, sf):
    seqs, progress = _seqs(spark, sf), []
    bpe.train(seqs, BINS, VOCABULARY, progress=progress)
    return bpe.progress_table(spark, progress, seqs.agg(F.sum(F.size("toks"))).first()[0]).withColumn("compression", F.round("compression", 9))


def _lazy_sql(m: int) -> str:
    parts, source = [CODES], "c"
    for k in range(m):
        parts.append(f"n{k} AS (SELECT l, r, count(*) AS n FROM (SELECT tok AS l, lead(tok) OVER (PARTITION BY subject, channel ORDER BY pos) AS r FROM {source}) WHERE r IS NOT NULL GROUP BY l, r)")
        parts.append(f"p{k} AS (SELECT x.l, x.r, x.n FROM n{k} x LEFT JOIN n0 y USING (l, r) WHERE x.l >= {BINS} OR x.r >= {BINS} OR x.n = y.n ORDER BY x.n DESC, x.l, x.r LIMIT 1)")
        parts.append(merge_sql(source, k, f"p{k}.l", f"p{k}.r", BINS + k, f", p{k}"))
        source = f"q{k}"
    return ",\n".join(parts)


@query("bpe_train_lazy", _lazy_sql(MERGES) + " " + TABLE)
def _(spark, sf):
    return bpe.merge_table(spark, bpe.train(_seqs(spark, sf), BINS, VOCABULARY, selection="lazy_heap"), BINS)


@query("bpe_subvocabulary", train_sql(2) + " SELECT * FROM q1")
def _(spark, sf):
    return _tokens(spark, sf, bpe.prefix(merges(spark, sf), BINS, BINS + 2))


def _constant_sql(pairs) -> str:
    parts, source = [CODES], "c"
    for k, (a, b) in enumerate(pairs):
        parts.append(merge_sql(source, k, str(a), str(b), BINS + k))
        source = f"q{k}"
    return ",\n".join(parts)


_RANDOM = bpe.random_merges(BINS, 5)


@query("bpe_random_vocabulary", _constant_sql(_RANDOM) + " SELECT tok AS token, count(*) AS n FROM q4 GROUP BY tok")
def _(spark, sf):
    return _tokens(spark, sf, _RANDOM).groupBy(F.col("tok").alias("token")).agg(F.count("*").alias("n"))


@query("bpe_subsample", CODES + ", k AS (SELECT subject, channel, count(*) AS n, md5('42:' || subject || ':' || channel) AS h FROM c GROUP BY ALL), m AS (SELECT greatest(1, count(*) * 500 // sum(n)) AS keep FROM k) SELECT subject, channel, n FROM (SELECT *, row_number() OVER (ORDER BY h, subject, channel) AS i FROM k), m WHERE i <= keep")
def _(spark, sf):
    return bpe.subsample(_seqs(spark, sf), KEY, 500).select(*KEY, F.size("toks").alias("n"))


@query("bpe_two_level", train_sql(MERGES) + f" SELECT * FROM (SELECT 2::BIGINT AS level, subject, channel, count(*) AS n_tokens FROM {LAST} GROUP BY ALL UNION ALL SELECT 1, subject, channel, count(*) FROM q1 GROUP BY ALL)")
def _(spark, sf):
    seqs = _seqs(spark, sf)
    one, _, two = bpe.two_level(seqs, BINS, BINS + 2, VOCABULARY)
    sizes = lambda s, k: s.select(F.lit(k).alias("level"), *KEY, F.size("toks").alias("n_tokens"))
    return sizes(two, 2).unionByName(sizes(bpe.tokenise(seqs, one, BINS), 1))


def _first_pair_sql(source: str) -> str:
    return f"(SELECT l, r, count(*) AS n FROM (SELECT tok AS l, lead(tok) OVER (PARTITION BY subject, channel ORDER BY pos) AS r FROM {source}) WHERE r IS NOT NULL GROUP BY l, r ORDER BY n DESC, l, r LIMIT 1)"


@query("bpe_universal", train_sql(3).replace("p0 AS", "d AS (SELECT channel, subject FROM (SELECT channel, subject, row_number() OVER (PARTITION BY channel ORDER BY subject) AS i FROM (SELECT DISTINCT channel, subject FROM c)) WHERE i <= 9),\nc1 AS (SELECT c.* FROM c SEMI JOIN d USING (channel, subject)),\np0 AS", 1).replace("FROM c)", "FROM c1)").replace("FROM c1)) WHERE i <= 9", "FROM c)) WHERE i <= 9").replace("AS g FROM c,", "AS g FROM c1,").replace("AS g FROM c)", "AS g FROM c1)") + " " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS rank, l, r, n FROM p{k}" for k in range(3)))
def _(spark, sf):
    some = bpe.first_of_each(_seqs(spark, sf), ["channel"], ["subject"], 9)
    progress: list = []
    bpe.train(some, BINS, BINS + 3, progress=progress)
    return spark.createDataFrame(progress, "rank int, l int, r int, new_id int, n long, total long").select("rank", "l", "r", "n")


@query("bpe_by_key", train_by_sql(3) + " " + " UNION ALL ".join(f"SELECT channel, {k}::BIGINT AS rank, l, r, n FROM p{k}" for k in range(3)))
def _(spark, sf):
    return bpe.train_by(codes(spark, sf), KEY, ["channel"], BINS, 3)[0].select("channel", "rank", "l", "r", "n")


def _transfer_sql(m: int) -> str:
    """Vocabularies of all channels applied to all channels: the key's channel becomes source and target."""
    parts = [train_by_sql(m), "x0 AS (SELECT subject, s.channel || '>' || c.channel AS channel, s.channel AS source, pos, tok FROM c, (SELECT DISTINCT channel FROM p0) s)"]
    source = "x0"
    for k in range(m):
        given = f" LEFT JOIN (SELECT channel AS src, l, r FROM p{k}) v ON v.src = split_part(b9{k}.channel, '>', 1)"
        parts.append(merge_sql(source, f"9{k}", "v.l", "v.r", BINS + k, given))
        source = f"q9{k}"
    return ",\n".join(parts)


@query("bpe_transfer", _transfer_sql(2) + " SELECT split_part(channel, '>', 1) AS source, split_part(channel, '>', 2) AS target, count(*) AS n_tokens FROM q91 GROUP BY ALL")
def _(spark, sf):
    every = codes(spark, sf)
    table, _ = bpe.train_by(every, KEY, ["channel"], BINS, 2)
    learnt: dict = {}
    for x in table.orderBy("rank").collect():  # two merges a vocabulary
        learnt.setdefault(x.channel, []).append((x.l, x.r))
    seqs = bpe.sequences(every, KEY)
    parts = [bpe.tokenise(seqs, m, BINS).groupBy(F.lit(c).alias("source"), F.col("channel").alias("target")).agg(F.sum(F.size("toks")).alias("n_tokens")) for c, m in sorted(learnt.items())]
    return T.union_results(*parts)


SIZES = (10, 25, 50, 100)


def _sizes_sql() -> str:
    parts = [CODES, "k AS (SELECT subject, channel, row_number() OVER (ORDER BY subject, channel) AS i FROM (SELECT DISTINCT subject, channel FROM c))"]
    rows = []
    for n in (*SIZES, "all"):
        parts.append(f"c{n} AS (SELECT c.* FROM c JOIN k USING (subject, channel)" + (")" if n == "all" else f" WHERE i <= {n})"))
        source = f"c{n}"
        for j in range(MERGES):
            k = f"{n}x{j}"
            parts.append(f"p{k} AS (SELECT * FROM {_first_pair_sql(source)})")
            parts.append(merge_sql(source, k, f"p{k}.l", f"p{k}.r", BINS + j, f", p{k}"))
            source = f"q{k}"
            rows.append(f"SELECT (SELECT count(*) FROM k{'' if n == 'all' else f' WHERE i <= {n}'}) AS n_sequences, {j}::BIGINT AS rank, l, r, n, (SELECT count(*) FROM q{k}) AS total_tokens FROM p{k}")
    return ",\n".join(parts) + " " + " UNION ALL ".join(rows)


@query("bpe_corpus_sizes", _sizes_sql())
def _(spark, sf):
    return bpe.by_corpus_size(_seqs(spark, sf), KEY, (*SIZES, None), BINS, VOCABULARY).select("n_sequences", "rank", "l", "r", "n", "total_tokens")


def _discriminative_sql(m: int, alpha: float, top: int) -> str:
    parts, source = [CODES], "c"
    for k in range(m):
        parts.append(f"""w{k} AS (SELECT channel AS label, l, r, count(*) AS n FROM (SELECT channel, tok AS l, lead(tok) OVER (PARTITION BY subject, channel ORDER BY pos) AS r FROM {source}) WHERE r IS NOT NULL GROUP BY ALL),
tot{k} AS (SELECT label, sum(n) AS total FROM w{k} GROUP BY label), hd{k} AS (SELECT l, r, sum(n)::BIGINT AS a FROM w{k} GROUP BY l, r ORDER BY a DESC, l, r LIMIT {top}),
rt{k} AS (SELECT hd{k}.l, hd{k}.r, a, coalesce(n, 0) / total AS rate FROM hd{k} CROSS JOIN tot{k} LEFT JOIN w{k} p ON p.l = hd{k}.l AND p.r = hd{k}.r AND p.label = tot{k}.label),
p{k} AS (SELECT l, r, max(a) AS n, round(pow(max(a)::DOUBLE, {1 - alpha}) * pow(stddev_pop(rate), {alpha}), 9) AS score FROM rt{k} GROUP BY l, r ORDER BY score DESC, n DESC, l, r LIMIT 1)""")
        parts.append(merge_sql(source, k, f"p{k}.l", f"p{k}.r", BINS + k, f", p{k}"))
        source = f"q{k}"
    return ",\n".join(parts)


@query("bpe_train_discriminative", _discriminative_sql(3, 0.5, 20) + " " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS rank, l, r, n, {r('score', 'score')} FROM p{k}" for k in range(3)))
def _(spark, sf):
    return bpe.train_discriminative(codes(spark, sf), KEY, "channel", BINS, 3, 0.5, 20)


@query("channel_sequences", CODES + ", q AS (SELECT subject, channel, list(tok ORDER BY pos) AS toks FROM c GROUP BY subject, channel) SELECT subject, channel, list_aggregate(list_concat(toks, [17 FOR x IN range(12)])[1:12], 'string_agg', ',') AS toks, least(len(toks), 12) AS n_tokens FROM q")
def _(spark, sf):
    return bpe.channel_view(_seqs(spark, sf), KEY, "toks", 12, 17).select(*KEY, F.array_join(F.transform("toks", lambda x: x.cast("string")), ",").alias("toks"), "n_tokens")


@query("component_sequences", CODES + ", q AS (SELECT subject, channel, list(tok ORDER BY pos) AS toks FROM c GROUP BY subject, channel), j AS (SELECT subject, flatten(list(list_append(toks, 16) ORDER BY channel)) AS f FROM q GROUP BY subject) SELECT subject, list_aggregate(list_concat(f, [17 FOR x IN range(80)])[1:80], 'string_agg', ',') AS flat FROM j")
def _(spark, sf):
    return bpe.component_view(_seqs(spark, sf), ["subject"], "channel", 16, 17, 80).select("subject", F.array_join(F.transform("flat", lambda x: x.cast("string")), ",").alias("flat"))


# --- features ---
@query("hist_tokens", train_sql(MERGES) + f" SELECT subject, channel, tok AS token, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY subject, channel)', 'share')} FROM {LAST} GROUP BY subject, channel, tok")
def _(spark, sf):
    return stats.histogram(_tokens(spark, sf), KEY)


_WINDOWED = CODES + ", w AS (SELECT subject, channel || '#' || least(pos // greatest((max(pos) OVER (PARTITION BY subject, channel) + 1) // 4, 1), 3) AS channel, pos, tok FROM c)"


def _windowed_sql(m: int) -> str:

    parts, source = [train_sql(m), _WINDOWED[len(CODES) + 2 :]], "w"
    for k in range(m):
        parts.append(merge_sql(source, f"8{k}", f"p{k}.l", f"p{k}.r", BINS + k, f", p{k}"))
        source = f"q8{k}"
    return ",\n".join(parts)


@query("hist_windowed_tokens", _windowed_sql(MERGES) + f" SELECT subject, split_part(channel, '#', 1) AS channel, split_part(channel, '#', 2)::BIGINT AS \"window\", tok AS token, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY subject, channel)', 'share')} FROM q8{MERGES - 1} GROUP BY subject, channel, tok")
def _(spark, sf):
    windows = stats.windowed(codes(spark, sf), KEY, 4)
    seqs = bpe.sequences(windows, [*KEY, "window"])
    return stats.histogram(bpe.exploded(bpe.tokenise(seqs, merges(spark, sf), BINS), [*KEY, "window"]), [*KEY, "window"])


_ARTIFACT = train_sql(MERGES) + vocabulary_sql(MERGES) + ", far AS (SELECT id AS token, list_max(list_transform(seq, lambda v: abs(v - 7.5::DOUBLE))) AS distance FROM voc), cut AS (SELECT quantile_cont(distance, 0.75) AS cut FROM far WHERE distance > 0), art AS (SELECT token, distance FROM far, cut WHERE distance > cut)"


@query("artifact_tokens", _ARTIFACT + f" SELECT token, {r('distance', 'distance')} FROM art")
def _(spark, sf):
    return stats.artifact_tokens(bpe.vocabulary_table(spark, merges(spark, sf), BINS), BINS, 0.75)


@query("hist_masked", _ARTIFACT + f" SELECT subject, channel, tok AS token, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY subject, channel)', 'share')} FROM {LAST} WHERE tok NOT IN (SELECT token FROM art) GROUP BY subject, channel, tok")
def _(spark, sf):
    learnt = merges(spark, sf)
    bad = stats.artifact_tokens(bpe.vocabulary_table(spark, learnt, BINS), BINS, 0.75)
    return stats.masked(stats.histogram(_tokens(spark, sf, learnt), KEY), KEY, bad)


@query("feature_concat", train_sql(MERGES) + f""", g AS (SELECT subject, channel, tok, lead(tok) OVER (PARTITION BY subject, channel ORDER BY pos) AS r FROM {LAST}),
f AS (SELECT subject, channel, tok::VARCHAR AS feature, count(*) AS n FROM g GROUP BY ALL), b AS (SELECT subject, channel, tok || ':' || r AS feature, count(*) AS n FROM g WHERE r IS NOT NULL GROUP BY ALL)
SELECT subject, channel, feature, {r('n / sum(n) OVER (PARTITION BY subject, channel)', 'share')} FROM f UNION ALL SELECT subject, channel, feature, {r('n / sum(n) OVER (PARTITION BY subject, channel)', 'share')} FROM b""")
def _(spark, sf):
    t = _tokens(spark, sf)
    both = stats.concatenated(stats.histogram(t, KEY), stats.capped_bigrams(t, KEY, VOCABULARY), KEY)
    one = F.transform("tokens", lambda x: F.struct(x["token"].cast("string").alias("feature"), x["share"].alias("share")))
    two = F.transform("bigrams", lambda x: F.struct(F.concat_ws(":", x["l"].cast("string"), x["r"].cast("string")).alias("feature"), x["share"].alias("share")))
    return both.select(*KEY, F.inline(F.concat(one, two)))


@query("spectral_compression", train_sql(MERGES) + f" SELECT {r('(SELECT avg(n) FROM (SELECT count(*) AS n FROM c GROUP BY subject, channel)) / (SELECT avg(n) FROM (SELECT count(*) AS n FROM ' + LAST + ' GROUP BY subject, channel))', 'compression')}")
def _(spark, sf):
    seqs = _seqs(spark, sf)
    return stats.mean_compression(seqs, bpe.tokenise(seqs, merges(spark, sf), BINS))


@query("top_tokens", train_sql(MERGES) + vocabulary_sql(MERGES) + f" SELECT tok AS token, count(*) AS n, max(len(seq)) AS base_len FROM {LAST} JOIN voc ON id = tok GROUP BY tok ORDER BY n DESC, tok LIMIT 20")
def _(spark, sf):
    learnt = merges(spark, sf)
    n = _tokens(spark, sf, learnt).groupBy(F.col("tok").alias("token")).agg(F.count("*").alias("n"))
    return n.join(bpe.vocabulary_table(spark, learnt, BINS), "token").select("token", "n", "base_len").orderBy(F.desc("n"), "token").limit(20)


@query("token_stats_by", train_sql(MERGES) + vocabulary_sql(MERGES) + f" SELECT channel, count(*) AS total_tokens, sum(len(seq))::BIGINT AS base_tokens, {r('sum(len(seq)) / count(*)', 'compression')}, count(DISTINCT tok) AS unique_tokens, {r(f'count(DISTINCT tok) / {VOCABULARY}', 'utilisation')}, max(len(seq)) AS max_len FROM {LAST} JOIN voc ON id = tok GROUP BY channel")
def _(spark, sf):
    learnt = merges(spark, sf)
    return stats.token_stats(_tokens(spark, sf, learnt), bpe.vocabulary_table(spark, learnt, BINS), ["channel"])


@query("compression_ratio", train_sql(MERGES) + f", x AS (SELECT subject, channel, count(*) AS a FROM c GROUP BY ALL), y AS (SELECT subject, channel, count(*) AS b FROM {LAST} GROUP BY ALL) SELECT {r('avg(a / b)', 'ratio')}, {r('avg(a / b) * 1000 / 64.0', 'token_ms')} FROM x JOIN y USING (subject, channel)")
def _(spark, sf):
    seqs = _seqs(spark, sf)
    return stats.compression(seqs, bpe.tokenise(seqs, merges(spark, sf), BINS), KEY, 64.0)
