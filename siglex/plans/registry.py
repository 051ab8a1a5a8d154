"""The registered queries of the signal, token and statistics operators and their SQL twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siglex.functions import scalar as S
from siglex.operators import bpe, models, signals, spectra, stats
from siglex.plans.common import BANDS, BINS, CH, CODES, EMB, KEY, LI, MERGES, MU, MUCODE, MUVAL, QUERIES, SIGNAL, SQL, UNI, ZSQL, Query, codes, merge_sql, merges, query, r, train_sql, vocabulary_sql, z_of
from siglex.sources import tables as T


# --- sources --------------------------------------------------------------
@query("load_summary", SIGNAL + " SELECT channel AS label, count(DISTINCT subject) AS n_trials, count(DISTINCT subject) AS n_subjects, count(*) AS n_samples FROM s GROUP BY channel")
def _(spark, sf):
    return T.load_summary(T.events_signal(spark, sf))


@query("subject_subset", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY user_id LIMIT 20)")
def _(spark, sf):
    e = T.table(spark, sf, "events").withColumn("subject", F.col("user_id"))
    return T.first_subjects(e, 20).select("event_id", "user_id")


@query("label_encode", "SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def _(spark, sf):
    return T.encoded_labels(T.table(spark, sf, "events"), "event_type").groupBy("event_type", "code").agg(F.count("*").alias("n"))


@query("label_map", "SELECT r_name, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def _(spark, sf):
    o = T.table(spark, sf, "orders").join(T.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    nations = T.table(spark, sf, "nation").join(T.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumnRenamed("n_nationkey", "c_nationkey")
    return T.mapped_labels(o, nations, ["c_nationkey"]).groupBy("r_name", "o_orderpriority").agg(F.count("*").alias("n"))


@query("resume_pending", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem EXCEPT SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'A'")
def _(spark, sf):
    li = T.table(spark, sf, "lineitem")
    key = ["l_returnflag", "l_linestatus"]
    return T.pending(li.select(*key).distinct(), li.where("l_quantity >= 50 and l_returnflag = 'A'").select(*key).distinct(), key)


@query("latest_results", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(spark, sf):
    e = T.table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return T.latest_results(e, ["user_id", "event_type"], "at").select("user_id", "event_type", "event_id", "value")


# --- normalisation and quantisation ---------------------------------------
@query("zscore_rows", ZSQL + f" SELECT subject, channel, t, {r('z', 'z')} FROM z")
def _(spark, sf):
    return z_of(spark, sf).select("subject", "channel", "t", "z")


@query("mu_law_roundtrip", ZSQL + f" SELECT subject, channel, t, {r(MU, 'y')}, {r(f'sign({MU}) / 255.0::DOUBLE * (pow(256.0::DOUBLE, abs({MU})) - 1)', 'back')} FROM z")
def _(spark, sf):
    y = S.mu_compress(S.clip(F.col("z"), -4.0, 4.0) / F.lit(4.0))
    return z_of(spark, sf).select("subject", "channel", "t", y.alias("y"), S.mu_expand(y).alias("back"))


@query("quantize_uniform", ZSQL + f" SELECT subject, channel, t, {UNI.format(b=64)} AS code FROM z")
def _(spark, sf):
    return signals.quantise(z_of(spark, sf), "uniform", 64).select("subject", "channel", "t", "code")


@query("quantize_mu_law", ZSQL + f" SELECT subject, channel, t, {MUCODE.format(b=64)} AS code FROM z")
def _(spark, sf):
    return signals.quantise(z_of(spark, sf), "mu_law", 64).select("subject", "channel", "t", "code")


_EDGES = ", e AS (SELECT list_distinct(list_transform(quantile_cont(z, [k / 16.0 FOR k IN range(17)]), lambda v: round(v, 9))) AS u FROM z), i AS (SELECT list_sort(u) AS edges FROM e)"


@query("quant_edges", ZSQL + _EDGES + f" SELECT k, {r('edges[k]', 'edge')} FROM (SELECT edges, unnest(range(1, len(edges) + 1)) AS k FROM i)")
def _(spark, sf):
    return signals.adaptive_edges(z_of(spark, sf), BINS).select(F.posexplode("edges").alias("k", "edge")).select((F.col("k") + 1).alias("k"), "edge")


@query("quantize_adaptive", ZSQL + _EDGES + " SELECT subject, channel, t, len(list_filter(edges[2:-2], lambda v: v <= z)) AS code FROM z, i")
def _(spark, sf):
    return signals.quantise(z_of(spark, sf), "adaptive", BINS).select("subject", "channel", "t", "code")


GRID_BINS = (8, 16, 32, 64, 128, 256)
_GRID = ", ".join(
    f"d{m}{b} AS (SELECT '{name}' AS method, {b} AS n_bins, z, {value.format(b=b)} AS v FROM (SELECT z, {code.format(b=b)} AS code FROM z))"
    for m, name, code, value in (("u", "uniform", UNI, "(-4.0::DOUBLE + (code + 0.5::DOUBLE) * (8.0::DOUBLE / {b}))"), ("m", "mu_law", MUCODE, MUVAL))
    for b in GRID_BINS
) + ", " + ", ".join(
    f"ea{b} AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(z, [k / {b}.0 FOR k IN range({b + 1})]), lambda v: round(v, 9)))) AS edges FROM z), ca{b} AS (SELECT z, len(list_filter(edges[2:-2], lambda v: v <= z)) AS code FROM z, ea{b}), da{b} AS (SELECT 'adaptive' AS method, {b} AS n_bins, z, avg(z) OVER (PARTITION BY code) AS v FROM ca{b})"
    for b in GRID_BINS
)


@query("sqnr_grid", ZSQL + ", " + _GRID + f", u AS ({' UNION ALL '.join(f'SELECT * FROM d{m}{b}' for m in 'uma' for b in GRID_BINS)}) SELECT method, n_bins::BIGINT AS n_bins, {r('avg((z - v) * (z - v))', 'mse')}, {r('10 * log10(avg(z * z) / greatest(avg((z - v) * (z - v)), 1e-20::DOUBLE))', 'sqnr_db')}, {r('corr(z, v)', 'pearson')} FROM u GROUP BY method, n_bins")
def _(spark, sf):
    return signals.quality_grid(z_of(spark, sf).select("z"), ("uniform", "mu_law", "adaptive"), GRID_BINS).drop("rmse")


@query("method_compare", ZSQL + f""", p AS (SELECT subject, avg((z - u) * (z - u)) - avg((z - m) * (z - m)) AS d FROM (SELECT subject, z, (-4.0::DOUBLE + (({UNI.format(b=64)}) + 0.5::DOUBLE) * (8.0::DOUBLE / 64)) AS u, {MUVAL.format(b=64)} AS m FROM (SELECT *, {MUCODE.format(b=64)} AS code FROM z)) GROUP BY subject)
SELECT count(*) AS n, {r('avg(d)', 'mean_diff')}, {r('avg(d) / stddev_samp(d)', 'cohens_dz')} FROM p""")
def _(spark, sf):
    z = z_of(spark, sf)
    u = z.withColumn("u", S.uniform_value(S.uniform_code(F.col("z"), 64, -4.0, 4.0), 64, -4.0, 4.0)).withColumn("m", S.mu_value(S.mu_code(F.col("z"), 64), 64))
    d = u.groupBy("subject").agg((F.avg(F.pow(F.col("z") - F.col("u"), 2)) - F.avg(F.pow(F.col("z") - F.col("m"), 2))).alias("d"))
    return d.agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), (F.avg("d") / F.stddev_samp("d")).alias("cohens_dz"))


@query("norm_strategies", ZSQL + f""", q AS (SELECT subject, channel, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM s GROUP BY subject, channel),
a AS (SELECT 'per_row' AS strategy, z FROM z UNION ALL SELECT 'none', round(x, 9) FROM s UNION ALL SELECT 'robust', round((x - m) / greatest(iqr, 1e-8::DOUBLE), 9) FROM s JOIN q USING (subject, channel) UNION ALL SELECT 'per_trial', round((x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1e-8::DOUBLE), 9) FROM s WINDOW w AS (PARTITION BY subject))
SELECT strategy, count(*) AS n, {r('avg(z)', 'mean')}, {r('stddev_pop(z)', 'std')}, {r('max(z)', 'top')} FROM a GROUP BY strategy""")
def _(spark, sf):
    s = T.events_signal(spark, sf)
    parts = [signals.NORMALISERS[k](s).select(F.lit(k).alias("strategy"), "z") for k in ("per_row", "none", "robust", "per_trial")]
    return T.union_results(*parts).groupBy("strategy").agg(F.count("*").alias("n"), F.avg("z").alias("mean"), F.stddev_pop("z").alias("std"), F.max("z").alias("top"))


# --- shaping --------------------------------------------------------------
@query("delta_signal", SIGNAL + f" SELECT subject, channel, t, {r('coalesce(x - lag(x) OVER (PARTITION BY subject, channel ORDER BY t), 0)', 'dx')} FROM s")
def _(spark, sf):
    return signals.delta(T.events_signal(spark, sf)).select("subject", "channel", "t", "dx")


@query("balance_classes", """t AS (SELECT DISTINCT vec_id % 10 AS subject, vec_id AS trial, label FROM embeddings),
q AS (SELECT subject, min(n) AS quota FROM (SELECT subject, label, count(*) AS n FROM t GROUP BY subject, label) GROUP BY subject)
SELECT subject, trial, label::BIGINT AS label FROM (SELECT *, row_number() OVER (PARTITION BY subject, label ORDER BY md5('42:' || trial), trial) AS n FROM t) JOIN q USING (subject) WHERE n <= quota""")
def _(spark, sf):
    e = T.table(spark, sf, "embeddings")
    return signals.balanced(e.select((F.col("vec_id") % 10).alias("subject"), F.col("vec_id").alias("trial"), "label"))


@query("segment_fixed", SIGNAL + f", g AS (SELECT subject, channel, t // 4 AS segment, count(*) AS n, avg(x) AS m FROM s GROUP BY ALL) SELECT subject, channel, segment AS t, {r('m', 'x')} FROM g WHERE n = 4")
def _(spark, sf):
    return signals.block_mean(T.events_signal(spark, sf), 4).select("subject", "channel", "t", "x")


@query("decimate", SIGNAL + f" SELECT subject, channel, t // 2 AS t, {r('x', 'x')} FROM s WHERE t % 2 = 0")
def _(spark, sf):
    return signals.decimate(T.events_signal(spark, sf), 2).select("subject", "channel", "t", "x")


@query("interval_epochs", "m AS (SELECT user_id, event_id AS mark, ts AS at FROM events WHERE event_type = 'purchase') SELECT m.user_id AS subject, mark, count(*) AS n, " + r("sum(value)", "total") + " FROM m JOIN events e ON e.user_id = m.user_id AND e.ts BETWEEN m.at - INTERVAL 6 HOUR AND m.at + INTERVAL 12 HOUR GROUP BY ALL")
def _(spark, sf):
    e = T.table(spark, sf, "events")
    marks = e.where("event_type = 'purchase'").select(F.col("user_id").alias("subject"), F.col("event_id").alias("mark"), F.col("ts").alias("at"))
    return signals.interval_epochs(e.select(F.col("user_id").alias("subject"), "ts", "value"), marks, "interval 6 hours", "interval 12 hours").groupBy("subject", "mark").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("fragment_first_n", SIGNAL + f" SELECT subject, channel, t AS pos, {r('x', 'x')} FROM s WHERE t < 5")
def _(spark, sf):
    return signals.fragment(T.events_signal(spark, sf), 5).select("subject", "channel", "pos", "x")


@query("patch_stats", SIGNAL + f", g AS (SELECT subject, channel, t // 5 AS segment, count(*) AS n, avg(x) AS m, stddev_pop(x) AS sd FROM s GROUP BY ALL) SELECT subject, channel, segment, {r('m', 'mean')}, {r('sd', 'std')} FROM g WHERE n = 5")
def _(spark, sf):
    return signals.patches(T.events_signal(spark, sf), 5).select("subject", "channel", "segment", "mean", "std")


@query("hjorth", EMB + f""", a AS (SELECT *, x - lag(x) OVER (PARTITION BY trial ORDER BY t) AS d1 FROM e), b AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY trial ORDER BY t) AS d2 FROM a),
v AS (SELECT trial, var_pop(x) AS v0, var_pop(d1) AS v1, var_pop(d2) AS v2 FROM b GROUP BY trial) SELECT trial, {r('v0', 'activity')}, {r('sqrt(v1 / v0)', 'mobility')}, {r('sqrt(v2 / v1) / sqrt(v1 / v0)', 'complexity')} FROM v""")
def _(spark, sf):
    return signals.hjorth(T.embed_trials(spark, sf)).select("trial", "activity", "mobility", "complexity")


_FRAMES = EMB + """, f AS (SELECT trial, t - fr * 8 AS k, fr AS frame, x FROM (SELECT *, unnest(range(greatest(ceil((t - 15) / 8.0), 0)::BIGINT, least(t // 8, 6) + 1)) AS fr FROM e)),
y AS (SELECT trial, frame, k, (x{detrend}) * (0.5 - 0.5 * cos(2 * pi() * k / 16)) AS y FROM f),
p AS (SELECT trial, frame, bin, (pow(sum(y * cos(2 * pi() / 16 * ((k * bin) % 16))), 2) + pow(sum(y * sin(2 * pi() / 16 * ((k * bin) % 16))), 2)) / 16 AS power FROM y, (SELECT unnest(range(9)) AS bin) GROUP BY trial, frame, bin)"""


@query("stft_frames", _FRAMES.format(detrend="") + f" SELECT trial, frame, bin, {r('ln(1 + power)', 'log_power')} FROM p")
def _(spark, sf):
    return spectra.binned(T.embed_trials(spark, sf), 16, 8, finish=np.log1p).select("trial", "frame", "bin", F.col("power").alias("log_power"))


@query("welch_bands", _FRAMES.format(detrend=" - avg(x) OVER (PARTITION BY trial, frame)") + ", q AS (SELECT trial, bin * 4.0 AS hz, avg(power) AS power FROM p GROUP BY trial, bin) SELECT trial, " + ", ".join(r(f"coalesce(avg(ln(1 + power)) FILTER (hz >= {a} AND hz < {b}), 0)", n) for n, (a, b) in BANDS.items()) + " FROM q GROUP BY trial")
def _(spark, sf):
    return signals.welch_bands(T.embed_trials(spark, sf), 16, 64.0, BANDS).select("trial", *BANDS)


@query("class_covariance", LI + f""", u AS (UNPIVOT li ON quantity, extendedprice, discount, tax INTO NAME channel VALUE x)
SELECT a.trial AS label, a.channel AS c1, b.channel AS c2, round(covar_pop(a.x, b.x), 2) AS cov, count(*) AS n FROM u a JOIN u b ON a.subject = b.subject AND a.trial = b.trial AND a.t = b.t AND a.channel <= b.channel GROUP BY ALL""")
def _(spark, sf):
    return signals.class_covariance(T.lineitem_multi(spark, sf)).withColumn("cov", F.round("cov", 2))


# --- tokens ---------------------------------------------------------------
@query("pair_counts", CODES + " SELECT l, r, count(*) AS n FROM (SELECT tok AS l, lead(tok) OVER (PARTITION BY subject, channel ORDER BY pos) AS r FROM c) WHERE r IS NOT NULL GROUP BY l, r")
def _(spark, sf):
    return bpe.pair_counts(codes(spark, sf), KEY)


@query("apply_merge", CODES + ", " + merge_sql("c", 0, "7", "8", BINS) + " SELECT * FROM q0")
def _(spark, sf):
    return bpe.apply_merge(codes(spark, sf), KEY, 7, 8, BINS)


@query("apply_merge_self", CODES + ", " + merge_sql("c", 0, "7", "7", BINS) + " SELECT * FROM q0")
def _(spark, sf):
    return bpe.apply_merge(codes(spark, sf), KEY, 7, 7, BINS)


@query("bpe_train_small", train_sql(MERGES) + " " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS rank, l, r, {BINS + k}::BIGINT AS new_id FROM p{k}" for k in range(MERGES)))
def _(spark, sf):
    return bpe.merge_table(spark, merges(spark, sf), BINS)


@query("bpe_apply_small", train_sql(MERGES) + f" SELECT * FROM q{MERGES - 1}")
def _(spark, sf):
    seqs = bpe.sequences(codes(spark, sf), KEY)
    return bpe.exploded(bpe.tokenise(seqs, merges(spark, sf), BINS), KEY)


@query("bpe_train_by_key", CODES + " SELECT channel, l, r, n FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY n DESC, l, r) AS k FROM (SELECT channel, l, r, count(*) AS n FROM (SELECT channel, tok AS l, lead(tok) OVER (PARTITION BY subject, channel ORDER BY pos) AS r FROM c) WHERE r IS NOT NULL GROUP BY ALL)) WHERE k = 1")
def _(spark, sf):
    return bpe.best_pairs(bpe.pair_counts(codes(spark, sf), KEY, ["channel"]).select("channel", "l", "r", "n"), ["channel"])


@query("bpe_discriminative_small", CODES + f""", p AS (SELECT channel AS label, l, r, count(*) AS n FROM (SELECT channel, tok AS l, lead(tok) OVER (PARTITION BY subject, channel ORDER BY pos) AS r FROM c) WHERE r IS NOT NULL GROUP BY ALL),
tot AS (SELECT label, sum(n) AS total FROM p GROUP BY label), hd AS (SELECT l, r, sum(n)::BIGINT AS a FROM p GROUP BY l, r ORDER BY a DESC, l, r LIMIT 20),
g AS (SELECT hd.l, hd.r, a, coalesce(n, 0) / total AS rate FROM hd CROSS JOIN tot LEFT JOIN p ON p.l = hd.l AND p.r = hd.r AND p.label = tot.label)
SELECT l, r, max(a) AS n, {r('stddev_pop(rate)', 'spread')}, {r('sqrt(max(a)::DOUBLE) * sqrt(stddev_pop(rate))', 'score')} FROM g GROUP BY l, r""")
def _(spark, sf):
    return bpe.discriminative_pairs(codes(spark, sf), KEY, "channel", 0.5, 20).select("l", "r", "n", "spread", "score")


@query("token_stats", train_sql(MERGES) + vocabulary_sql(MERGES) + f" SELECT count(*) AS total_tokens, count(DISTINCT tok) AS unique_tokens, (SELECT count(*) FROM c) AS base_tokens, {r('(SELECT count(*) FROM c) / count(*)', 'compression')}, {r(f'count(DISTINCT tok) / {BINS + MERGES}', 'utilisation')}, (SELECT max(len(seq)) FROM voc JOIN q{MERGES - 1} ON id = tok) AS max_len FROM q{MERGES - 1}")
def _(spark, sf):
    learnt = merges(spark, sf)
    tokens = bpe.exploded(bpe.tokenise(bpe.sequences(codes(spark, sf), KEY), learnt, BINS), KEY)
    return stats.token_stats(tokens, bpe.vocabulary_table(spark, learnt, BINS))


@query("token_freq_topk", CH + " SELECT tok AS token, count(*) AS n FROM d GROUP BY tok ORDER BY n DESC, tok LIMIT 20")
def _(spark, sf):
    return T.char_counts(spark, sf, []).select(F.col("tok").alias("token"), "n").orderBy(F.desc("n"), "token").limit(20)


@query("zipf_fit", CH + f", f AS (SELECT log10(count(*)) AS y, log10(row_number() OVER (ORDER BY count(*) DESC, tok)) AS x FROM d GROUP BY tok) SELECT {r('regr_slope(y, x)', 'slope')}, {r('regr_intercept(y, x)', 'intercept')}, {r('regr_r2(y, x)', 'r2')} FROM f")
def _(spark, sf):
    return stats.zipf(T.char_counts(spark, sf, []).withColumnRenamed("tok", "token"))


@query("heaps_curve", CH + ", n AS (SELECT trial, count(*) AS n FROM d GROUP BY trial), f AS (SELECT trial, count(*) AS fresh FROM (SELECT min(trial) AS trial FROM d GROUP BY tok) GROUP BY trial) SELECT trial, (sum(n) OVER (ORDER BY trial))::BIGINT AS n_tokens, (sum(coalesce(fresh, 0)) OVER (ORDER BY trial))::BIGINT AS n_unique FROM n LEFT JOIN f USING (trial)")
def _(spark, sf):
    return stats.heaps(T.doc_tokens(spark, sf), "trial")


@query("jaccard_sources", CH + f""", o AS (SELECT DISTINCT dataset AS s, tok FROM d), z AS (SELECT s, count(*) AS n FROM o GROUP BY s), own AS (SELECT tok FROM o GROUP BY tok HAVING count(*) = 1),
u AS (SELECT x.s AS a, y.s AS b, x.n AS na, y.n AS nb FROM z x JOIN z y ON x.s < y.s), b AS (SELECT u.*, (SELECT count(*) FROM (SELECT tok FROM o WHERE s = u.a INTERSECT SELECT tok FROM o WHERE s = u.b)) AS shared FROM u)
SELECT b.a, b.b, shared, {r('shared / (na + nb - shared)', 'jaccard')}, (SELECT count(*) FROM o SEMI JOIN own USING (tok) WHERE s = b.a) AS specific_a, (SELECT count(*) FROM o SEMI JOIN own USING (tok) WHERE s = b.b) AS specific_b FROM b""")
def _(spark, sf):
    return stats.jaccard(T.char_counts(spark, sf, ["dataset"]), "dataset")


# --- features -------------------------------------------------------------
@query("hist_l1", CODES + f" SELECT subject, channel, tok AS token, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY subject, channel)', 'share')} FROM c GROUP BY subject, channel, tok")
def _(spark, sf):
    return stats.histogram(codes(spark, sf), KEY)


@query("hist_windowed", CODES + f", w AS (SELECT *, least(pos // greatest((max(pos) OVER (PARTITION BY subject, channel) + 1) // 4, 1), 3) AS win FROM c) SELECT subject, channel, win AS \"window\", tok AS token, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY subject, channel, win)', 'share')} FROM w GROUP BY subject, channel, win, tok")
def _(spark, sf):
    return stats.histogram(stats.windowed(codes(spark, sf), KEY, 4), [*KEY, "window"])


@query("hist_transforms", CODES + f""", h AS (SELECT subject, channel, tok AS token, count(*) / sum(count(*)) OVER (PARTITION BY subject, channel) AS share FROM c GROUP BY subject, channel, tok),
df AS (SELECT token, count(*) AS df FROM h GROUP BY token), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT subject, channel FROM h))
SELECT subject, channel, token, {r('share', 'raw')}, {r('ln(1 + 1000 * share)', 'log')}, 1.0::DOUBLE AS "binary", {r('share * ln(n / (1 + df))', 'tfidf')} FROM h JOIN df USING (token), n""")
def _(spark, sf):
    return stats.transforms(stats.histogram(codes(spark, sf), KEY), KEY)


@query("bigram_capped", CODES + f", p AS (SELECT subject, channel, tok AS l, lead(tok) OVER (PARTITION BY subject, channel ORDER BY pos) AS r FROM c WHERE tok < 9) SELECT subject, channel, l, r, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY subject, channel)', 'share')} FROM p WHERE r IS NOT NULL GROUP BY subject, channel, l, r")
def _(spark, sf):
    return stats.capped_bigrams(codes(spark, sf), KEY, 9)


@query("bigram_topk", CODES + f", p AS (SELECT subject, channel, tok AS l, lead(tok) OVER (PARTITION BY subject, channel ORDER BY pos) AS r FROM c), k AS (SELECT l, r FROM p WHERE r IS NOT NULL GROUP BY l, r ORDER BY count(*) DESC, l, r LIMIT 10) SELECT subject, channel, l, r, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY subject, channel)', 'share')} FROM p SEMI JOIN k USING (l, r) GROUP BY subject, channel, l, r")
def _(spark, sf):
    return stats.top_bigrams(codes(spark, sf), KEY, 10).select("subject", "channel", "l", "r", "n", "share")


@query("flat_sequences", CODES + """, q AS (SELECT subject, channel, list(tok ORDER BY pos)[1:8] AS toks FROM c GROUP BY subject, channel),
j AS (SELECT subject, flatten(list(CASE WHEN k = 1 THEN toks ELSE list_prepend(16, toks) END ORDER BY channel)) AS f FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY channel) AS k FROM q) GROUP BY subject)
SELECT subject, list_aggregate(list_concat(f, [17 FOR x IN range(48)])[1:48], 'string_agg', ',') AS flat FROM j""")
def _(spark, sf):
    seqs = bpe.sequences(codes(spark, sf), KEY)
    return bpe.flat_view(seqs, ["subject"], "channel", 8, 16, 17, 48).select("subject", F.array_join(F.transform("flat", lambda x: x.cast("string")), ",").alias("flat"))


# --- statistics, validation, reports --------------------------------------
@query("spearman_merge_level", "SELECT o_orderpriority, " + r("corr(a, b)", "rho") + ", count(*) AS n FROM (SELECT o_orderpriority, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2 AS a, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2 AS b FROM orders) GROUP BY o_orderpriority")
def _(spark, sf):
    return stats.spearman(T.table(spark, sf, "orders"), "o_totalprice", "o_custkey", ["o_orderpriority"])


_WIL = "d AS (SELECT l_returnflag, l_suppkey, round(avg(l_discount) - avg(l_tax), 9) AS d FROM lineitem GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY abs(d)) + (count(*) OVER (PARTITION BY l_returnflag, abs(d)) - 1) / 2 AS rk FROM d WHERE d <> 0)"


@query("wilcoxon_pairs", _WIL + f", g AS (SELECT l_returnflag, coalesce(sum(rk) FILTER (d > 0), 0) AS wp, coalesce(sum(rk) FILTER (d < 0), 0) AS wm, count(*) AS n FROM r GROUP BY l_returnflag) SELECT l_returnflag, {r('wp', 'w_plus')}, {r('wm', 'w_minus')}, n, {r('(least(wp, wm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24)', 'z')} FROM g")
def _(spark, sf):
    d = T.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.round(F.avg("l_discount") - F.avg("l_tax"), 9).alias("d"))
    return stats.wilcoxon(d, ["l_returnflag"])


@query("loso_splits", "u AS (SELECT source AS subject, count(*) AS n FROM documents GROUP BY source) SELECT row_number() OVER (ORDER BY subject) - 1 AS fold, subject, n AS n_test, (sum(n) OVER () - n)::BIGINT AS n_train FROM u")
def _(spark, sf):
    docs = T.table(spark, sf, "documents").select(F.col("source").alias("subject"), "doc_id")
    return stats.split_sizes(docs, stats.leave_one_out(docs))


@query("kfold_splits", "u AS (SELECT DISTINCT user_id AS subject FROM events) SELECT subject, least((row_number() OVER (ORDER BY md5('42:' || subject), subject) - 1) // greatest(count(*) OVER () // 5, 1), 4) AS fold FROM u")
def _(spark, sf):
    return stats.group_folds(T.table(spark, sf, "events").select(F.col("user_id").alias("subject")), 5, 42)


@query("stratified_folds", "SELECT trial, label::BIGINT AS label, (row_number() OVER (PARTITION BY label ORDER BY md5(trial::VARCHAR), trial) - 1) % 5 AS fold FROM (SELECT vec_id AS trial, label FROM embeddings)")
def _(spark, sf):
    return stats.stratified_folds(T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("trial"), "label"), 5)


@query("classification_metrics", f"""x AS (SELECT quality AS y, CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS p FROM labels), t AS (SELECT count(*) AS n FROM x),
e AS (SELECT k, (SELECT count(*) FROM x WHERE y = k) AS sup, (SELECT count(*) FROM x WHERE p = k) AS giv, (SELECT count(*) FROM x WHERE y = k AND p = k) AS hit FROM (VALUES (0), (1)) v(k)),
m AS (SELECT sum(hit) / max(n) AS acc, avg(hit / sup) AS bal, avg(2 * hit / (sup + giv)) AS f1, sum(sup * giv) / (max(n) * max(n)) AS pe FROM e, t)
SELECT {r('acc', 'accuracy')}, {r('bal', 'balanced_accuracy')}, {r('f1', 'macro_f1')}, {r('(acc - pe) / (1 - pe)', 'kappa')} FROM m""")
def _(spark, sf):
    labels = T.table(spark, sf, "labels").select(F.col("quality").alias("y"), F.when(F.col("toxic") == 1, 0).otherwise(1).alias("p"))
    return stats.classification(labels, [])


@query("fold_summary", f"""w AS (SELECT l_returnflag AS config, l_suppkey % 5 AS fold, (l_tax >= 0.04)::INT AS y, (l_discount >= 0.05)::INT AS p FROM lineitem),
a AS (SELECT config, fold, avg((y = p)::INT) AS accuracy, avg(y) * avg(p) + (1 - avg(y)) * (1 - avg(p)) AS chance FROM w GROUP BY ALL), k AS (SELECT *, CASE WHEN chance < 1 THEN (accuracy - chance) / (1 - chance) ELSE 0 END AS kappa FROM a)
SELECT config, {r('avg(accuracy)', 'accuracy_mean')}, {r('stddev_pop(accuracy)', 'accuracy_std')}, {r('avg(kappa)', 'kappa_mean')}, {r('stddev_pop(kappa)', 'kappa_std')}, count(*) AS n_folds FROM k GROUP BY config""")
def _(spark, sf):
    high = lambda c, v: (F.col(c) >= v).cast("int")
    w = T.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("config"), (F.col("l_suppkey") % 5).alias("fold"), high("l_tax", 0.04).alias("y"), high("l_discount", 0.05).alias("p"))
    return stats.fold_summary(stats.classification(w, ["config", "fold"]), ["config"])


@query("elbow", "c AS (SELECT event_type AS g, floor(value / 20)::BIGINT AS x, count(*) AS n FROM events GROUP BY ALL), y AS (SELECT g, x, sum(n) OVER (PARTITION BY g ORDER BY x) AS y FROM c), b AS (SELECT *, (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) AS sx, (y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) AS sy FROM y WINDOW w AS (PARTITION BY g)) SELECT g, arg_max(x, (round(abs(sx - sy), 9), -x)) AS elbow FROM b GROUP BY g")
def _(spark, sf):
    c = T.table(spark, sf, "events").groupBy(F.col("event_type").alias("g"), F.floor(F.col("value") / 20).alias("x")).agg(F.count("*").alias("n"))
    return stats.elbow(c.withColumn("y", F.sum("n").over(Window.partitionBy("g").orderBy("x"))), ["g"], "x", "y")


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_RES = "res AS (SELECT c_mktsegment AS dataset, o_orderpriority AS model, avg(o_totalprice) / 997 AS acc FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def _results(spark: SparkSession, sf: str) -> DataFrame:
    o = T.table(spark, sf, "orders").join(T.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("dataset"), F.col("o_orderpriority").alias("model")).agg((F.avg("o_totalprice") / 997).alias("acc"))


@query("best_per_dataset", _RES + f" SELECT dataset, model, {r('acc', 'acc')} FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY acc DESC, model) AS n FROM res) WHERE n = 1")
def _(spark, sf):
    return stats.best_of(_results(spark, sf), ["dataset"], "acc")


@query("top3_models", _RES + f" SELECT dataset, model, {r('acc', 'acc')}, n FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY acc DESC, model) AS n FROM res) WHERE n <= 3")
def _(spark, sf):
    return _results(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("acc"), "model"))).where("n <= 3")


@query("pivot_results", _RES + " SELECT dataset, " + ", ".join(r(f"max(acc) FILTER (model = '{m}')", f'"{m}"') for m in PRIORITIES) + " FROM res GROUP BY dataset")
def _(spark, sf):
    return _results(spark, sf).groupBy("dataset").pivot("model", list(PRIORITIES)).agg(F.max("acc"))


from siglex.plans import measures, pipelines, reports, shape, tokens  # noqa: E402, F401  (they register their queries)

# --- models, checked by properties ----------------------------------------
for _name, _f in models.QUERIES.items():
    query(_name)(_f)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
