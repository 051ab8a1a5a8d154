"""Queries of statistics, tests and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from siglex.operators import bpe, permutations, signals, stats
from siglex.plans.common import BINS, CH, EMB, MERGES, MUCODE, MUVAL, UNI, ZSQL, merges, query, r, train_sql, vocabulary_sql, z_of
from siglex.plans.reports import RUNS, runs
from siglex.plans.shape import BANDS
from siglex.plans.tokens import LAST, _tokens
from siglex.sources import tables as T

_TAIL = "(exp(-({z}) * ({z}) / 2) / 2.5066282746310002 * (" + " + ".join(f"({c})::DOUBLE * pow(1 / (1 + 0.2316419::DOUBLE * ({{z}})), {i + 1})" for i, c in enumerate((0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429))) + "))"


def _tail(z: str) -> str:
    return _TAIL.format(z=z)


@query("power_law_ks", CH + f""", f AS (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, tok) AS k FROM d GROUP BY tok), s AS (SELECT regr_slope(log10(n), log10(k)) AS slope FROM f),
c AS (SELECT sum(n) OVER (ORDER BY k) / sum(n) OVER () AS seen, sum(pow(k::DOUBLE, slope)) OVER (ORDER BY k) / sum(pow(k::DOUBLE, slope)) OVER () AS fitted FROM f, s) SELECT {r('max(abs(seen - fitted))', 'ks')}, count(*) AS n_ranks FROM c""")
def _(spark, sf):
    return stats.power_law_ks(T.char_counts(spark, sf, []).withColumnRenamed("tok", "token"))


_LEVELS = train_sql(MERGES) + vocabulary_sql(MERGES) + f", lv AS (SELECT id AS token, len(seq) AS base_len, count(tok) AS n FROM voc LEFT JOIN {LAST} ON id = tok GROUP BY ALL), m AS (SELECT 'frequency' AS feature, token, n AS v FROM lv UNION ALL SELECT 'length', token, base_len FROM lv)"


def _levels(spark, sf):
    learnt = merges(spark, sf)
    n = _tokens(spark, sf, learnt).groupBy(F.col("tok").alias("token")).agg(F.count("*").alias("n"))
    v = bpe.vocabulary_table(spark, learnt, BINS).join(n, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return v.select("token", F.inline(F.array(F.struct(F.lit("frequency").alias("feature"), F.col("n").alias("v")), F.struct(F.lit("length").alias("feature"), F.col("base_len").cast("long").alias("v")))))


@query("spearman_tokens", _LEVELS + f""", k AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY token) AS a, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2 AS b FROM m), g AS (SELECT feature, corr(a, b) AS rho, count(*) AS n FROM k GROUP BY feature),
t AS (SELECT *, rho * sqrt((n - 2) / greatest(1 - rho * rho, 1e-12::DOUBLE)) AS t FROM g) SELECT feature, {r('rho', 'rho')}, n, {r('t', 't')}, {r('2 * ' + _tail('abs(t)'), 'p')}, {r('least(1.0::DOUBLE, 2 * ' + _tail('abs(t)') + ' * count(*) OVER ())', 'p_bonferroni')} FROM t""")
def _(spark, sf):
    return stats.bonferroni(stats.spearman(_levels(spark, sf), "token", "v", ["feature"]), "rho", "n").select("feature", "rho", "n", "t", "p", "p_bonferroni")


def _shuffles(n: int, columns: str, seed: int = 42) -> str:
    """CTEs over b (id, x, y): o, the correlation, and p, that of each of ``n`` keyed shuffles; a row and round a step."""
    key = f"('0x' || substr(md5('{seed}:' || rep || ':' || (step % 6)), 1, 7))::BIGINT"
    cube = lambda c: f"((({c} + {key}) % 2147483647) * (({c} + {key}) % 2147483647) % 2147483647 * (({c} + {key}) % 2147483647) % 2147483647 % side)"
    return f"""i AS (SELECT {columns}, row_number() OVER (ORDER BY id) - 1 AS i FROM b), d AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS side FROM b),
k AS (SELECT rep, i, 0 AS step, i // side AS l, i % side AS r, n, side FROM i, d, (SELECT unnest(range({n})) AS rep)
UNION ALL SELECT rep, i, step + 1, CASE WHEN step % 2 = 0 THEN (l + {cube("r")}) % side ELSE l END, CASE WHEN step % 2 = 1 THEN (r + {cube("l")}) % side ELSE r END, n, side FROM k WHERE step = 0 OR step % 6 <> 0 OR l * side + r >= n),
p AS (SELECT rep, corr(u.x, v.y) AS rho FROM k JOIN i u USING (i) JOIN i v ON v.i = l * side + r WHERE step > 0 AND step % 6 = 0 AND l * side + r < n GROUP BY rep), o AS (SELECT corr(x, y) AS observed FROM i)
SELECT {r('max(observed)', 'observed')}, {r('(count(*) FILTER (abs(rho) >= abs(observed) - 1e-12::DOUBLE) + 1) / (count(*) + 1)', 'p')} FROM p, o"""


_BY_TRIAL = "RECURSIVE " + EMB + ", b AS (SELECT trial AS id, label::DOUBLE AS x, avg(x) AS y FROM e GROUP BY ALL), "


def _trial_means(spark, sf):
    return T.embed_trials(spark, sf).groupBy(F.col("trial").alias("id"), F.col("label").cast("double").alias("x")).agg(F.avg("x").alias("y"))


@query("permutation_test", _BY_TRIAL + _shuffles(40, "id, x, y"))
def _(spark, sf):
    return permutations.permutation_test(_trial_means(spark, sf), "x", "y", "id", 40)


@query("permutation_test_ranks", _BY_TRIAL + _shuffles(200, "id, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS y", 7))
def _(spark, sf):
    return permutations.rank_permutation_test(_trial_means(spark, sf), "x", "y", "id", 200, 7)


def _psd_sql(source: str, k: str) -> str:
    """CTEs ending in d{k} (trial, bin, hz, density) of the 64-sample trials of ``source``."""
    return f"""f{k} AS (SELECT trial, t - fr * 8 AS k, fr AS frame, x FROM (SELECT *, unnest(range(greatest(ceil((t - 15) / 8.0), 0)::BIGINT, least(t // 8, 6) + 1)) AS fr FROM {source})),
y{k} AS (SELECT trial, frame, k, (x - avg(x) OVER (PARTITION BY trial, frame)) * (0.5 - 0.5 * cos(2 * pi() * k / 16)) AS y FROM f{k}),
p{k} AS (SELECT trial, frame, bin, (pow(sum(y * cos(2 * pi() / 16 * ((k * bin) % 16))), 2) + pow(sum(y * sin(2 * pi() / 16 * ((k * bin) % 16))), 2)) AS power FROM y{k}, (SELECT unnest(range(9)) AS bin) GROUP BY trial, frame, bin),
d{k} AS (SELECT trial, bin, bin * 4.0 AS hz, avg(power) * CASE WHEN bin > 0 AND bin < 8 THEN 2 ELSE 1 END / (64 * 6.0) AS density FROM p{k} GROUP BY trial, bin)"""


_BANDS = "b AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, (a, b) in BANDS.items()) + ") v(band, low, high))"


@query("band_distortion", EMB + ", z AS (SELECT trial, t, round((x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1e-8::DOUBLE), 9) AS z FROM e WINDOW w AS (PARTITION BY trial)), a0 AS (SELECT trial, t, z AS x FROM z), a1 AS (SELECT trial, t, -4.0::DOUBLE + (" + UNI.format(b=16) + " + 0.5::DOUBLE) * 0.5 AS x FROM z), " + _psd_sql("a0", "00") + ", " + _psd_sql("a1", "01") + ", " + _BANDS + f""", w AS (SELECT trial, band, coalesce(sum(x.density) FILTER (x.hz BETWEEN low AND high), 0) AS px, coalesce(sum(y.density) FILTER (x.hz BETWEEN low AND high), 0) AS py FROM d00 x JOIN d01 y USING (trial, bin), b GROUP BY trial, band)
SELECT band, {r('avg(CASE WHEN px > 0 THEN abs(px - py) / px * 100 ELSE 0 END)', 'distortion_pct')} FROM w GROUP BY band""")
def _(spark, sf):
    z = signals.zscore(T.embed_trials(spark, sf))
    back = signals.dequantise(signals.quantise(z, "uniform", 16), "uniform", 16)
    return signals.band_distortion(back, 16, 64.0, BANDS)


_METHODS = ZSQL + ", e AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(z, [k / 16.0 FOR k IN range(17)]), lambda v: round(v, 9)))) AS edges FROM z), ca AS (SELECT *, len(list_filter(edges[2:-2], lambda v: v <= z)) AS code FROM z, e), u AS (SELECT 'uniform' AS method, subject, z, (-4.0::DOUBLE + ((" + UNI.format(b=16) + ") + 0.5::DOUBLE) * 0.5) AS v FROM z UNION ALL SELECT 'mu_law', subject, z, " + MUVAL.format(b=16) + " FROM (SELECT *, " + MUCODE.format(b=16) + " AS code FROM z) UNION ALL SELECT 'adaptive', subject, z, avg(z) OVER (PARTITION BY code) FROM ca), g AS (SELECT method, subject, avg((z - v) * (z - v)) AS mse FROM u GROUP BY ALL)"


def _methods(spark, sf):
    z = z_of(spark, sf).select("subject", "z")
    parts = [signals.dequantise(signals.quantise(z, m, 16), m, 16).select(F.lit(m).alias("method"), "subject", "z", "z_hat") for m in ("uniform", "mu_law", "adaptive")]
    return signals.quality(T.union_results(*parts), ["method", "subject"]).select("method", "subject", "mse")


@query("method_pairs", _METHODS + f""", p AS (SELECT a.method AS method1, b.method AS method2, count(*) AS n, avg(a.mse - b.mse) AS diff, avg(a.mse - b.mse) / stddev_samp(a.mse - b.mse) AS dz FROM g a JOIN g b ON a.subject = b.subject AND a.method < b.method GROUP BY ALL)
SELECT method1, method2, n, {r('diff', 'diff')}, {r('dz', 'cohens_dz')}, row_number() OVER (ORDER BY abs(dz) DESC) AS place FROM p""")
def _(spark, sf):
    return stats.compared_pairs(_methods(spark, sf), [], "subject", "method", "mse")


@query("bootstrap_draws", RUNS + f""", s AS (SELECT dataset, list_sort(list(acc)) AS a FROM runs GROUP BY dataset), p AS (SELECT dataset, a, unnest(range(1, 41)) AS rep FROM s), i AS (SELECT dataset, a, rep, unnest(range(1, len(a) + 1)) AS i FROM p),
m AS (SELECT dataset, rep, avg(a[(('0x' || substr(md5('42:' || rep || ':' || i), 1, 8))::BIGINT % len(a)) + 1]) AS m FROM i GROUP BY dataset, rep), q AS (SELECT dataset, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY dataset)
SELECT dataset, {r('list_avg(a)', 'mean')}, {r('low', 'low')}, {r('high', 'high')} FROM q JOIN s USING (dataset)""")
def _(spark, sf):
    return stats.bootstrap_ci(runs(spark, sf), ["dataset"], "acc", 40)


@query("classifier_pairs", RUNS + f""", d AS (SELECT a.dataset, a.model AS method1, b.model AS method2, round(a.acc - b.acc, 9) AS d FROM runs a JOIN runs b ON a.dataset = b.dataset AND a.vocab = b.vocab AND a.seed = b.seed AND a.model < b.model), k AS (SELECT *, rank() OVER (PARTITION BY dataset, method1, method2 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY dataset, method1, method2, abs(d)) - 1) / 2 AS rk FROM d WHERE d <> 0),
g AS (SELECT dataset, method1, method2, coalesce(sum(rk) FILTER (d > 0), 0) AS wp, coalesce(sum(rk) FILTER (d < 0), 0) AS wm, count(*) AS n FROM k GROUP BY ALL HAVING count(*) >= 5), z AS (SELECT *, (least(wp, wm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24) AS z FROM g), p AS (SELECT *, 2 * {_tail('abs(z)')} AS p FROM z)
SELECT dataset, method1, method2, {r('wp', 'w_plus')}, {r('wm', 'w_minus')}, n, {r('z', 'z')}, {r('p', 'p')}, {r('least(1.0::DOUBLE, p * (count(*) OVER (PARTITION BY dataset) - rank() OVER (PARTITION BY dataset ORDER BY round(p, 12)) + 1))', 'p_holm')} FROM p""")
def _(spark, sf):
    return stats.paired_tests(runs(spark, sf), ["dataset"], ["vocab", "seed"], "model", "acc")


@query("auc_binary", "s AS (SELECT lang, toxic = 1 AS hit, n_chars::DOUBLE AS score FROM labels JOIN documents USING (doc_id)), k AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS rk FROM s) SELECT lang, " + r("coalesce((sum(CASE WHEN hit THEN rk ELSE 0 END) - count(*) FILTER (hit) * (count(*) FILTER (hit) + 1) / 2) / nullif(count(*) FILTER (hit) * count(*) FILTER (NOT hit), 0), 0.5)", "auc") + " FROM k GROUP BY lang")
def _(spark, sf):
    rows = T.table(spark, sf, "labels").join(T.table(spark, sf, "documents"), "doc_id")
    return stats.auc(rows.select("lang", (F.col("toxic") == 1).alias("hit"), F.col("n_chars").cast("double").alias("score")), ["lang"])


@query("auc_one_vs_rest", "c AS (SELECT DISTINCT o_orderpriority AS c FROM orders), s AS (SELECT c, o_orderpriority = c AS hit, ((o_orderkey * (ascii(c) - 40)) % 101)::DOUBLE AS score FROM orders, c), k AS (SELECT *, rank() OVER (PARTITION BY c ORDER BY score) + (count(*) OVER (PARTITION BY c, score) - 1) / 2 AS rk FROM s), a AS (SELECT c, (sum(CASE WHEN hit THEN rk ELSE 0 END) - count(*) FILTER (hit) * (count(*) FILTER (hit) + 1) / 2) / (count(*) FILTER (hit) * count(*) FILTER (NOT hit)) AS auc FROM k GROUP BY c) SELECT " + r("avg(auc)", "macro_auc") + ", count(*) AS n_classes FROM a")
def _(spark, sf):
    o = T.table(spark, sf, "orders")
    classes = [x[0] for x in o.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]  # names of classes
    rows = o.select("o_orderkey", "o_orderpriority", F.explode(F.array(*map(F.lit, classes))).alias("c"))
    scored = rows.select("c", (F.col("o_orderpriority") == F.col("c")).alias("hit"), ((F.col("o_orderkey") * (F.ascii("c") - 40)) % 101).cast("double").alias("score"))
    return stats.auc(scored, ["c"]).agg(F.avg("auc").alias("macro_auc"), F.count("*").alias("n_classes"))


@query("confusion_matrix", "SELECT l_returnflag AS y, l_linestatus AS p, l_linenumber::BIGINT AS fold, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, sf):
    return stats.confusion(T.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("y"), F.col("l_linestatus").alias("p"), F.col("l_linenumber").alias("fold")), ["fold"])


@query("seed_summary", RUNS + f", h AS (SELECT dataset, model, avg(acc) AS m, stddev_pop(acc) AS s, 1.96 * coalesce(stddev_samp(acc), 0) / sqrt(count(acc)) AS half, count(*) AS n FROM runs GROUP BY ALL) SELECT dataset, model, {r('m', 'acc_mean')}, {r('s', 'acc_std')}, {r('m - half', 'acc_ci_low')}, {r('m + half', 'acc_ci_high')}, n AS n_folds FROM h")
def _(spark, sf):
    return stats.seed_summary(runs(spark, sf), ["dataset", "model"], ["acc"])


@query("stratified_subsample", "e AS (SELECT vec_id, label FROM embeddings), q AS (SELECT label, greatest(1, count(*) * 100 // (SELECT count(*) FROM e)) AS quota FROM e GROUP BY label) SELECT vec_id, label::BIGINT AS label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) AS n FROM e) JOIN q USING (label) WHERE n <= quota")
def _(spark, sf):
    return stats.stratified_subsample(T.table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id", 100)


@query("go_no_go", RUNS + f" SELECT {r('max(acc)', 'best')}, CASE WHEN max(acc) > 0.7 THEN 'GO' ELSE 'NO-GO' END AS decision FROM runs")
def _(spark, sf):
    return stats.go_no_go(runs(spark, sf), "acc")


@query("quality_gates", ZSQL + ", u AS (SELECT 'uniform' AS method, z, (-4.0::DOUBLE + ((" + UNI.format(b=256) + ") + 0.5::DOUBLE) * (8.0::DOUBLE / 256)) AS v FROM z UNION ALL SELECT 'mu_law', z, " + MUVAL.format(b=256) + " FROM (SELECT *, " + MUCODE.format(b=256) + " AS code FROM z)), q AS (SELECT method, 10 * log10(avg(z * z) / avg((z - v) * (z - v))) AS db FROM u GROUP BY method) SELECT method, 256::BIGINT AS n_bins, CASE WHEN db > 20 THEN 'pass' WHEN db < 15 THEN 'fail' ELSE 'warn' END AS gate FROM q")
def _(spark, sf):
    return stats.quality_gates(signals.quality_grid(z_of(spark, sf).select("z"), ("uniform", "mu_law"), (16, 256))).select("method", "n_bins", "gate")


_VOC_X = train_sql(MERGES) + vocabulary_sql(MERGES) + ", wv AS (SELECT id AS token, len(seq) AS n, unnest(seq) AS c, generate_subscripts(seq, 1) - 1 AS t FROM voc WHERE len(seq) > 1), xv AS (SELECT token, n, t, -4.0::DOUBLE + (c + 0.5) * 0.5 AS x FROM wv)"


@query("token_spectra", _VOC_X + f""", cv AS (SELECT token, n, t, x - avg(x) OVER (PARTITION BY token) AS x FROM xv), pw AS (SELECT token, k, k * 64.0 / n AS hz, pow(sum(x * cos(2 * pi() * k * t / n)), 2) + pow(sum(x * sin(2 * pi() * k * t / n)), 2) AS p FROM (SELECT *, unnest(range(1, greatest(1, n // 2) + 1)) AS k FROM cv) GROUP BY token, n, k),
sh AS (SELECT *, coalesce(p / nullif(sum(p) OVER (PARTITION BY token), 0), 0) AS q FROM pw) SELECT token, {r('arg_max(hz, (round(p, 9), -k))', 'dominant_hz')}, {r('sum(CASE WHEN q > 0 THEN -q * log2(q) ELSE 0 END)', 'entropy')}, """ + ", ".join(r(f"sum(CASE WHEN hz BETWEEN {a} AND {b} THEN q ELSE 0 END)", n) for n, (a, b) in BANDS.items()) + " FROM sh GROUP BY token")
def _(spark, sf):
    return stats.token_spectra(bpe.vocabulary_table(spark, merges(spark, sf), BINS), BINS, 64.0, -4.0, 4.0, BANDS)


@query("token_shapes", train_sql(MERGES) + vocabulary_sql(MERGES) + f""", wv AS (SELECT id AS token, len(seq) AS n, unnest(seq) AS c, generate_subscripts(seq, 1) AS t FROM voc), sv AS (SELECT *, c - lag(c) OVER (PARTITION BY token ORDER BY t) AS dc FROM wv), gv AS (SELECT token, max(n) AS n, avg(c) AS m, var_pop(c) AS v, coalesce(var_pop(dc), 0) AS dv FROM sv GROUP BY token)
SELECT token, n AS length, {r('m', 'mean')}, {r('sqrt(v)', 'std')}, {r('v', 'activity')}, {r('CASE WHEN v > 0 THEN sqrt(dv / v) ELSE 0 END', 'mobility')} FROM gv""")
def _(spark, sf):
    return stats.token_shapes(bpe.vocabulary_table(spark, merges(spark, sf), BINS))
