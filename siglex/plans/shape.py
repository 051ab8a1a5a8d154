"""Queries of sources, shaping and signal transforms."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from siglex.operators import models, signals
from siglex.plans.common import CODES, EMB, KEY, LI, SIGNAL, UNI, ZSQL, codes, query, r, z_of
from siglex.sources import shared
from siglex.sources import tables as T

FILTERS = {"c0": {"quantity": 0.5, "extendedprice": -0.25, "discount": 2.0, "tax": 1.0}, "c1": {"quantity": -1.0, "extendedprice": 0.125, "discount": 0.0, "tax": 3.0}}
STAGES = {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "middle", "5-LOW": "low"}
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0)}
LI_LONG = LI + ", u AS (UNPIVOT li ON quantity, extendedprice, discount, tax INTO NAME channel VALUE x)"
TRIAL = SIGNAL.replace("event_type AS channel", "event_type AS trial, event_type AS channel")


@query("load_dataset", SIGNAL + ", " + EMB + ", " + LI_LONG + """, a AS (SELECT 'events_signal' AS dataset, subject, x FROM s UNION ALL SELECT 'embed_trials', subject, x FROM e UNION ALL SELECT 'lineitem_multi', subject, x FROM u)
SELECT dataset, subject, count(*) AS n, """ + r("avg(x)", "mean") + " FROM (SELECT *, dense_rank() OVER (PARTITION BY dataset ORDER BY subject) AS k FROM a) WHERE k <= 7 GROUP BY dataset, subject")
def _(spark, sf):
    parts = [T.load_dataset(spark, sf, n, max_subjects=7).select(F.lit(n).alias("dataset"), F.col("subject").cast("long").alias("subject"), "x") for n in ("events_signal", "embed_trials", "lineitem_multi")]
    return T.union_results(*parts).groupBy("dataset", "subject").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))


_REGISTRY = "reg AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}::DOUBLE, {c}, '{d}', '{e}')" for a, b, c, d, e in T.REGISTRY) + ") v(dataset, rate, n_classes, paradigm, validation))"


@query("dataset_registry", SIGNAL + ", " + EMB + ", " + LI_LONG + ", " + _REGISTRY + f""", a AS (SELECT 'events_signal' AS dataset, count(*) AS n FROM s UNION ALL SELECT 'events_trials', count(*) FROM s UNION ALL SELECT 'embed_trials', count(*) FROM e UNION ALL SELECT 'lineitem_multi', count(*) FROM u)
SELECT dataset, paradigm, validation, n_classes::BIGINT AS n_classes, {r('n / rate', 'seconds')} FROM a JOIN reg USING (dataset)""")
def _(spark, sf):
    sizes = T.union_results(*(T.load_dataset(spark, sf, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("dataset"), "n") for n in T.LOADERS))
    return sizes.join(F.broadcast(T.registry(spark)), "dataset").select("dataset", "paradigm", "validation", "n_classes", (F.col("n") / F.col("rate")).alias("seconds"))


@query("label_map_composite", "m AS (SELECT * FROM (VALUES ('A', 'F', 0), ('N', 'O', 1), ('R', 'F', 2), ('R', 'O', 1)) v(l_returnflag, l_linestatus, label)) SELECT l_suppkey, label::BIGINT AS label, count(*) AS n FROM lineitem JOIN m USING (l_returnflag, l_linestatus) GROUP BY ALL")
def _(spark, sf):
    classes = spark.createDataFrame([("A", "F", 0), ("N", "O", 1), ("R", "F", 2), ("R", "O", 1)], "l_returnflag string, l_linestatus string, label int")
    return T.mapped_labels(T.table(spark, sf, "lineitem"), F.broadcast(classes), ["l_returnflag", "l_linestatus"]).groupBy("l_suppkey", "label").agg(F.count("*").alias("n"))


@query("stage_names", "SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'middle' ELSE 'low' END AS stage, o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY ALL")
def _(spark, sf):
    return T.grouped_names(T.table(spark, sf, "orders"), "o_orderpriority", STAGES).groupBy("stage", "o_orderstatus").agg(F.count("*").alias("n"))


@query("span_chunks", f"""WITH sp AS (SELECT user_id, event_type AS label, min(ts) AS a, max(ts) AS b FROM events GROUP BY ALL), ch AS (SELECT user_id, label, a, unnest(range((epoch_us(b) - epoch_us(a)) // 86400000000)) AS chunk FROM sp)
SELECT user_id, label, chunk, count(*) AS n, {r('sum(value)', 'total')} FROM ch JOIN events e USING (user_id) WHERE epoch_us(e.ts) >= epoch_us(a) + chunk * 86400000000 AND epoch_us(e.ts) < epoch_us(a) + (chunk + 1) * 86400000000 GROUP BY ALL""".replace("WITH ", "", 1))
def _(spark, sf):
    """Spans of each user and event type from its first to its last event, overlapping; whole days of each."""
    e = T.table(spark, sf, "events").withColumnRenamed("user_id", "subject")
    spans = e.groupBy("subject", F.col("event_type").alias("label")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    rows = signals.span_chunks(e.select("subject", "ts", "value"), spans, 86400)
    return rows.groupBy(F.col("subject").alias("user_id"), "label", "chunk").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("fixed_chunks", f"SELECT user_id, epoch_us(ts) // 86400000000 AS chunk, count(*) AS n, {r('sum(value)', 'total')} FROM events GROUP BY ALL")
def _(spark, sf):
    return signals.time_chunks(T.table(spark, sf, "events"), 86400).groupBy("user_id", "chunk").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("relayout_4d", EMB + " SELECT trial, t % 4 AS repetition, t // 16 AS channel, (t // 4) % 4 AS t, " + r("x", "x") + " FROM e WHERE t // 16 < 4")
def _(spark, sf):
    return signals.relayout(T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("trial"), "embedding"), "embedding", (4, 4, 4))


@query("select_channels", LI_LONG + ", k AS (SELECT DISTINCT channel FROM u WHERE NOT starts_with(channel, 'ext') ORDER BY channel LIMIT 2) SELECT subject, channel, count(*) AS n, " + r("sum(x)", "total") + " FROM u SEMI JOIN k USING (channel) GROUP BY subject, channel")
def _(spark, sf):
    return signals.select_channels(T.lineitem_multi(spark, sf), without="ext", first=2).groupBy("subject", "channel").agg(F.count("*").alias("n"), F.sum("x").alias("total"))


@query("common_channels", "a AS (SELECT source AS channel, min(doc_id) AS place FROM documents WHERE lang = 'en' GROUP BY source) SELECT channel, place FROM a SEMI JOIN (SELECT source AS channel FROM documents WHERE lang = 'de') USING (channel)")
def _(spark, sf):
    d = T.table(spark, sf, "documents").withColumnRenamed("source", "channel")
    return signals.common_channels(d.where("lang = 'en'").groupBy("channel").agg(F.min("doc_id").alias("place")), d.where("lang = 'de'"))


@query("rate_check", SIGNAL + " SELECT subject, channel, count(*) AS n, 14::BIGINT AS expected, CASE WHEN abs(count(*) - 14) <= 1 THEN 'ok' ELSE 'rejected' END AS state FROM s GROUP BY subject, channel")
def _(spark, sf):
    checked = signals.rate_check(T.events_signal(spark, sf), 1.0, 13.0)
    return checked.select("subject", "channel", "n", "expected", F.when(F.col("ok"), "ok").otherwise("rejected").alias("state"))


@query("assemble_padded", SIGNAL + ", g AS (SELECT a.subject, b.channel FROM (SELECT DISTINCT subject FROM s) a, (SELECT DISTINCT channel FROM s) b), m AS (SELECT max(t) + 1 AS longest FROM s), p AS (SELECT subject, channel, unnest(range(longest)) AS t FROM g, m) SELECT subject, channel, t, " + r("coalesce(x, 0)", "x") + " FROM p LEFT JOIN s USING (subject, channel, t)")
def _(spark, sf):
    s = T.events_signal(spark, sf)
    names = [x.channel for x in s.select("channel").distinct().orderBy("channel").collect()]  # the channels of one recording
    return signals.assembled(s, names).select("subject", "channel", F.posexplode("x").alias("t", "x"))


@query("assemble_truncated", SIGNAL + f" SELECT subject, channel, t, {r('x', 'x')} FROM s WHERE t < (SELECT min(n) FROM (SELECT count(*) AS n FROM s GROUP BY subject, channel))")
def _(spark, sf):
    return signals.truncated(T.events_signal(spark, sf)).select("subject", "channel", "t", "x")


@query("budgeted_sequences", ZSQL + f""", n AS (SELECT subject, channel, count(*) AS n FROM z GROUP BY ALL), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY subject ORDER BY channel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
k AS (SELECT count(DISTINCT subject) AS k FROM z) SELECT subject, channel, t, {UNI.format(b=64)} AS code FROM z JOIN b USING (subject, channel), k WHERE before + t < 400 // k""")
def _(spark, sf):
    return signals.budgeted(signals.quantise(z_of(spark, sf), "uniform", 64), 400).select("subject", "channel", "t", "code")


_AB = "a AS (SELECT l_returnflag AS dataset, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY ALL), b AS (SELECT o_orderpriority AS dataset, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY ALL)"


def _two_results(spark, sf):
    a = T.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("dataset")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))
    b = T.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("dataset")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    return a, b


@query("results_csv", _AB + f" SELECT dataset, n, {r('total', 'total')}, {r('top', 'top')} FROM (SELECT * FROM a UNION ALL BY NAME SELECT * FROM b)")
def _(spark, sf):
    place = shared.path(spark, "csv")
    T.save_csv(place, *_two_results(spark, sf))
    return T.load_csv(spark, place, "dataset string, n long, total double, top double")


@query("results_json", _AB + f" SELECT dataset, n, {r('total', 'total')}, {r('top', 'top')} FROM (SELECT * FROM a UNION ALL BY NAME SELECT * FROM b)")
def _(spark, sf):
    place = shared.path(spark, "json")
    T.save_json(T.union_results(*_two_results(spark, sf)), place)
    return T.load_json(spark, place, "dataset string, n long, total double, top double")


@query("results_append", _AB + " SELECT dataset, n::VARCHAR AS n, NULL::VARCHAR AS seed FROM (SELECT dataset, n FROM a UNION ALL SELECT dataset, n FROM b)")
def _(spark, sf):
    place = shared.path(spark, "append")
    for part in _two_results(spark, sf):
        T.append_results(part.withColumn("n", F.col("n").cast("string")), place, ["dataset", "n", "seed"])
    return spark.read.schema("dataset string, n string, seed string").parquet(place)


@query("results_logged", "SELECT l_returnflag AS dataset, l_linestatus AS model, count(*) AS n, 'exp1' AS experiment, sha256(l_returnflag || '|' || l_linestatus) AS config FROM lineitem GROUP BY ALL")
def _(spark, sf):
    rows = T.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("model")).agg(F.count("*").alias("n"))
    return T.logged(rows, "exp1", ["dataset", "model"]).where("logged_at is not null").drop("logged_at")


@query("materialised_features", CODES + " SELECT subject, channel, tok AS token, count(*) AS n FROM c GROUP BY ALL")
def _(spark, sf):
    place, params = shared.path(spark, "features"), {"method": "uniform", "bins": 16, "table": sf}
    made = lambda: codes(spark, sf).groupBy(*KEY, F.col("tok").alias("token")).agg(F.count("*").alias("n"))
    inputs = (T.table(spark, sf, "events"),)
    T.materialised(spark, place, params, made, inputs)
    return T.materialised(spark, place, params, made, inputs)  # read, not made again


# --- quantisation, normalisation ---
@query("quantize_data_range", SIGNAL + ", m AS (SELECT min(x) AS lo, max(x) AS hi FROM s) SELECT subject, channel, t, least(greatest(floor((x - lo) / (hi - lo + 1e-10::DOUBLE) * 32), 0), 31)::BIGINT AS code FROM s, m")
def _(spark, sf):
    return signals.quantise_range(T.events_signal(spark, sf), 32).select("subject", "channel", "t", "code")


@query("dequantize_adaptive", ZSQL + ", e AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(z, [k / 16.0 FOR k IN range(17)]), lambda v: round(v, 9)))) AS edges FROM z), c AS (SELECT *, len(list_filter(edges[2:-2], lambda v: v <= z)) AS code FROM z, e), d AS (SELECT *, avg(z) OVER (PARTITION BY code) AS zh FROM c) SELECT subject, channel, t, " + r("zh * greatest(stddev_pop(x) OVER w, 1e-8::DOUBLE) + avg(x) OVER w", "x_hat") + " FROM d WINDOW w AS (PARTITION BY subject, channel)")
def _(spark, sf):
    coded = signals.quantise(z_of(spark, sf), "adaptive", 16)
    return signals.denormalise(signals.dequantise(coded, "adaptive", 16)).select("subject", "channel", "t", "x_hat")


@query("norm_per_channel", LI_LONG + " SELECT channel, count(*) AS n, " + r("max(z)", "top") + ", " + r("min(z)", "bottom") + " FROM (SELECT channel, (x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1e-8::DOUBLE) AS z FROM u WINDOW w AS (PARTITION BY subject, channel)) GROUP BY channel")
def _(spark, sf):
    z = signals.NORMALISERS["per_channel"](T.lineitem_multi(spark, sf))
    return z.groupBy("channel").agg(F.count("*").alias("n"), F.max("z").alias("top"), F.min("z").alias("bottom"))


# --- transforms ---
def _sinc_sql(name: str, cut: float, half: int) -> str:
    """CTE (k, v): a Hamming-windowed sinc low-pass of 2 half + 1 taps, sum one."""
    return f"{name} AS (SELECT k, v / sum(v) OVER () AS v FROM (SELECT k, (CASE WHEN k = 0 THEN 2 * {cut}::DOUBLE ELSE sin(2 * pi() * {cut}::DOUBLE * k) / (pi() * k) END) * (0.54 + 0.46 * cos(pi() * k / {half})) AS v FROM (SELECT unnest(range(-{half}, {half} + 1)) AS k)))"


def _polyphase_sql(name: str, source: str, down: int, by: str = "trial") -> str:
    """CTE (by, t, x): a Kaiser-windowed low-pass (beta 5, ten samples of the slower rate on each side) at every ``down``-th sample."""
    half = 10 * down
    bessel = lambda x: f"list_sum(list_transform(range(30), lambda j: pow(({x}) / 2, 2 * j) / pow(factorial(j::INT)::DOUBLE, 2)))"
    return f"""h{name} AS (SELECT k, v / sum(v) OVER () AS v FROM (SELECT k, (CASE WHEN k = 0 THEN 1.0 / {down} ELSE sin(pi() * k / {down}) / (pi() * k) END) * {bessel(f'5 * sqrt(1 - pow(k / {half}.0, 2))')} AS v FROM (SELECT unnest(range(-{half}, {half} + 1)) AS k))),
{name} AS (SELECT {by}, a.t // {down} AS t, sum(b.x * v) AS x FROM (SELECT {by}, t FROM {source} WHERE t % {down} = 0) a JOIN {source} b USING ({by}) JOIN h{name} ON k = a.t - b.t GROUP BY {by}, a.t)"""


_BAND = [_sinc_sql("l0", 0.5 / 64, 212), _sinc_sql("l1", 24 / 64, 212), _sinc_sql("l2", 15 / 64, 212), _sinc_sql("l3", 17 / 64, 212)]
_CLEAN = ", ".join(_BAND) + """, band AS (SELECT l1.k, l1.v - l0.v AS v FROM l0 JOIN l1 USING (k)), notch AS (SELECT l2.k, (l2.k = 0)::INT - (l3.v - l2.v) AS v FROM l2 JOIN l3 USING (k)),
kernel AS (SELECT a.k + b.k AS k, sum(a.v * b.v) AS v FROM band a, notch b WHERE abs(a.k + b.k) < 64 GROUP BY 1)"""


@query("bandpass_notch", EMB + ", " + _CLEAN + f" SELECT trial, a.t, {r('sum(b.x * v)', 'x')} FROM e a JOIN e b USING (trial) JOIN kernel ON k = a.t - b.t GROUP BY trial, a.t")
def _(spark, sf):
    return signals.cleaned(T.embed_trials(spark, sf), 64.0, 0.5, 24.0, (16.0, 60.0)).select("trial", "t", "x")


@query("downsample_polyphase", EMB + ", " + _polyphase_sql("f0", "e", 2) + f" SELECT trial, t, {r('x', 'x')} FROM f0")
def _(spark, sf):
    return signals.downsample(T.embed_trials(spark, sf), 1, 2).select("trial", "t", "x")


@query("resample_fft", EMB + f""", m AS (SELECT unnest(range(24)) AS m), k AS (SELECT unnest(range(1, 12)) AS k), w AS (SELECT m, t, (1 + 2 * (SELECT sum(cos(2 * pi() * k * (m / 24.0 - t / 64.0))) FROM k) + 2 * cos(pi() * m) * cos(2 * pi() * 12 * t / 64.0)) / 64.0 AS w FROM m, (SELECT unnest(range(64)) AS t))
SELECT trial, m AS t, {r('sum(x * w)', 'x')} FROM e JOIN w USING (t) GROUP BY trial, m""")
def _(spark, sf):
    rows = signals.arrays(T.embed_trials(spark, sf), ["trial"])
    return signals.resampled(rows, 64, 24).select("trial", F.posexplode("x").alias("t", "x"))


_FRAMED = EMB + f""", f AS (SELECT trial, t - fr * 8 AS k, fr AS frame, x FROM (SELECT *, unnest(range(greatest(ceil((t - 15) / 8.0), 0)::BIGINT, least(t // 8, 6) + 1)) AS fr FROM e)),
y AS (SELECT trial, frame, k, (x{{detrend}}) * (0.5 - 0.5 * cos(2 * pi() * k / 16)) AS y FROM f),
p AS (SELECT trial, frame, bin, (pow(sum(y * cos(2 * pi() / 16 * ((k * bin) % 16))), 2) + pow(sum(y * sin(2 * pi() / 16 * ((k * bin) % 16))), 2)) / 16 AS power FROM y, (SELECT unnest(range(9)) AS bin) GROUP BY trial, frame, bin)"""


@query("spectral_flat", _FRAMED.format(detrend="") + f" SELECT trial, row_number() OVER (PARTITION BY trial ORDER BY frame, bin) - 1 AS pos, {r('ln(1 + power)', 'x')} FROM p")
def _(spark, sf):
    return signals.spectral_flat(T.embed_trials(spark, sf), signals.frame_size(64, 256), 8).select("trial", F.posexplode("x").alias("pos", "x"))


@query("spectral_vectors", _FRAMED.format(detrend="") + f" SELECT trial, frame, bin, {r('(v - avg(v) OVER w) / greatest(stddev_pop(v) OVER w, 1e-8::DOUBLE)', 'z')} FROM (SELECT *, ln(1 + power) AS v FROM p) WINDOW w AS (PARTITION BY trial, frame)")
def _(spark, sf):
    return signals.spectral_vectors(T.embed_trials(spark, sf), 16, 8).select("trial", "frame", "bin", "z")


_ENERGY = sum((0.5 - 0.5 * math.cos(2 * math.pi * k / 16)) ** 2 for k in range(16))
_PSD = _FRAMED.format(detrend=" - avg(x) OVER (PARTITION BY trial, frame)") + f", d AS (SELECT trial, bin, bin * 4.0 AS hz, avg(power) * 16 * CASE WHEN bin > 0 AND bin < 8 THEN 2 ELSE 1 END / (64 * {_ENERGY!r}) AS density FROM p GROUP BY trial, bin)"


@query("welch_psd", _PSD + f" SELECT trial, bin, {r('density', 'density')} FROM d")
def _(spark, sf):
    return signals.psd(T.embed_trials(spark, sf), 16, 64.0).select("trial", "bin", "density")


@query("band_power", _PSD + ", b AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, (a, b) in BANDS.items()) + f") v(band, low, high)) SELECT trial, band, {r('coalesce(sum(density) FILTER (hz BETWEEN low AND high), 0) * 4', 'power')} FROM d, b GROUP BY trial, band")
def _(spark, sf):
    return signals.band_power(signals.psd(T.embed_trials(spark, sf), 16, 64.0), ["trial"], BANDS, 4.0)


@query("fft_log_power", EMB + ", y AS (SELECT trial, t, x * (0.5 - 0.5 * cos(2 * pi() * t / 64)) AS y FROM e) SELECT trial, bin, " + r("ln(1 + (pow(sum(y * cos(2 * pi() / 64 * ((t * bin) % 64))), 2) + pow(sum(y * sin(2 * pi() / 64 * ((t * bin) % 64))), 2)) / 64)", "log_power") + " FROM y, (SELECT unnest(range(1, 33)) AS bin) GROUP BY trial, bin")
def _(spark, sf):
    return signals.fft_log_power(T.embed_trials(spark, sf), 64, 64.0, 1.0, 45.0).select("trial", "bin", "log_power")


@query("sub_epochs", EMB + f" SELECT subject, label::BIGINT AS label, trial, t // 24 AS segment, count(*) AS n, {r('avg(x)', 'mean')} FROM e WHERE t < 48 GROUP BY ALL")
def _(spark, sf):
    return signals.segments(T.embed_trials(spark, sf), 24).groupBy("subject", "label", "trial", "segment").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))


@query("describe_preprocessing", EMB + f""", d AS (SELECT trial, t // 2 AS t, x FROM e WHERE t % 2 = 0), a AS (SELECT 'before' AS stage, 64.0 AS rate, trial, count(*) AS n, min(x) AS low, max(x) AS high FROM e GROUP BY trial UNION ALL SELECT 'after', 32.0, trial, count(*), min(x), max(x) FROM d GROUP BY trial)
SELECT stage, count(*) AS n_rows, sum(n)::BIGINT AS n_samples, {r('max(n) / max(rate)', 'seconds')}, {r('min(low)', 'low')}, {r('max(high)', 'high')} FROM a GROUP BY stage""")
def _(spark, sf):
    s = T.embed_trials(spark, sf)
    return signals.described(s, signals.decimate(s, 2), 64.0, 32.0)


@query("spatial_filter", LI_LONG + ", f AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{ch}', {w}::DOUBLE)" for c, ws in FILTERS.items() for ch, w in ws.items()) + f") v(component, channel, w)) SELECT subject, trial, component, t, {r('sum(w * x)', 'x')} FROM u JOIN f USING (channel) GROUP BY subject, trial, component, t")
def _(spark, sf):
    table = spark.createDataFrame([(c, ch, w) for c, ws in FILTERS.items() for ch, w in ws.items()], "component string, channel string, w double")
    return signals.spatial_filter(T.lineitem_multi(spark, sf), table).select("subject", "trial", "component", "t", "x")


def _envelope_sql(low: float, high: float, k: str) -> str:
    """CTE e{k} (trial, t, x): the amplitude of the analytic signal within the band, by sums over its bins."""
    return f"""k{k} AS (SELECT unnest(range(1, 32)) AS k), s{k} AS (SELECT trial, k, sum(x * cos(2 * pi() * k * t / 64)) AS re, -sum(x * sin(2 * pi() * k * t / 64)) AS im FROM e, k{k} WHERE k BETWEEN {low} AND {high} GROUP BY trial, k),
e{k} AS (SELECT trial, m AS t, sqrt(pow(sum(re * cos(2 * pi() * k * m / 64) - im * sin(2 * pi() * k * m / 64)), 2) + pow(sum(re * sin(2 * pi() * k * m / 64) + im * cos(2 * pi() * k * m / 64)), 2)) / 32 AS x FROM s{k}, (SELECT unnest(range(64)) AS m) GROUP BY trial, m)"""


_VIEWS = ", ".join([
    _polyphase_sql("d2", "e", 2), _envelope_sql(4, 15, "v"), _polyphase_sql("n2", "ev", 2), *(f"{_envelope_sql(a, b, n)}, {_polyphase_sql(n + '2', 'e' + n, 2)}" for n, a, b in (("w", 2, 4), ("x", 4, 6), ("y", 7, 15))),
])


@query("preprocess_approaches", _FRAMED.format(detrend="") + ", " + _VIEWS + f""", a AS (SELECT 'raw' AS approach, trial, x FROM e UNION ALL SELECT 'delta', trial, coalesce(x - lag(x) OVER (PARTITION BY trial ORDER BY t), 0) FROM e UNION ALL SELECT 'downsample', trial, x FROM d2
UNION ALL SELECT 'envelope', trial, x FROM n2 UNION ALL SELECT 'spectral', trial, ln(1 + power) FROM p WHERE bin BETWEEN 1 AND 5 UNION ALL SELECT 'multiband', trial, x FROM (SELECT * FROM w2 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM y2)) SELECT approach, trial, count(*) AS n, {r('sum(x * x)', 'energy')} FROM a GROUP BY approach, trial""")
def _(spark, sf):
    s = T.embed_trials(spark, sf)
    parts = [signals.preprocessed(s, a, "motor", 128.0, 64).select(F.lit(a).alias("approach"), "trial", "x") for a in signals.APPROACHES]
    return T.union_results(*parts).groupBy("approach", "trial").agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("energy"))


@query("envelope", EMB + ", " + _envelope_sql(4, 12, "n") + ", " + _polyphase_sql("n4", "en", 4) + f" SELECT trial, t, {r('x', 'x')} FROM n4")
def _(spark, sf):
    return models.envelope(T.embed_trials(spark, sf), 64.0, 4.0, 12.0, 4).select("trial", "t", "x")


@query("envelope_multiband", EMB + ", " + _envelope_sql(4, 8, "a") + ", " + _envelope_sql(8, 13, "b") + f" SELECT trial, channel, t, {r('x', 'x')} FROM (SELECT trial, 'e:theta' AS channel, t, x FROM ea UNION ALL SELECT trial, 'e:alpha', t, x FROM eb)")
def _(spark, sf):
    return models.multiband_envelope(T.embed_trials(spark, sf), 64.0, {"theta": (4.0, 8.0), "alpha": (8.0, 13.0)}).select("trial", "channel", "t", "x")
