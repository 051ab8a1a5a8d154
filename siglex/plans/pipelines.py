"""Registered studies: one query for each composite pipeline, over whole tables."""

from __future__ import annotations

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siglex.operators import bpe, folds, models, signals, stats, studies
from siglex.operators import pipelines as P
from siglex.plans.common import BINS, KEY, MERGES, codes, merges, query, r, train_sql, vocabulary_sql
from siglex.plans.shape import BANDS
from siglex.sources import shared
from siglex.sources import tables as T

B, V = 16, 22


def _embed(spark, sf) -> DataFrame:
    return T.embed_trials(spark, sf)


def _tokens(spark, sf, bins: int = B, size: int = V, method: str = "uniform", norm: str = "per_row") -> DataFrame:
    return P.tokenised(P.coded(_embed(spark, sf), method, bins, norm), bins, size)


def _hist(spark, sf, transform: str = "raw", **kw) -> DataFrame:
    return P.histogram_rows(_tokens(spark, sf, **kw), kw.get("size", V), transform)


# --- with SQL twins ---
@query("vocabulary_analysis", train_sql(MERGES) + vocabulary_sql(MERGES) + " " + " UNION ALL ".join(f"SELECT {BINS + k}::BIGINT AS vocab, count(*) AS total_tokens, sum(len(seq))::BIGINT AS base_tokens, {r('sum(len(seq)) / count(*)', 'compression')}, count(DISTINCT tok) AS unique_tokens, {r(f'count(DISTINCT tok) / {BINS + k}', 'utilisation')}, max(len(seq)) AS max_len FROM {'c' if not k else f'q{k - 1}'} JOIN voc ON id = tok" for k in (0, 2, 4)))
def _(spark, sf):
    seqs, learnt = bpe.sequences(codes(spark, sf), KEY), merges(spark, sf)
    parts = []
    for size in (BINS, BINS + 2, BINS + 4):
        own = bpe.prefix(learnt, BINS, size)
        tokens = bpe.exploded(bpe.tokenise(seqs, own, BINS), KEY)
        parts.append(stats.token_stats(tokens, bpe.vocabulary_table(spark, own, BINS)).select(F.lit(size).alias("vocab"), "*"))
    return T.union_results(*parts)


@query("scaling_law", train_sql(MERGES) + ", sl AS (" + " UNION ALL ".join(f"SELECT channel, {BINS + k}::BIGINT AS vocab, (SELECT count(*) FROM c WHERE c.channel = x.channel) / count(*) AS compression FROM {'c' if not k else f'q{k - 1}'} x GROUP BY channel" for k in range(MERGES + 1)) + f"), bl AS (SELECT *, (vocab - min(vocab) OVER w) / (max(vocab) OVER w - min(vocab) OVER w) AS sx, (compression - min(compression) OVER w) / (max(compression) OVER w - min(compression) OVER w) AS sy FROM sl WINDOW w AS (PARTITION BY channel)) SELECT channel, arg_max(vocab, (round(abs(sx - sy), 9), -vocab)) AS elbow, {r('max(compression)', 'best')} FROM bl GROUP BY channel")
def _(spark, sf):
    seqs, learnt = bpe.sequences(codes(spark, sf), KEY), merges(spark, sf)
    base = seqs.groupBy("channel").agg(F.sum(F.size("toks")).alias("base"))
    parts = []
    for k in range(MERGES + 1):
        n = bpe.tokenise(seqs, learnt[:k], BINS).groupBy("channel").agg(F.sum(F.size("toks")).alias("n"))
        parts.append(n.join(base, "channel").select("channel", F.lit(BINS + k).cast("long").alias("vocab"), (F.col("base") / F.col("n")).alias("compression")))
    points = shared.written(T.union_results(*parts), "scaling")
    return stats.elbow(points, ["channel"], "vocab", "compression").join(points.groupBy("channel").agg(F.max("compression").alias("best")), "channel")


_BASE = (("patch", "any", 1), ("binning", "any", 1), ("psd", "any", 1), ("fft", "motor", 0), ("vq", "any", 1), ("csp_lda", "motor", 0))


@query("baseline_registry", "reg AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{p}')" for n, _, _, p, _ in T.REGISTRY) + ") v(dataset, paradigm)), b AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p, _ in _BASE) + ") v(baseline, gate)), n AS (SELECT 'events_signal' AS dataset, count(*) AS n FROM events UNION ALL SELECT 'embed_trials', count(*) FROM embeddings UNION ALL SELECT 'lineitem_multi', count(*) FROM lineitem) SELECT dataset, baseline, n FROM n JOIN reg USING (dataset) JOIN b ON gate IN ('any', paradigm)")
def _(spark, sf):
    sizes = T.union_results(*(T.table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(d).alias("dataset"), "n") for d, t in (("events_signal", "events"), ("embed_trials", "embeddings"), ("lineitem_multi", "lineitem"))))
    gates = spark.createDataFrame([(n, p) for n, p, _ in _BASE], "baseline string, gate string")
    return sizes.join(F.broadcast(T.registry(spark)), "dataset").join(F.broadcast(gates), F.col("gate").isin("any") | (F.col("gate") == F.col("paradigm"))).select("dataset", "baseline", "n")  # fixed tables


# --- checked by properties ---
def study(name: str):
    return query(name)


@study("downstream_tokens")
def _(spark, sf):
    """Token histograms by subject folds, two models, every measure."""
    rows = shared.written(_hist(spark, sf), "shares")
    return T.union_results(*(P.validated(rows, m, 3, by=["fold"]).select(F.lit(m).alias("model"), "*") for m in ("logreg", "forest")))


@study("downstream_summary")
def _(spark, sf):
    folds = P.validated(_hist(spark, sf), "logreg", 3, by=["fold"])
    return stats.seed_summary(folds, [], ["accuracy", "balanced_accuracy", "macro_f1", "kappa"])


@study("vocabulary_sweep")
def _(spark, sf):
    seqs = P.coded(_embed(spark, sf))
    learnt = bpe.train(seqs, B, B + 8)
    return P.study({f"V{s}": P.histogram_rows(bpe.tokenise(seqs, bpe.prefix(learnt, B, s), B), s) for s in (B, B + 4, B + 8)})


@study("mlp_tokens")
def _(spark, sf):
    return P.validated(_hist(spark, sf), "mlp")


@study("csp_lda")
def _(spark, sf):
    """Spatial filters and discriminant, both fitted on the training subjects only."""
    s = T.lineitem_multi(spark, sf)
    named = s.withColumn("label", F.ascii("label"))
    folds = shared.written(stats.group_folds(named.select("subject"), 2, 42), "folds")
    out = None
    for fold in range(2):
        train = named.join(F.broadcast(folds.where(F.col("fold") != fold)), "subject", "left_semi")
        test = named.join(F.broadcast(folds.where(F.col("fold") == fold)), "subject", "left_semi")  # one row a subject
        filters = P.spatial_filters(train, 2)
        model = P.discriminant(shared.written(P.log_variance_rows(train, filters), "csp"))
        p = model.transform(P.log_variance_rows(test, filters)).select(F.lit(fold).alias("fold"), F.col("label").alias("y"), F.col("prediction").cast("int").alias("p"))
        out = p if out is None else out.unionByName(p)
    return stats.classification(out, ["fold"])


@study("pca_reduction")
def _(spark, sf):
    """Eight components of the trials' samples by the random range finder, with their variances."""
    found, variance = folds.wide_components(shared.written(P.array_rows(_embed(spark, sf), ["t"], "x", _embed(spark, sf)), "trials"), 8)
    return spark.createDataFrame([(k + 1, float(v), [float(w) for w in c]) for k, (v, c) in enumerate(zip(variance, found, strict=True))], "component int, variance double, weights array<double>")


@study("baseline_models")
def _(spark, sf):
    s = _embed(spark, sf)
    patches = signals.patches(s, 8).withColumn("v", F.array("mean", "std"))
    power = signals.fft_log_power(s, 64, 64.0, 1.0, 32.0)
    return P.study({
        "patch": P.array_rows(patches.select("subject", "trial", "segment", F.posexplode("v").alias("k", "v")), ["segment", "k"], "v", s),
        "binning": P.histogram_rows(P.coded(s), B), "psd": P.psd_rows(s, 64.0, BANDS), "fft": P.array_rows(power, ["bin"], "log_power", s),
        "vq": P.histogram_rows(P.vq_tokens(models.dense(signals.segments(s, 8).withColumn("t", F.col("t_in")), [*P.TRIAL, "segment"], 8), "segment", 16), 16),
    })


@study("grouped_folds")
def _(spark, sf):
    return stats.grouped_folds(_embed(spark, sf).select("subject", "trial", "label").distinct(), 3)


@study("codebook_saved")
def _(spark, sf):
    p = models.dense(signals.segments(_embed(spark, sf), 8).withColumn("t", F.col("t_in")), ["trial", "segment", "label"], 8)
    _, model = models.codes(p, 16)
    place = shared.path(spark, "codebook")
    model.write().save(place)
    return KMeansModel.load(place).transform(p).groupBy("code").agg(F.count("*").alias("n"))


@study("token_hierarchy")
def _(spark, sf):
    v = bpe.vocabulary_table(spark, bpe.train(P.coded(_embed(spark, sf)), B, B + 64), B)
    both = stats.token_shapes(v).join(stats.token_spectra(v, B, 64.0, -4.0, 4.0, BANDS), "token")
    long = both.select("token", F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in ("length", "activity", "mobility", "dominant_hz", "entropy")))))
    return studies.hierarchy(long, "token", "v", "feature", 1000)


@study("signal_views")
def _(spark, sf):
    s, out = _embed(spark, sf), {}
    for a in signals.APPROACHES:
        view = signals.preprocessed(s, a, "motor", 128.0, 64)
        view = view if "label" in view.columns else view.join(s.select(*P.TRIAL).distinct(), ["subject", "trial"])
        out[a] = P.histogram_rows(P.tokenised(P.coded(view), B, V), V)
    return P.study(out)


@study("spectral_states")
def _(spark, sf):
    s = _embed(spark, sf)
    z = signals.spectral_vectors(s, 16, 8).join(s.select(*P.TRIAL).distinct(), ["subject", "trial"])
    seqs = shared.written(P.vq_tokens(models.dense(z.select(*P.TRIAL, "frame", F.col("bin").alias("t"), F.col("z").alias("x")), [*P.TRIAL, "frame"], 9), "frame", 16), "states")
    tokens = P.tokenised(seqs, 16, 20)
    return P.study({"states": P.histogram_rows(tokens, 20)}).join(F.broadcast(stats.mean_compression(seqs, tokens)))  # one row


def _multi(spark, sf) -> DataFrame:
    return T.lineitem_multi(spark, sf).withColumn("label", F.ascii("label"))


@study("spatial_filter_tokens")
def _(spark, sf):
    """Filters and merges of each fold's training subjects, for one and two components a class."""
    steps = T.lineitem_wide(spark, sf).withColumn("label", F.ascii("label"))
    return studies.spatial_filter_tokens(steps, (1, 2), 2, B, V, channels=sorted(T.LINEITEM_CHANNELS), steps=30)


def _states(spark, sf) -> DataFrame:
    s = signals.decimate(signals.zscore(T.lineitem_multi(spark, sf)).withColumn("label", F.ascii("label")), 2)
    wide = s.groupBy(*P.TRIAL, "t").pivot("channel", ["quantity", "extendedprice", "discount", "tax"]).agg(F.first("z"))
    rows = wide.select(*P.TRIAL, "t", P.array_to_vector(F.array("quantity", "extendedprice", "discount", "tax")).alias("features"))
    return shared.written(P.vq_tokens(rows, "t", 16), "states")


@study("spatial_states")
def _(spark, sf):
    """Codebook and merges of each fold's training subjects."""
    return studies.spatial_states(_multi(spark, sf), ["quantity", "extendedprice", "discount", "tax"], 2, 16, 20, factor=2, steps=30)


def _loso(spark, sf) -> tuple[DataFrame, DataFrame]:
    return studies.evaluated({"tokens": _hist(spark, sf), "psd": P.psd_rows(_embed(spark, sf), 64.0, BANDS)}, steps=30)


@study("loso_measures")
def _(spark, sf):
    """Every subject held out once: accuracy, kappa and area under the curve of each, from kept probabilities."""
    return _loso(spark, sf)[0]


@study("loso_confusion")
def _(spark, sf):
    return _loso(spark, sf)[1]


@study("loso_summary")
def _(spark, sf):
    return studies.summary(_loso(spark, sf)[0], ["condition"])


@study("downstream_features")
def _(spark, sf):
    """Token histograms, windows, bigrams and their union beside band powers, every subject held out once; seeds and folds are parameters of the callable."""
    s = _embed(spark, sf)
    return studies.summary(studies.downstream(s, B, V, lambda x: P.psd_rows(x, 64.0, BANDS), steps=12)[0], ["condition"])


@study("transfer_study")
def _(spark, sf):
    """The vocabulary of one half of the subjects on the other half's trials, and its own."""
    seqs = P.coded(_embed(spark, sf))
    one, two = seqs.where("subject % 2 = 0"), seqs.where("subject % 2 = 1")
    return P.study({"native": P.histogram_rows(P.tokenised(two, B, V), V), "transferred": P.histogram_rows(P.tokenised(two, B, V, one), V)})


@study("transfer_matrix")
def _(spark, sf):
    """Merges of each of three data sets on the trials of each."""
    sets = {"embed_trials": _embed(spark, sf), "lineitem_multi": _multi(spark, sf), "events_trials": T.events_trials(spark, sf)}
    return studies.summary(studies.transfer(sets, B, V, 2, steps=8), ["source", "target"])


@study("feature_improvements")
def _(spark, sf):
    """Six changes to the token features; the universal vocabulary has a query of its own, over more data sets."""
    sets = {"embed_trials": _embed(spark, sf)}
    return studies.summary(studies.improvements(sets, "adaptive", B, V, V + 6, pairs=40, k=2, parts=("S1", "S2", "S3", "S5", "S6"), steps=8), ["part", "dataset", "condition", "model"])


@study("universal_vocabulary")
def _(spark, sf):
    """Each data set's own merges beside those of all data sets together."""
    sets = {"embed_trials": _embed(spark, sf), "lineitem_multi": _multi(spark, sf), "events_trials": T.events_trials(spark, sf)}
    return studies.summary(studies.improvements(sets, "uniform", B, V, V, k=2, parts=("S4",), steps=8), ["dataset", "condition"])


@study("ablation_quantiser")
def _(spark, sf):
    return P.study({m: _hist(spark, sf, method=m) for m in ("uniform", "mu_law", "adaptive")})


@study("ablation_bins")
def _(spark, sf):
    return P.study({f"B{b}_V{v}": _hist(spark, sf, bins=b, size=v) for b, v in ((8, 14), (16, 22), (32, 38), (8, 38))})


@study("ablation_resampling")
def _(spark, sf):
    s = _embed(spark, sf)
    fft = signals.resampled(signals.arrays(s, [*P.TRIAL, "channel"]), 64, 32).select(*P.TRIAL, "channel", F.posexplode("x").alias("t", "x"))
    mean = signals.block_mean(s, 2).join(s.select(*P.TRIAL).distinct(), ["subject", "trial"])
    return P.study({n: P.histogram_rows(P.tokenised(P.coded(v), B, V), V) for n, v in (("original", s), ("resampled", fft), ("block_mean", mean))})


@study("ablation_spatial")
def _(spark, sf):
    s = T.lineitem_multi(spark, sf).withColumn("label", F.ascii("label"))
    return P.study({"independent": P.histogram_rows(P.tokenised(P.coded(s), B, V), V), "spatial": P.histogram_rows(P.tokenised(_states(spark, sf), 16, V), V)})


@study("ablation_artifacts")
def _(spark, sf):
    seqs = P.coded(_embed(spark, sf))
    learnt = bpe.train(seqs, B, V)
    bad = stats.artifact_tokens(bpe.vocabulary_table(spark, learnt, B), B)
    hist = stats.histogram(bpe.exploded(bpe.tokenise(seqs, learnt, B), P.TRIAL), P.TRIAL)
    return P.study({"with": P.vectors(hist, P.TRIAL, V), "without": P.vectors(stats.masked(hist, P.TRIAL, bad), P.TRIAL, V)})


@study("ablation_merges")
def _(spark, sf):
    seqs = P.coded(_embed(spark, sf))
    return P.study({"trained": P.histogram_rows(P.tokenised(seqs, B, V), V), "random": P.histogram_rows(bpe.tokenise(seqs, bpe.random_merges(B, V - B), B), V), "raw_bins": P.histogram_rows(seqs, B)})


@study("ablation_discriminative")
def _(spark, sf):
    seqs = P.coded(_embed(spark, sf))
    long, out = bpe.exploded(seqs, P.TRIAL), {}
    for alpha in (0.0, 0.5, 1.0):
        found = bpe.train_discriminative(long, P.TRIAL, "label", B, 3, alpha, 20).orderBy("rank").collect()  # three merges
        out[f"alpha{alpha}"] = P.histogram_rows(bpe.tokenise(seqs, [(x.l, x.r) for x in found], B), B + 3)
    return P.study(out)


@study("ablation_grid")
def _(spark, sf):
    rows = {}
    for b in (8, 16):
        seqs = P.coded(_embed(spark, sf), bins=b)
        learnt = bpe.train(seqs, b, 28)
        for v in (20, 28):
            rows[f"B{b}_V{v}"] = shared.written(P.histogram_rows(bpe.tokenise(seqs, bpe.prefix(learnt, b, v), b), v), "shares")
    return T.union_results(*(P.study(rows, m).withColumn("model", F.lit(m)) for m in ("logreg", "forest")))


@study("ablation_subjects")
def _(spark, sf):
    return P.study({f"subjects{n}": P.histogram_rows(P.tokenised(P.coded(T.load_dataset(spark, sf, "embed_trials", max_subjects=n)), B, V), V) for n in (4, 10)})


@study("ablation_transforms")
def _(spark, sf):
    t = shared.written(_tokens(spark, sf), "tokens")
    return P.study({f: P.histogram_rows(t, V, f) for f in ("raw", "tfidf", "log", "binary")})


@study("ablation_corpus")
def _(spark, sf):
    seqs = P.coded(_embed(spark, sf))
    return P.study({f"corpus{n or '_all'}": P.histogram_rows(P.tokenised(seqs, B, V, seqs.orderBy("trial").limit(n) if n else seqs), V) for n in (25, 50, 100, 200, None)})


@study("ablation_windows")
def _(spark, sf):
    t, out = bpe.exploded(shared.written(_tokens(spark, sf), "tokens"), P.TRIAL), {}
    for w in (1, 2, 4, 8):
        own = stats.windowed(t, P.TRIAL, w).withColumn("tok", F.col("window") * V + F.col("tok"))
        out[f"windows{w}"] = P.vectors(stats.histogram(own, P.TRIAL), P.TRIAL, w * V)
    return P.study(out)


@study("ablation_normalisation")
def _(spark, sf):
    return P.study({n: _hist(spark, sf, norm=n) for n in ("per_row", "per_channel", "per_trial", "robust", "none")})


@study("ablation_segments")
def _(spark, sf):
    s, out = _embed(spark, sf), {}
    for n in (16, 32, 64):  # the last is a whole trial
        cut = signals.segments(s, n).withColumn("trial", F.col("trial") * 1000 + F.col("segment")).withColumn("t", F.col("t_in"))
        out[f"samples{n}"] = P.histogram_rows(P.tokenised(P.coded(cut), B, V), V)
    return P.study(out)


@study("ensemble_tokens_psd")
def _(spark, sf):
    tokens, power = _hist(spark, sf), P.psd_rows(_embed(spark, sf), 64.0, BANDS)
    return P.study({"tokens": tokens, "psd": power, "both": P.joined(tokens, power)})
