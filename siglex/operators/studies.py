"""Studies as callables: every fit inside its fold, probabilities kept, all points of a grid a parameter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siglex.operators import bpe, folds, permutations, signals, stats
from siglex.operators import pipelines as P
from siglex.sources.shared import written
from siglex.sources.tables import union_results

MEASURES = ["accuracy", "balanced_accuracy", "macro_f1", "kappa", "auc"]


def subject_folds(rows: DataFrame, k: int | None, seed: int = 42) -> tuple[DataFrame, int]:
    """((subject, fold), number of folds): ``k`` shuffled groups of subjects; one subject a fold for None or where there are fewer than 2 k subjects."""
    subjects = written(rows.select("subject").distinct(), "subjects")
    n = subjects.count()
    if k is None or n < 2 * k:
        return written(stats.leave_one_out(subjects), "folds"), n
    return written(stats.group_folds(subjects, k, seed), "folds"), k


def predicted(rows: DataFrame, of: DataFrame, k: int, **fit) -> DataFrame:
    """(subject, trial, fold, y, p, probability) of every row by the model that never saw it: one logistic model a fold, all fitted together."""
    held = written(folds.plain(rows), "features") if "fold" in rows.columns else folds.placed(rows, of)
    return written(folds.held_out(held, folds.logistic(held, k, **fit), k), "predictions")


def evaluated(conditions: dict[str, DataFrame], k: int | None = None, seeds: tuple[int, ...] = (42,), **fit) -> tuple[DataFrame, DataFrame]:
    """(rows (condition, seed, fold, measures), rows (condition, y, p, n)): out-of-fold measures, and confusion summed over folds and seeds."""
    rows, tables = [], []
    for name, features in conditions.items():
        for seed in seeds if k is not None else seeds[:1]:  # leaving out one subject has no seed
            of, n = subject_folds(features, k, seed)
            p = predicted(features, of, n, **fit)
            labels = sorted(r.y for r in p.select("y").distinct().collect())
            mark = [F.lit(name).alias("condition"), F.lit(seed).alias("seed")]
            rows.append(folds.measures(p, labels).select(*mark, "fold", *MEASURES))
            tables.append(p.select(*mark, "y", "p"))
    return union_results(*rows), stats.confusion(union_results(*tables), ["condition"])


def token_rows(seqs: DataFrame, of: DataFrame, k: int, bins: int, vocabulary: int) -> DataFrame:
    """(subject, trial, label, fold, model, features): histograms under merges of each fold's training subjects only."""
    parts = []
    for f in range(k):
        own = seqs.where(F.col("model") == f).drop("model") if "model" in seqs.columns else seqs
        train = own.join(of.where(F.col("fold") != f), "subject", "left_semi")
        tokens = bpe.tokenise(own, bpe.train(train, bins, vocabulary), bins)
        parts.append(folds.plain(P.histogram_rows(tokens, vocabulary)).withColumn("model", F.lit(f)))
    return written(union_results(*parts).join(of, "subject"), "fold-tokens")


def in_folds(make: Callable[[DataFrame, int], DataFrame], samples: DataFrame, k: int, seed: int = 42, **fit) -> DataFrame:
    """Out-of-fold measures of features (subject, trial, label, fold, model, features) that ``make(folds, number)`` fits inside each fold."""
    of, n = subject_folds(samples, k, seed)
    p = predicted(make(of, n), of, n, **fit)
    return folds.measures(p, sorted(r.y for r in p.select("y").distinct().collect()))


def spatial_filter_tokens(samples: DataFrame, components: tuple[int, ...], k: int, bins: int = 16, vocabulary: int = 22, envelope: Callable[[DataFrame], DataFrame] | None = None, seed: int = 42, channels: list[str] | None = None, **fit) -> DataFrame:
    """(condition, fold, measures): tokens of spatially filtered signals for each number of components, beside log variances.

    Filters and merges are those of the fold's training subjects. ``envelope`` may turn
    the components (as channels) into their envelopes before they are quantised. ``samples`` are long, or time
    steps with a column for each of ``channels``. A trial is gathered once; filters, components and codes are made in its row.
    """
    z = folds.zscored(samples) if channels is None else signals.zscore_columns(samples, channels, ["subject", "trial"])
    names = channels or sorted(r.channel for r in samples.select("channel").distinct().collect())
    c = len(names)
    held = written(folds.series(z, names), "series")
    trials = written(folds.moments(held, c), "moments")

    def placed(of: DataFrame) -> DataFrame:
        return trials.join(of.select("subject", F.col("fold").cast("int").alias("fold")), "subject")

    def coded(filters: dict, k: int) -> DataFrame:
        if envelope is None:
            return folds.component_values(held, filters, c, "toks", "int", lambda y, first, size: folds.uniform_codes(y, first, size, bins)).drop("t")
        views = folds.component_values(held, filters, c, "x", "double", lambda y, *_: y)
        long = views.select("model", *P.KEY, F.inline(F.arrays_zip("t", "x")))
        return union_results(*(P.coded(envelope(long.where(F.col("model") == f).drop("model")), "uniform", bins).withColumn("model", F.lit(f)) for f in range(k)))

    def tokens(n: int) -> Callable[[DataFrame, int], DataFrame]:
        return lambda of, k: token_rows(written(coded(folds.patterns(placed(of), c, k, n), k), "codes"), of, k, bins, vocabulary)

    def variances(of: DataFrame, k: int) -> DataFrame:
        return folds.log_variances(placed(of), folds.patterns(placed(of), c, k, max(components)), c, k)

    out = [in_folds(tokens(n), held, k, seed, **fit).select(F.lit(f"tokens{n}").alias("condition"), "*") for n in components]
    out.append(in_folds(variances, held, k, seed, **fit).select(F.lit("log_variance").alias("condition"), "*"))
    return union_results(*out)


def spatial_states(samples: DataFrame, channels: list[str], k: int, codes: int = 16, vocabulary: int = 20, factor: int = 1, seed: int = 42, **fit) -> DataFrame:
    """(condition, fold, measures): codes of the aligned channels of each time step, alone and merged; codebook and merges of the training subjects."""
    s = signals.decimate(folds.zscored(samples), factor)
    wide = s.groupBy(*P.TRIAL, "t").pivot("channel", channels).agg(F.first("x"))
    steps = wide.select(*P.TRIAL, "t", F.array(*(F.coalesce(F.col(c), F.lit(0.0)) for c in channels)).alias("features"))

    def make(size: int) -> Callable[[DataFrame, int], DataFrame]:
        def rows(of: DataFrame, k: int) -> DataFrame:
            held = folds.placed(steps, of)
            book, seqs = folds.codebooks(held, k, codes), []
            for f in range(k):
                coded = folds.codes_of(held, book, f)
                seqs.append(bpe.sequences(coded.select(*P.TRIAL, F.col("t").alias("pos"), F.col("code").alias("tok")), P.TRIAL).withColumn("model", F.lit(f)))
            return token_rows(written(union_results(*seqs), "states"), of, k, codes, size)

        return rows

    return union_results(*(in_folds(make(size), s, k, seed, **fit).select(F.lit(name).alias("condition"), "*") for name, size in (("states", codes), ("states_merged", vocabulary))))


def downstream(samples: DataFrame, bins: int, vocabulary: int, baseline: Callable[[DataFrame], DataFrame], windows: int = 4, bigrams: int = 40, k: int | None = None, seeds: tuple[int, ...] = (42,), **fit) -> tuple[DataFrame, DataFrame]:
    """``evaluated`` on shares of tokens, of tokens by window, of the most frequent bigrams, on all three side by side and on a baseline's features."""
    tokens = written(P.tokenised(P.coded(samples, "uniform", bins), bins, vocabulary), "tokens")
    long = bpe.exploded(tokens, P.TRIAL)
    cut = stats.windowed(long, P.TRIAL, windows).withColumn("tok", F.col("window") * vocabulary + F.col("tok"))
    grams = stats.top_bigrams(long, P.TRIAL, bigrams).withColumn("token", F.dense_rank().over(Window.orderBy("l", "r")) - 1)  # so many pairs
    sets = {"tokens": P.histogram_rows(tokens, vocabulary), "windows": P.vectors(stats.histogram(cut, P.TRIAL), P.TRIAL, windows * vocabulary), "bigrams": P.vectors(grams, P.TRIAL, bigrams)}
    sets["together"] = P.joined(P.joined(sets["tokens"], sets["windows"]), sets["bigrams"])
    return evaluated(sets | {"baseline": baseline(samples)}, k, seeds, **fit)


def transfer(datasets: dict[str, DataFrame], bins: int, vocabulary: int, k: int, seed: int = 42, **fit) -> DataFrame:
    """(source, target, fold, measures): every data set's trials as histograms of tokens under every data set's merges, the native ones where both agree.

    Codes mean the same in all sets, as all are normalised by row and quantised alike; classifiers are fitted and held out within the target.
    """
    seqs = {name: P.coded(s, "uniform", bins) for name, s in datasets.items()}
    learnt = {name: bpe.train(s, bins, vocabulary) for name, s in seqs.items()}
    rows = []
    for target, s in seqs.items():
        of, n = subject_folds(s, k, seed)
        for source, merges in learnt.items():
            p = predicted(P.histogram_rows(bpe.tokenise(s, merges, bins), vocabulary), of, n, **fit)
            labels = sorted(r.y for r in p.select("y").distinct().collect())
            rows.append(folds.measures(p, labels).select(F.lit(source).alias("source"), F.lit(target).alias("target"), "fold", *MEASURES))
    return union_results(*rows)


def hierarchy(values: DataFrame, level: str, value: str, feature: str, shuffles: int, seed: int = 42) -> DataFrame:
    """(feature, rho, n, t, p, p_bonferroni, p_shuffled): rank correlation of each feature with the level, its p by the normal law, corrected, and by keyed shuffles of the ranks."""
    rows = written(values.select(feature, level, value), "levels")
    tests = written(stats.bonferroni(stats.spearman(rows, level, value, [feature]).where("rho is not null"), "rho", "n"), "tests")
    names = sorted(x[0] for x in tests.select(feature).collect())  # names of features
    if not names:
        return tests.withColumn("p_shuffled", F.lit(None).cast("double"))
    shuffled = (permutations.rank_permutation_test(rows.where(F.col(feature) == f), level, value, level, shuffles, seed).select(F.lit(f).alias(feature), F.col("p").alias("p_shuffled")) for f in names)
    return tests.join(union_results(*shuffled), feature)


def fitted(rows: DataFrame, of: DataFrame, k: int, model: str, **fit) -> DataFrame:
    """Out-of-fold measures by one logistic model a fold (``logreg``, keeping probabilities) or by a model of ``pipelines.MODELS``."""
    if model == "logreg":
        p = predicted(rows, of, k, **fit)
        return folds.measures(p, sorted(r.y for r in p.select("y").distinct().collect())).select("fold", *MEASURES)
    p = written(P.predictions(rows, of, model, k), "predictions")
    return stats.classification(p, ["fold"]).select("fold", *MEASURES[:-1]).withColumn("auc", F.lit(None).cast("double"))


def improvements(datasets: dict[str, DataFrame], method: str, bins: int, vocabulary: int, second: int, windows: int = 5, pairs: int = 500, share: int = 2000, transforms: tuple[str, ...] = ("raw", "log", "binary"), classifiers: tuple[str, ...] = ("logreg", "forest"), k: int | None = 5, seeds: tuple[int, ...] = (42,), parts: tuple[str, ...] = ("S1", "S2", "S3", "S4", "S5", "S6"), **fit) -> DataFrame:
    """(part, dataset, condition, model, seed, fold, measures): six changes to the token features of every data set (subject, trial, channel, t, x, label).

    S1: merged tokens and raw codes under each transform. S2: each transform under each
    classifier. S3: histograms by window under each transform. S4: the data set's own merges
    beside those of all data sets, ``share`` sequences of each. S5: the ``pairs`` most frequent
    bigrams, alone and beside the tokens. S6: level one, level two (up to ``second`` ids) and
    both side by side. Merges see no labels; scales and models are fitted inside folds.
    """
    seqs = {name: P.coded(s, method, bins) for name, s in datasets.items()}
    of = {name: {seed: subject_folds(s, k, seed) for seed in (seeds if k is not None else seeds[:1])} for name, s in seqs.items()}
    out: list[DataFrame] = []

    known: dict[tuple, DataFrame] = {}

    def add(part: str, name: str, condition: str, key: str, rows: DataFrame, names: tuple[str, ...] = ("logreg",)) -> None:
        """Conditions of the same features (``key``) are fitted once."""
        features = None
        for model in names:
            for seed, (held, n) in of[name].items():
                at = (name, key, model, seed)
                if at not in known:
                    features = features or written(rows, "features")
                    known[at] = fitted(features, held, n, model, **fit)
                marks = zip(("part", "dataset", "condition", "model"), (part, name, condition, model), strict=True)
                out.append(known[at].select(*(F.lit(v).alias(c) for c, v in marks), F.lit(seed).alias("seed"), "*"))

    universal: bpe.Merges = []
    if "S4" in parts:
        every = union_results(*(s.select(F.lit(n).alias("dataset"), *(F.col(c).cast("string") for c in P.KEY), "toks") for n, s in seqs.items()))
        universal = bpe.train(written(bpe.first_of_each(every, ["dataset"], P.KEY, share), "universal"), bins, vocabulary)
    for name, s in seqs.items():
        one, _, two = bpe.two_level(s, bins, vocabulary, second) if "S6" in parts else (bpe.train(s, bins, vocabulary), None, None)
        tokens = written(bpe.tokenise(s, one, bins), "tokens")
        long = bpe.exploded(tokens, P.TRIAL)
        plain = written(P.histogram_rows(tokens, vocabulary), "shares")
        for t in transforms:
            if "S1" in parts:
                add("S1", name, f"merged_{t}", f"merged_{t}", P.histogram_rows(tokens, vocabulary, t))
                add("S1", name, f"codes_{t}", f"codes_{t}", P.histogram_rows(s, bins, t))
            if "S2" in parts:
                add("S2", name, t, f"merged_{t}", P.histogram_rows(tokens, vocabulary, t), classifiers)
            if "S3" in parts:
                cut = stats.histogram(stats.windowed(long, P.TRIAL, windows).withColumn("tok", F.col("window") * vocabulary + F.col("tok")), P.TRIAL)
                add("S3", name, f"windows_{t}", f"windows_{t}", P.vectors(stats.transforms(cut, P.TRIAL), P.TRIAL, windows * vocabulary, t))
        if "S4" in parts:
            add("S4", name, "own", "merged_raw", plain)
            add("S4", name, "universal", "universal", P.histogram_rows(bpe.tokenise(s, universal, bins), vocabulary))
        if "S5" in parts:
            grams = P.vectors(stats.top_bigrams(long, P.TRIAL, pairs).withColumn("token", F.dense_rank().over(Window.orderBy("l", "r")) - 1), P.TRIAL, pairs)  # so many pairs
            add("S5", name, "bigrams", "bigrams", grams)
            add("S5", name, "tokens_bigrams", "tokens_bigrams", P.joined(plain, grams))
        if "S6" in parts:
            level = written(P.histogram_rows(two, second), "level-two")
            add("S6", name, "level_one", "merged_raw", plain)
            add("S6", name, "level_two", "level_two", level)
            add("S6", name, "both_levels", "both_levels", P.joined(plain, level))
    return union_results(*out)


def summary(measured: DataFrame, key: list[str]) -> DataFrame:
    """Mean, deviation and interval of every measure over folds and seeds."""
    return stats.seed_summary(measured, key, MEASURES)
