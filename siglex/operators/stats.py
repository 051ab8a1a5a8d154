"""Token features, vocabulary laws, statistics, validation and report tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siglex.functions import scalar as S
from siglex.sources.shared import written


def histogram(tokens: DataFrame, key: list[str]) -> DataFrame:
    """(key, token, n, share): counts by key, shares sum to one."""
    counts = tokens.groupBy(*key, F.col("tok").alias("token")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*key)))


def transforms(hist: DataFrame, key: list[str]) -> DataFrame:
    """raw, log, binary and tf-idf forms of a histogram; idf is ln(N / (1 + df))."""
    n = hist.select(*key).distinct().agg(F.count("*").alias("n_keys"))
    df = hist.groupBy("token").agg(F.count_distinct(*key).alias("df"))
    return hist.join(df, "token").join(F.broadcast(n)).select(  # n is one row
        *key, "token", F.col("share").alias("raw"), F.log1p(1000 * F.col("share")).alias("log"), F.lit(1.0).alias("binary"), (F.col("share") * F.log(F.col("n_keys") / (1 + F.col("df")))).alias("tfidf")
    )


def windowed(tokens: DataFrame, key: list[str], windows: int) -> DataFrame:
    """``window`` 0..windows-1 of each position; the last takes the remainder."""
    size = F.max("pos").over(Window.partitionBy(*key)) + 1
    width = F.greatest(F.floor(size / windows), F.lit(1))
    return tokens.withColumn("window", F.least(F.floor(F.col("pos") / width), F.lit(windows - 1)).cast("int"))


def capped_bigrams(tokens: DataFrame, key: list[str], cap: int) -> DataFrame:
    """Ids below ``cap`` are kept first and then paired; shares by key."""
    w = Window.partitionBy(*key).orderBy("pos")
    pairs = tokens.where(F.col("tok") < cap).withColumn("r", F.lead("tok").over(w)).where("r is not null").groupBy(*key, F.col("tok").alias("l"), "r").agg(F.count("*").alias("n"))
    return pairs.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*key)))


def top_bigrams(tokens: DataFrame, key: list[str], k: int) -> DataFrame:
    """Pairs of the ``k`` most frequent ones overall; shares by key."""
    w = Window.partitionBy(*key).orderBy("pos")
    pairs = tokens.withColumn("r", F.lead("tok").over(w)).where("r is not null").withColumnRenamed("tok", "l")
    head = pairs.groupBy("l", "r").count().orderBy(F.desc("count"), "l", "r").limit(k).select("l", "r")
    own = pairs.join(F.broadcast(head), ["l", "r"], "left_semi").groupBy(*key, "l", "r").agg(F.count("*").alias("n"))  # k rows
    return own.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*key)))


def token_stats(tokens: DataFrame, vocabulary: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals, base length, unique ids, use of the vocabulary, mean and greatest length."""
    counts = tokens.groupBy(*(by or []), F.col("tok").alias("token")).agg(F.count("*").alias("n"))
    size = vocabulary.agg(F.count("*").alias("v"))
    rows = counts.join(vocabulary, "token").join(F.broadcast(size))  # one row
    base = F.sum(F.col("n") * F.col("base_len"))
    return rows.groupBy(*(by or [])).agg(
        F.sum("n").alias("total_tokens"), base.alias("base_tokens"), (base / F.sum("n")).alias("compression"), F.count("*").alias("unique_tokens"),
        (F.count("*") / F.first("v")).alias("utilisation"), F.max("base_len").alias("max_len"),
    )


def zipf(counts: DataFrame) -> DataFrame:
    """Slope, intercept and R^2 of log10 n on log10 rank, for counts (token, n): as many rows as ids."""
    ranked = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "token")))
    y, x = F.log10("n"), F.log10("rank")
    return ranked.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def heaps(tokens: DataFrame, unit: str, points: int | None = None) -> DataFrame:
    """(unit, n_tokens, n_unique) seen up to the end of each unit, in order of units; with ``points``, at no more than so many evenly spaced units, the last one among them.

    A unit brings as many new ids as have it as their first; both counts are summed over ranges of units (``running``).
    """
    sizes = tokens.groupBy(unit).agg(F.count("*").alias("n"))
    new = tokens.groupBy("tok").agg(F.min(unit).alias(unit)).groupBy(unit).agg(F.count("*").alias("fresh"))
    units = sizes.join(new, unit, "left").select(unit, "n", F.coalesce("fresh", F.lit(0)).alias("fresh"), F.lit(1).cast("long").alias("one"))
    so_far = running(units, [], [unit], ["n", "fresh", "one"])
    if points is not None:
        so_far = written(so_far, "heaps")
        total = so_far.count()
        so_far = so_far.where(F.floor((F.col("one_before") + 1) * points / F.lit(total)) != F.floor(F.col("one_before") * points / F.lit(total)))
    return so_far.select(unit, (F.col("n_before") + F.col("n")).alias("n_tokens"), (F.col("fresh_before") + F.col("fresh")).alias("n_unique"))


def jaccard(tokens: DataFrame, source: str) -> DataFrame:
    """(a, b, shared, jaccard, specific_a, specific_b) of every two sources, those that share nothing too.

    A token's sources meet in one row, so pairs are formed within it: sources
    are few, tokens many. Specific tokens are of one source only.
    """
    own = tokens.groupBy("tok").agg(F.array_sort(F.collect_set(source)).alias("s"))  # no more than there are sources
    sizes = own.select(F.explode("s").alias("s"), (F.size("s") == 1).alias("only")).groupBy("s").agg(F.count("*").alias("n"), F.count_if("only").alias("specific"))
    pairs = F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    both = own.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("shared"))
    names = sizes.agg(F.array_sort(F.collect_list("s")).alias("s"))  # one row, a name each
    grid = names.select(F.inline(pairs))
    end = lambda side: sizes.select(F.col("s").alias(side), F.col("n").alias(f"n_{side}"), F.col("specific").alias(f"specific_{side}"))
    rows = grid.join(both, ["a", "b"], "left").join(end("a"), "a").join(end("b"), "b").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return rows.select("a", "b", "shared", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("jaccard"), "specific_a", "specific_b")


def average_rank(column: str, by: list[str] | None = None) -> Column:
    """Rank from 1, ties averaged."""
    first = F.rank().over(Window.partitionBy(*(by or [])).orderBy(column))
    same = F.count("*").over(Window.partitionBy(*(by or []), column))
    return first + (same - 1) / 2


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    ranked = df.withColumn("_x", average_rank(x, by)).withColumn("_y", average_rank(y, by))
    return ranked.groupBy(*(by or [])).agg(S.correlation("_x", "_y").alias("rho"), F.count("*").alias("n"))


def wilcoxon(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Signed-rank statistic of ``d`` and its normal deviate; zero differences go."""
    d = pairs.where("d <> 0").withColumn("_a", F.abs("d")).withColumn("rank", average_rank("_a", by))
    rows = d.groupBy(*by).agg(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"), F.count("*").alias("n"))
    n = F.col("n")
    return rows.withColumn("z", (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24))


def holm(tests: DataFrame, p: str, by: list[str] | None = None) -> DataFrame:
    """``p`` times the number of tests of its family not yet passed, at most 1."""
    of = Window.partitionBy(*(by or []))  # a family of tests, never data rows
    first = F.rank().over(of.orderBy(F.round(p, 12)))
    return tests.withColumn("p_holm", F.least(F.lit(1.0), F.col(p) * (F.count("*").over(of) - first + 1)))


def leave_one_out(subjects: DataFrame) -> DataFrame:
    """(fold, subject): every subject is the test part of one fold; all others are its training part (an anti join)."""
    s = subjects.select("subject").distinct()
    return s.withColumn("fold", (F.row_number().over(Window.orderBy("subject")) - 1).cast("int")).select("fold", "subject")  # one row for each subject


def split(rows: DataFrame, folds: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) of one fold: all but the subjects of the fold, and those."""
    held = folds.where(F.col("fold") == fold).select("subject")
    return rows.join(held, "subject", "left_anti"), rows.join(held, "subject", "left_semi")


def split_sizes(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, subject, n_test, n_train) of every subject that is held out."""
    n = rows.groupBy("subject").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return folds.join(n, "subject").join(F.broadcast(total)).select("fold", "subject", F.col("n").alias("n_test"), (F.col("total") - F.col("n")).alias("n_train"))  # one row


def group_folds(subjects: DataFrame, k: int, seed: int) -> DataFrame:
    """(subject, fold): shuffled by md5, equal sizes, the last fold takes the remainder."""
    s = subjects.select("subject").distinct()
    order = Window.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("subject").cast("string")).cast("binary")), "subject")  # one row for each subject
    size = F.greatest(F.floor(F.count("*").over(Window.partitionBy()) / k), F.lit(1))
    return s.select("subject", F.least(F.floor((F.row_number().over(order) - 1) / size), F.lit(k - 1)).cast("int").alias("fold"))


def stratified_folds(trials: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("label").orderBy(F.md5(F.col("trial").cast("string").cast("binary")), "trial")
    return trials.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int"))


def classification(predictions: DataFrame, by: list[str]) -> DataFrame:
    """accuracy, balanced accuracy, macro F1 and kappa from (y, p), all from the confusion table."""
    c = predictions.groupBy(*by, "y", "p").agg(F.count("*").alias("n"))
    rows = c.groupBy(*by, F.col("y").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    cols = c.groupBy(*by, F.col("p").alias("c")).agg(F.sum("n").alias("given"))
    each = rows.join(cols, [*by, "c"], "full").na.fill(0, ["support", "hit", "given"])
    total = F.sum("support")
    seen = F.col("support") > 0
    f1 = F.when(F.col("support") + F.col("given") > 0, 2 * F.col("hit") / (F.col("support") + F.col("given"))).otherwise(0.0)
    out = each.groupBy(*by).agg(
        (F.sum("hit") / total).alias("accuracy"), F.avg(F.when(seen, F.col("hit") / F.col("support"))).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"),
        (F.sum(F.col("support") * F.col("given")) / (total * total)).alias("chance"),
    )
    return out.withColumn("kappa", F.when(F.col("chance") < 1, (F.col("accuracy") - F.col("chance")) / (1 - F.col("chance"))).otherwise(0.0)).drop("chance")


def fold_summary(folds: DataFrame, key: list[str], values: tuple[str, ...] = ("accuracy", "kappa")) -> DataFrame:
    """Mean and deviation of each measure over folds."""
    each = [f(v).alias(f"{v}_{name}") for v in values for name, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return folds.groupBy(*key).agg(*each, F.count("*").alias("n_folds"))


def elbow(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """The ``x`` of greatest distance to the chord, both scaled to 0..1; the first of equals."""
    w = Window.partitionBy(*by)
    scale = lambda c: F.coalesce((F.col(c) - F.min(c).over(w)) / F.nullif(F.max(c).over(w) - F.min(c).over(w), F.lit(0)), F.lit(0.0))
    s = points.withColumn("_x", scale(x)).withColumn("_y", scale(y))
    full = w.orderBy(x).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for name, f in (("0", F.first), ("1", F.last)):
        s = s.withColumn(f"_x{name}", f("_x").over(full)).withColumn(f"_y{name}", f("_y").over(full))
    d = F.abs((F.col("_y1") - F.col("_y0")) * F.col("_x") - (F.col("_x1") - F.col("_x0")) * F.col("_y") + F.col("_x1") * F.col("_y0") - F.col("_y1") * F.col("_x0"))
    return s.groupBy(*by).agg(F.max_by(x, F.struct(F.round(d, 9), -F.col(x))).alias("elbow"))


def best_of(results: DataFrame, by: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(value), *[c for c in results.columns if c not in (*by, value)])
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def artifact_tokens(vocabulary: DataFrame, base: int, share: float = 0.95) -> DataFrame:
    """(token, distance) of ids whose base codes reach further from the centre than the ``share`` percentile of all non-zero distances."""
    centre = F.lit((base - 1) / 2)
    far = vocabulary.select("token", F.array_max(F.transform("base_seq", lambda c: F.abs(c - centre))).alias("distance"))
    cut = far.where("distance > 0").agg(F.percentile("distance", F.lit(share)).alias("cut"))
    return far.join(F.broadcast(cut)).where("distance > cut").select("token", "distance")  # one row


def masked(hist: DataFrame, key: list[str], tokens: DataFrame) -> DataFrame:
    """A histogram without ``tokens``, its shares summing to one again."""
    left = hist.join(F.broadcast(tokens.select("token")), "token", "left_anti")  # ids of one vocabulary
    return left.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*key)))


def power_law_ks(counts: DataFrame) -> DataFrame:
    """Greatest distance between the cumulative shares of counts by rank and those of the fitted power law (ranks of one vocabulary)."""
    fit = zipf(counts)
    ranked = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "token"))).join(F.broadcast(fit))  # one row
    law = ranked.withColumn("p", F.pow("rank", F.col("slope")))
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    return law.select((F.sum("n").over(w) / F.sum("n").over(every)).alias("seen"), (F.sum("p").over(w) / F.sum("p").over(every)).alias("fitted")).agg(F.max(F.abs(F.col("seen") - F.col("fitted"))).alias("ks"), F.count("*").alias("n_ranks"))


def bonferroni(tests: DataFrame, rho: str, n: str, by: list[str] | None = None) -> DataFrame:
    """``t`` of each rank correlation, its two-sided p by the normal law, and p times the number of tests, at most 1."""
    t = F.col(rho) * F.sqrt((F.col(n) - 2) / F.greatest(1 - F.col(rho) * F.col(rho), F.lit(1e-12)))
    p = 2 * normal_tail(F.abs("t"))
    return tests.withColumn("t", t).withColumn("p", p).withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("p") * F.count("*").over(Window.partitionBy(*(by or [])))))


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal law by a rational approximation, right to 1e-7."""
    k = 1 / (1 + 0.2316419 * z)
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    series = sum((c * F.pow(k, F.lit(i + 1)) for i, c in enumerate(b)), F.lit(0.0))
    return F.exp(-z * z / 2) / 2.5066282746310002 * series


def compared_pairs(values: DataFrame, group: list[str], unit: str, method: str, value: str) -> DataFrame:
    """(group, method1, method2, n, diff, cohens_dz, place) of every two methods over the units both have, ranked by effect."""
    rows = values.groupBy(*group, unit).agg(F.array_sort(F.collect_list(F.struct(F.col(method).alias("m"), F.col(value).alias("v")))).alias("a"))  # one entry a method
    pairs = F.flatten(F.transform("a", lambda x: F.transform(F.filter("a", lambda y: y["m"] > x["m"]), lambda y: F.struct(x["m"].alias("method1"), y["m"].alias("method2"), (x["v"] - y["v"]).alias("d")))))
    out = rows.select(*group, F.inline(pairs)).groupBy(*group, "method1", "method2").agg(F.count("*").alias("n"), F.avg("d").alias("diff"), F.coalesce(F.avg("d") / F.nullif(F.stddev_samp("d"), F.lit(0.0)), F.lit(0.0)).alias("cohens_dz"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(F.round(F.abs("cohens_dz"), 9)), "method1", "method2")))


def auc(scores: DataFrame, by: list[str]) -> DataFrame:
    """Area under the curve of rows (by, hit, score), by average ranks; 0.5 without both kinds."""
    ranked = scores.withColumn("_r", average_rank("score", by))
    out = ranked.groupBy(*by).agg(F.sum(F.when(F.col("hit"), F.col("_r")).otherwise(0.0)).alias("r"), F.count_if("hit").alias("p"), F.count("*").alias("n"))
    return out.select(*by, F.coalesce((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0)), F.lit(0.5)).alias("auc"))


def running(rows: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Rows with ``{value}_before``: the sum of a value over the rows of ``by`` that come earlier in ``order``.

    Rows are dealt by ranges of (by, order) and written; each part's totals (one row a part
    and key) are added up, and a part adds its own rows to what stands before it. No part
    holds all rows of a key. Rows of equal order stay in one part, in any order.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_part", *by).agg(*(F.sum(v).alias(f"_{v}") for v in values))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_part", *by, *(F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_{v}") for v in values))
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(carried, ["_part", *by]) if by else dealt.join(carried, "_part")
    return out.withColumns({f"{v}_before": F.col(f"_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).select(*rows.columns, *(f"{v}_before" for v in values))


def ranked(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Rows with their rank from 1 by ``column``, ties averaged: running counts of equal values, met again by value; nulls have none."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    rank = running(counts, [], ["_v"], ["_n"]).select("_v", (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(name))
    return rows.join(rank, F.col(column) == F.col("_v"), "left").drop("_v")


def auc_by_counts(scores: DataFrame, by: list[str]) -> DataFrame:
    """Area under the curve of rows (by, hit, score) from counts of equal scores and running sums; null where one kind is missing."""
    counts = scores.groupBy(*by, "score").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    below = running(counts, by, ["score"], ["misses"])
    won = F.col("hits") * (F.col("misses_before") + F.col("misses") / 2)
    out = below.groupBy(*by).agg(F.sum(won).alias("won"), F.sum("hits").alias("p"), F.sum("misses").alias("n"))
    return out.select(*by, (F.col("won") / F.nullif(F.col("p") * F.col("n"), F.lit(0))).alias("auc"))


def confusion(predictions: DataFrame, by: list[str]) -> DataFrame:
    """(by, y, p, n): how often each class was given for each."""
    return predictions.groupBy(*by, "y", "p").agg(F.count("*").alias("n"))


def seed_summary(folds: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Mean and deviation of each measure over folds, a 95 % interval of its mean by the normal law, and the number of folds."""
    out = []
    for v in values:
        half = 1.96 * F.coalesce(F.stddev_samp(v), F.lit(0.0)) / F.sqrt(F.count(v))
        out += [F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std"), (F.avg(v) - half).alias(f"{v}_ci_low"), (F.avg(v) + half).alias(f"{v}_ci_high")]
    return folds.groupBy(*key).agg(*out, F.count("*").alias("n_folds"))


def compression(sequences: DataFrame, tokens: DataFrame, key: list[str], rate: float) -> DataFrame:
    """Mean codes for each token over rows, and a token's mean length in milliseconds."""
    n = sequences.select(*key, F.size("toks").alias("n_codes")).join(tokens.select(*key, F.size("toks").alias("n_tokens")), key)
    return n.agg(F.avg(F.col("n_codes") / F.col("n_tokens")).alias("ratio"), (F.avg(F.col("n_codes") / F.col("n_tokens")) * (1000 / rate)).alias("token_ms"))


def stratified_subsample(rows: DataFrame, label: str, key: str, cap: int) -> DataFrame:
    """At most about ``cap`` rows with the labels' shares kept, at least one of each, by a hash of the key."""
    w = Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    sizes = rows.groupBy(label).agg(F.count("*").alias("_size"))
    total = sizes.agg(F.sum("_size").alias("_total"))
    quota = sizes.join(F.broadcast(total)).select(label, F.greatest(F.lit(1), F.floor(F.col("_size") * F.lit(cap) / F.col("_total"))).alias("_quota"))  # one row
    return rows.withColumn("_n", F.row_number().over(w)).join(F.broadcast(quota), label).where("_n <= _quota").drop("_n", "_quota")  # one row a label


def go_no_go(results: DataFrame, value: str, threshold: float = 0.70) -> DataFrame:
    """Whether the best result passes."""
    return results.agg(F.max(value).alias("best")).withColumn("decision", F.when(F.col("best") > threshold, "GO").otherwise("NO-GO"))


def quality_gates(quality: DataFrame, bins: int = 256, good: float = 20.0, bad: float = 15.0) -> DataFrame:
    """``gate`` of each method at ``bins``: pass above ``good`` dB, fail below ``bad``."""
    return quality.where(F.col("n_bins") == bins).withColumn("gate", F.when(F.col("sqnr_db") > good, "pass").when(F.col("sqnr_db") < bad, "fail").otherwise("warn"))


def grouped_folds(trials: DataFrame, k: int) -> DataFrame:
    """(subject, fold): subjects largest first, each to the fold whose label counts it evens out most.

    Only the table of subjects and labels reaches the driver, never a trial.
    """
    counts = trials.groupBy("subject", "label").count().collect()
    labels = sorted({c.label for c in counts})
    of: dict[object, list[int]] = {}
    for c in counts:
        of.setdefault(c.subject, [0] * len(labels))[labels.index(c.label)] = c["count"]
    total = [sum(v[i] for v in of.values()) or 1 for i in range(len(labels))]
    folds, place = [[0] * len(labels) for _ in range(k)], []
    for subject, own in sorted(of.items(), key=lambda x: (-sum(x[1]), str(x[0]))):
        def spread(f: int, own: list[int] = own) -> tuple[float, int, int]:
            shares = [[(n + (own[i] if g == f else 0)) / total[i] for i, n in enumerate(fold)] for g, fold in enumerate(folds)]
            mean = [sum(s[i] for s in shares) / k for i in range(len(labels))]
            return sum((s[i] - mean[i]) ** 2 for s in shares for i in range(len(labels))), sum(folds[f]), f

        best = min(range(k), key=spread)
        folds[best] = [a + b for a, b in zip(folds[best], own, strict=True)]
        place.append((subject, best))
    return trials.sparkSession.createDataFrame(place, f"subject {trials.schema['subject'].dataType.simpleString()}, fold int")


def concatenated(hist: DataFrame, bigrams: DataFrame, key: list[str]) -> DataFrame:
    """(key, tokens, bigrams): two feature sets of each row side by side, as sparse lists of (feature, share)."""
    one = hist.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("token", "share"))).alias("tokens"))
    two = bigrams.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("l", "r", "share"))).alias("bigrams"))
    return one.join(two, key, "left").withColumn("bigrams", F.coalesce("bigrams", F.array().cast(two.schema["bigrams"].dataType)))


def mean_compression(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean length of sequences before merging over that after it."""
    n = lambda s: s.agg(F.avg(F.size("toks")).alias("n"))
    return n(before).join(F.broadcast(n(after).withColumnRenamed("n", "m"))).select((F.col("n") / F.col("m")).alias("compression"))  # one row each


def bootstrap_ci(values: DataFrame, by: list[str], column: str, replicates: int, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(by, mean, low, high): draws of n with replacement by a seeded hash, for the results of one configuration (folds by seeds)."""
    sets = values.groupBy(*by).agg(F.array_sort(F.collect_list(column)).alias("a"))
    reps = sets.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    mean = F.aggregate(F.transform(F.sequence(F.lit(1), F.size("a")), lambda i: F.get("a", (drawn(i) % F.size("a")).cast("int"))), F.lit(0.0), lambda s, v: s + v) / F.size("a")
    each = reps.select(*by, "a", mean.alias("m")).groupBy(*by).agg(F.first("a").alias("a"), F.percentile("m", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    return each.select(*by, (F.aggregate("a", F.lit(0.0), lambda s, v: s + v) / F.size("a")).alias("mean"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def paired_tests(results: DataFrame, group: list[str], unit: list[str], method: str, value: str, least: int = 5) -> DataFrame:
    """Signed-rank test of every two methods of a group over common units (``least`` or more), with Holm's p."""
    rows = results.groupBy(*group, *unit).agg(F.array_sort(F.collect_list(F.struct(F.col(method).alias("m"), F.col(value).alias("v")))).alias("a"))  # one entry a method
    pairs = F.flatten(F.transform("a", lambda x: F.transform(F.filter("a", lambda y: y["m"] > x["m"]), lambda y: F.struct(x["m"].alias("method1"), y["m"].alias("method2"), F.round(x["v"] - y["v"], 9).alias("d")))))
    tests = wilcoxon(rows.select(*group, F.inline(pairs)), [*group, "method1", "method2"]).where(F.col("n") >= least)
    return holm(tests.withColumn("p", 2 * normal_tail(F.abs("z"))), "p", group)


def token_spectra(vocabulary: DataFrame, base: int, rate: float, low: float, high: float, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Of every merged token's waveform (bin midpoints on low..high, mean removed): dominant Hz, spectral entropy, share of power in each band."""
    step = (high - low) / base
    x = F.transform("base_seq", lambda c: F.lit(low) + (c + 0.5) * step)
    waves = vocabulary.where("base_len > 1").select("token", F.col("base_len").alias("n"), x.alias("x"))
    waves = waves.withColumn("m", F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.col("n"))
    bins = waves.withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.col("n") / 2)).cast("int"))))
    part = lambda f: F.aggregate(F.zip_with("x", F.sequence(F.lit(0), F.col("n") - 1), lambda v, t: (v - F.col("m")) * f(2 * math.pi * F.col("k") * t / F.col("n"))), F.lit(0.0), lambda s, v: s + v)
    power = bins.select("token", "k", "n", (F.pow(part(F.cos), F.lit(2)) + F.pow(part(F.sin), F.lit(2))).alias("p")).withColumn("hz", F.col("k") * rate / F.col("n"))
    total = F.sum("p").over(Window.partitionBy("token"))
    share = power.withColumn("q", F.coalesce(F.col("p") / F.nullif(total, F.lit(0.0)), F.lit(0.0)))
    entropy = F.sum(F.when(F.col("q") > 0, -F.col("q") * F.log2("q")).otherwise(0.0))
    return share.groupBy("token").agg(
        F.max_by("hz", F.struct(F.round("p", 9), -F.col("k"))).alias("dominant_hz"), entropy.alias("entropy"),
        *(F.sum(F.when((F.col("hz") >= a) & (F.col("hz") <= b), F.col("q")).otherwise(0.0)).alias(name) for name, (a, b) in bands.items()),
    )


def token_shapes(vocabulary: DataFrame) -> DataFrame:
    """(token, length, mean, std, activity, mobility) of every token's base codes."""
    a = F.col("base_seq")
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    variance = lambda x: F.when(F.size(x) > 0, mean(F.transform(x, lambda v: F.pow(v - mean(x), F.lit(2))))).otherwise(0.0)
    steps = F.zip_with(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: (x - y).cast("double"))
    return vocabulary.select("token", F.col("base_len").alias("length"), mean(F.transform(a, lambda v: v.cast("double"))).alias("mean"), variance(F.transform(a, lambda v: v.cast("double"))).alias("activity"), variance(steps).alias("step_variance")).select(
        "token", "length", "mean", F.sqrt("activity").alias("std"), "activity", F.when(F.col("activity") > 0, F.sqrt(F.col("step_variance") / F.col("activity"))).otherwise(0.0).alias("mobility")
    )
