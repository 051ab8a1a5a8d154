"""Normalisation, quantisation, shaping and transforms of long signal tables."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siglex.functions import scalar as S
from siglex.operators import filters, ranks, spectra

ROW = ["subject", "trial", "channel"]


def zscore(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``z`` within ``by`` (a row by default): population deviation, floored; rounded to 9 places so that bin edges are stable."""
    w = Window.partitionBy(*(by or ROW))
    z = (F.col("x") - F.avg("x").over(w)) / F.greatest(F.stddev_pop("x").over(w), F.lit(S.EPS))
    return samples.withColumn("z", F.round(z, 9))


def zscore_columns(steps: DataFrame, channels: list[str], by: list[str]) -> DataFrame:
    """Time steps with a column a channel, each as ``zscore`` has it within ``by``: one window for all channels."""
    w = Window.partitionBy(*by)
    return steps.withColumns({c: F.round((F.col(c) - F.avg(c).over(w)) / F.greatest(F.stddev_pop(c).over(w), F.lit(S.EPS)), 9) for c in channels})


def robust_z(samples: DataFrame) -> DataFrame:
    """``z`` by median and interquartile range of the row."""
    q = samples.groupBy(*ROW).agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return samples.join(q, ROW).withColumn("z", F.round((F.col("x") - F.col("q")[1]) / F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(S.EPS)), 9)).drop("q")


NORMALISERS = {
    "per_row": zscore,
    "per_channel": lambda s: zscore(s, ["subject", "channel"]),
    "per_trial": lambda s: zscore(s, ["subject", "trial"]),
    "robust": robust_z,
    "none": lambda s: s.withColumn("z", F.round("x", 9)),
}


def adaptive_edges(normalised: DataFrame, bins: int, method: str = "exact") -> DataFrame:
    """One row: edges at equal shares of ``z``, ties joined.

    ``exact`` selects the ranks by refined histograms (``ranks``), without a task that
    holds all values; ``sketch`` is Spark's approximate percentile with a rank
    error of one in a million.
    """
    shares = [k / bins for k in range(bins + 1)]
    if method == "sketch":
        return normalised.agg(F.percentile_approx("z", F.array(*map(F.lit, shares)), 1_000_000).alias("edges")).select(F.array_distinct("edges").alias("edges"))
    if method != "exact":
        raise ValueError(f"unknown method {method!r}")
    return _edge_row(normalised.sparkSession, _fitted(normalised, [bins])[bins])


def _edge_row(spark: SparkSession, edges: list[float]) -> DataFrame:
    return spark.createDataFrame([(edges,)], "edges array<double>")


def _fitted(normalised: DataFrame, bin_counts: list[int]) -> dict[int, list[float]]:
    """Adaptive edges of several numbers of bins by one selection of ranks."""
    shares = sorted({k / b for b in bin_counts for k in range(b + 1)})
    at = dict(zip(shares, ranks.quantiles(normalised, "z", shares), strict=False))
    return {b: sorted({round(at[k / b], 9) for k in range(b + 1) if k / b in at}) for b in bin_counts}


def edge_codes(normalised: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """A column for each name: the number of inner edges at or below ``z`` (bins are open on the right), by binary search."""
    cut = {name: e[1:-1] for name, e in edges.items() if len(e) > 2}
    out = normalised
    if cut:
        splits = [[-math.inf, *inner, math.inf] for inner in cut.values()]
        out = Bucketizer(splitsArray=splits, inputCols=["z"] * len(cut), outputCols=list(cut), handleInvalid="keep").transform(out)
    return out.withColumns({name: F.when(F.col("z").isNotNull(), F.col(name) if name in cut else F.lit(0)).cast("int") for name in edges})


def quantise(normalised: DataFrame, method: str, bins: int, edges: DataFrame | None = None) -> DataFrame:
    """``code`` by method uniform, mu_law or adaptive (one row of edges, fitted on the input unless given)."""
    z = F.col("z")
    if method == "uniform":
        return normalised.withColumn("code", S.uniform_code(z, bins, -4.0, 4.0))
    if method == "mu_law":
        return normalised.withColumn("code", S.mu_code(z, bins))
    if method == "adaptive":
        fitted = edges.first()["edges"] if edges is not None else _fitted(normalised, [bins])[bins]  # bins + 1 numbers at most
        return edge_codes(normalised, {"code": fitted})
    raise ValueError(f"unknown method {method!r}")


def dequantise(coded: DataFrame, method: str, bins: int) -> DataFrame:
    """``z_hat``: bin midpoints, or the mean of the bin for adaptive codes."""
    if method == "uniform":
        return coded.withColumn("z_hat", S.uniform_value(F.col("code"), bins, -4.0, 4.0))
    if method == "mu_law":
        return coded.withColumn("z_hat", S.mu_value(F.col("code"), bins))
    return coded.join(F.broadcast(coded.groupBy("code").agg(F.avg("z").alias("z_hat"))), "code")  # at most ``bins`` rows


def quality(decoded: DataFrame, by: list[str]) -> DataFrame:
    """mse, rmse, sqnr_db and correlation of ``z_hat``."""
    error = F.pow(F.col("z") - F.col("z_hat"), 2)
    return decoded.groupBy(*by).agg(F.avg(error).alias("mse"), F.avg(F.pow("z", F.lit(2))).alias("power"), S.correlation("z", "z_hat").alias("pearson")).select(
        *by, "mse", F.sqrt("mse").alias("rmse"), (10 * F.log10(F.col("power") / F.greatest("mse", F.lit(1e-20)))).alias("sqnr_db"), "pearson"
    )


def quality_grid(normalised: DataFrame, methods: tuple[str, ...], bin_counts: tuple[int, ...]) -> DataFrame:
    """``quality`` of every method and number of bins: one pass sums n, z and z^2 of every code, from which all measures follow."""
    z, grid = F.col("z"), []
    if "adaptive" in methods:
        normalised = edge_codes(normalised, {f"_{b}": e for b, e in _fitted(normalised, list(bin_counts)).items()})
    for method in methods:
        for b in bin_counts:
            code = {"uniform": lambda b=b: S.uniform_code(z, b, -4.0, 4.0), "mu_law": lambda b=b: S.mu_code(z, b), "adaptive": lambda b=b: F.col(f"_{b}")}[method]()
            grid.append(F.struct(F.lit(method).alias("method"), F.lit(b).alias("n_bins"), code.alias("code")))
    codes = normalised.where("z is not null").select("z", F.explode(F.array(*grid)).alias("c")).groupBy("c.method", "c.n_bins", "c.code").agg(F.count("*").alias("n"), F.sum("z").alias("s"), F.sum(z * z).alias("q"))
    n_bins, code = F.col("n_bins").cast("double"), F.col("code")
    middle = lambda low, high: F.lit(low) + (code + F.lit(0.5)) * (F.lit(high - low) / n_bins)
    value = F.when(F.col("method") == "uniform", middle(-4.0, 4.0)).when(F.col("method") == "mu_law", S.mu_expand(middle(-1.0, 1.0)) * F.lit(4.0)).otherwise(F.col("s") / F.col("n"))
    v = codes.withColumn("v", value).withColumn("e", F.greatest(F.col("q") - 2 * F.col("v") * F.col("s") + F.col("n") * F.col("v") * F.col("v"), F.lit(0.0)))
    total = v.groupBy("method", "n_bins").agg(*(F.sum(x).alias(name) for name, x in (("n", F.col("n")), ("s", F.col("s")), ("q", F.col("q")), ("e", F.col("e")), ("v", F.col("n") * F.col("v")), ("vv", F.col("n") * F.col("v") * F.col("v")), ("zv", F.col("s") * F.col("v")))))
    n = F.col("n")
    spread = lambda q, m: F.greatest(F.col(q) / n - F.pow(F.col(m) / n, 2), F.lit(0.0))
    pearson = (F.col("zv") / n - F.col("s") / n * F.col("v") / n) / F.nullif(F.sqrt(spread("q", "s") * spread("vv", "v")), F.lit(0.0))
    mse = F.col("e") / n
    return total.select("method", "n_bins", mse.alias("mse"), F.sqrt(mse).alias("rmse"), (10 * F.log10(F.col("q") / n / F.greatest(mse, F.lit(1e-20)))).alias("sqnr_db"), pearson.alias("pearson"))


def denormalise(decoded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``x_hat`` in the units of ``x``: the z-norm of ``by`` undone."""
    w = Window.partitionBy(*(by or ROW))
    return decoded.withColumn("x_hat", F.col("z_hat") * F.greatest(F.stddev_pop("x").over(w), F.lit(S.EPS)) + F.avg("x").over(w))


def quantise_range(samples: DataFrame, bins: int) -> DataFrame:
    """``code`` by uniform bins between the least and greatest ``x`` of the data."""
    ends = samples.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    low, high = F.col("low"), F.col("high")
    code = F.floor((F.col("x") - low) / (high - low + F.lit(S.STEP)) * bins)
    return samples.join(F.broadcast(ends)).withColumn("code", F.least(F.greatest(code, F.lit(0)), F.lit(bins - 1)).cast("int")).drop("low", "high")  # one row


def delta(samples: DataFrame) -> DataFrame:
    w = Window.partitionBy(*ROW).orderBy("t")
    return samples.withColumn("dx", F.coalesce(F.col("x") - F.lag("x").over(w), F.lit(0.0)))


def segments(samples: DataFrame, n: int, drop_tail: bool = True) -> DataFrame:
    """Non-overlapping segments of ``n`` samples; a shorter last one goes."""
    s = samples.withColumn("segment", F.floor(F.col("t") / n).cast("int")).withColumn("t_in", (F.col("t") % n).cast("int"))
    if not drop_tail:
        return s
    w = Window.partitionBy(*ROW, "segment")
    return s.withColumn("_n", F.count("*").over(w)).where(F.col("_n") == n).drop("_n")


def interval_epochs(samples: DataFrame, marks: DataFrame, before: str, after: str) -> DataFrame:
    """Samples (subject, ts, x) within the window around each mark (subject, mark, at): an interval join cut to hourly buckets, so that it hashes."""
    low, high = F.col("at") - F.expr(before), F.col("at") + F.expr(after)
    hours = F.transform(F.sequence(F.date_trunc("hour", low), F.date_trunc("hour", high), F.expr("interval 1 hour")), lambda h: h)
    m = marks.withColumn("low", low).withColumn("high", high).withColumn("bucket", F.explode(hours))
    s = samples.withColumn("bucket", F.date_trunc("hour", "ts"))
    return s.join(m, ["subject", "bucket"]).where("ts between low and high").drop("bucket", "low", "high")


def balanced(trials: DataFrame, seed: int = 42) -> DataFrame:
    """Per subject, as many trials of each label as its rarest label has, by a hash of the trial."""
    sizes = trials.groupBy("subject", "label").count().groupBy("subject").agg(F.min("count").alias("quota"))
    w = Window.partitionBy("subject", "label").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("trial").cast("string")).cast("binary")), "trial")
    return trials.withColumn("_n", F.row_number().over(w)).join(sizes, "subject").where("_n <= quota").drop("_n", "quota")


def fragment(samples: DataFrame, n: int) -> DataFrame:
    """The first ``n`` samples of each channel, its trials joined in order."""
    w = Window.partitionBy("subject", "channel").orderBy("trial", "t")
    return samples.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).where(F.col("pos") < n)


def padded(sequences: DataFrame, column: str, n: int, fill: Column) -> DataFrame:
    """Arrays cut or filled to ``n``."""
    return sequences.withColumn(column, F.slice(F.concat(column, F.array_repeat(fill, n)), 1, n))


def decimate(samples: DataFrame, factor: int) -> DataFrame:
    return samples.where(F.col("t") % factor == 0).withColumn("t", (F.col("t") / factor).cast("int"))


def block_mean(samples: DataFrame, n: int) -> DataFrame:
    return segments(samples, n).groupBy(*ROW, "segment").agg(F.avg("x").alias("x")).withColumnRenamed("segment", "t")


def patches(samples: DataFrame, n: int) -> DataFrame:
    return segments(samples, n).groupBy(*ROW, "segment").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def frames(samples: DataFrame, size: int, hop: int) -> DataFrame:
    """Overlapping frames: each sample goes to every frame that holds it; incomplete frames go."""
    first = F.greatest(F.ceil((F.col("t") - size + 1) / hop), F.lit(0))
    out = samples.withColumn("frame", F.explode(F.sequence(first.cast("int"), F.floor(F.col("t") / hop).cast("int")))).withColumn("k", (F.col("t") - F.col("frame") * hop).cast("int"))
    w = Window.partitionBy(*ROW, "frame")
    return out.withColumn("_n", F.count("*").over(w)).where(F.col("_n") == size).drop("_n")


def welch_bands(samples: DataFrame, size: int, rate: float, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Mean log power of each band [low, high) over half-overlapping, detrended frames; 0 where it has no bin."""
    psd = spectra.mean_power(samples, size, size // 2)
    hz = F.col("bin") * F.lit(rate / size)
    return psd.groupBy(*ROW).agg(*(F.coalesce(F.avg(F.when((hz >= low) & (hz < high), F.log1p("power"))), F.lit(0.0)).alias(name) for name, (low, high) in bands.items()))


def hjorth(samples: DataFrame) -> DataFrame:
    """activity, mobility, complexity of every row."""
    w = Window.partitionBy(*ROW).orderBy("t")
    d1 = samples.withColumn("d1", F.col("x") - F.lag("x").over(w))
    d2 = d1.withColumn("d2", F.col("d1") - F.lag("d1").over(w))
    v = d2.groupBy(*ROW).agg(F.var_pop("x").alias("v0"), F.var_pop("d1").alias("v1"), F.var_pop("d2").alias("v2"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.sqrt(F.col(a) / F.col(b))).otherwise(0.0)
    return v.select(*ROW, F.col("v0").alias("activity"), ratio("v1", "v0").alias("mobility"), F.when((F.col("v0") > 0) & (F.col("v1") > 0), ratio("v2", "v1") / ratio("v1", "v0")).otherwise(0.0).alias("complexity"))


def class_covariance(samples: DataFrame) -> DataFrame:
    """Channel covariances of each label: the channels of a time step meet once, their pairs are summed map-side."""
    steps = samples.groupBy("subject", "trial", "t", "label").agg(F.array_sort(F.collect_list(F.struct("channel", "x"))).alias("c"))
    pairs = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: b["channel"] >= a["channel"]), lambda b: F.struct(a["channel"].alias("c1"), b["channel"].alias("c2"), a["x"].alias("x1"), b["x"].alias("x2")))))
    return steps.select("label", F.inline(pairs)).groupBy("label", "c1", "c2").agg(F.covar_pop("x1", "x2").alias("cov"), F.count("*").alias("n"))


def spatial_filter(samples: DataFrame, filters: DataFrame) -> DataFrame:
    """Components: sum of weight * x over channels, for filters (component, channel, w), a table of channels squared rows."""
    return samples.join(F.broadcast(filters), "channel").groupBy("subject", "trial", "component", "t", "label").agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def time_chunks(samples: DataFrame, seconds: int) -> DataFrame:
    """``chunk``: number of the span of ``seconds`` since the epoch that holds ``ts``; short spans stay."""
    return samples.withColumn("chunk", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(seconds * 1_000_000)))


def span_chunks(samples: DataFrame, spans: DataFrame, seconds: int) -> DataFrame:
    """Samples (subject, ts, ..) with ``label``, ``start`` and ``chunk`` of every whole chunk of an annotated span (subject, start, end, label) that holds them.

    A span is cut from its start into chunks of ``seconds``; what is left at its end, spans
    shorter than a chunk and samples outside all spans go. Spans may overlap: a sample then stands in each. An
    interval join cut to buckets of a chunk's length, of which a chunk meets two.
    """
    size = F.lit(seconds * 1_000_000).cast("long")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    whole = spans.withColumn("_low", micros("start")).withColumn("_n", F.floor((micros("end") - F.col("_low")) / size).cast("int")).where("_n > 0")
    chunks = whole.select("subject", "label", "start", "_low", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("chunk")).withColumn("_low", F.col("_low") + F.col("chunk") * size)
    buckets = F.array_distinct(F.array(F.floor(F.col("_low") / size), F.floor((F.col("_low") + size - 1) / size)))
    c = chunks.withColumn("_bucket", F.explode(buckets))
    s = samples.withColumn("_at", micros("ts")).withColumn("_bucket", F.floor(F.col("_at") / size))
    return s.join(c, ["subject", "_bucket"]).where((F.col("_at") >= F.col("_low")) & (F.col("_at") < F.col("_low") + size)).drop("_bucket", "_at", "_low")


def relayout(trials: DataFrame, column: str, shape: tuple[int, int, int]) -> DataFrame:
    """Trials (key columns, repetition, channel, t, x) of an array laid out as channel, time, repetition."""
    channels, times, repetitions = shape
    rows = trials.select(*[c for c in trials.columns if c != column], F.posexplode(column).alias("i", "x"))
    return rows.select(
        *[c for c in trials.columns if c != column], (F.col("i") % repetitions).alias("repetition"), F.floor(F.col("i") / (times * repetitions)).cast("int").alias("channel"),
        (F.floor(F.col("i") / repetitions) % times).cast("int").alias("t"), F.col("x").cast("double").alias("x"),
    ).where(F.col("channel") < channels)


def select_channels(samples: DataFrame, prefix: str | None = None, without: str | None = None, first: int | None = None) -> DataFrame:
    """Channels that start with ``prefix``, do not start with ``without``, and of those the ``first`` by name."""
    out = samples
    if prefix is not None:
        out = out.where(F.col("channel").startswith(prefix))
    if without is not None:
        out = out.where(~F.col("channel").startswith(without))
    if first is not None:
        out = out.join(F.broadcast(out.select("channel").distinct().orderBy("channel").limit(first)), "channel", "left_semi")
    return out


def common_channels(one: DataFrame, other: DataFrame) -> DataFrame:
    """(channel, place) of the channels of ``one`` that ``other`` has too, in the order of ``one`` (channel, place)."""
    return one.join(other.select("channel").distinct(), "channel", "left_semi")


def rate_check(samples: DataFrame, rate: float, seconds: float) -> DataFrame:
    """(row key, n, expected, ok): a row holds round(rate * seconds) + 1 samples, one more or less."""
    expected = int(rate * seconds + 0.5) + 1
    return samples.groupBy(*ROW).agg(F.count("*").alias("n")).select(*ROW, "n", F.lit(expected).alias("expected"), (F.abs(F.col("n") - expected) <= 1).alias("ok"))


def arrays(samples: DataFrame, key: list[str], value: str = "x") -> DataFrame:
    """One row for each key, its values by t as an array ``x``."""
    return samples.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", value))), lambda s: s[value]).alias("x"))


def assembled(samples: DataFrame, channels: list[str]) -> DataFrame:
    """(subject, trial, channel, x): every trial has all ``channels``, all arrays the longest length; gaps are zero."""
    rows = arrays(samples, ROW)
    longest = rows.agg(F.max(F.size("x")).alias("longest"))
    grid = samples.select("subject", "trial").distinct().withColumn("channel", F.explode(F.array(*map(F.lit, channels))))
    padded_x = F.concat(F.coalesce("x", F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), F.col("longest") - F.coalesce(F.size("x"), F.lit(0))))
    return grid.join(rows, ROW, "left").join(F.broadcast(longest)).select(*ROW, padded_x.alias("x"))  # one row


def truncated(samples: DataFrame) -> DataFrame:
    """Samples below the length of the shortest row."""
    least = samples.groupBy(*ROW).agg(F.count("*").alias("n")).agg(F.min("n").alias("shortest"))
    return samples.join(F.broadcast(least)).where(F.col("t") < F.col("shortest")).drop("shortest")  # one row


def budgeted(samples: DataFrame, budget: int) -> DataFrame:
    """Samples within an equal share of ``budget`` for each subject, channels in order, the last one cut."""
    subjects = samples.select("subject").distinct().agg(F.count("*").alias("k"))
    sizes = samples.groupBy(*ROW).agg(F.count("*").alias("n"))
    w = Window.partitionBy("subject").orderBy("channel", "trial").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    share = F.floor(F.lit(budget) / F.col("k"))
    return samples.join(before, ROW).join(F.broadcast(subjects)).where(F.col("before") + F.col("t") < share).drop("before", "k")  # one row


def lowpass_kernel(cut: float, rate: float, taps: int) -> list[float]:
    """Windowed-sinc low-pass of odd length, Hamming window, sum one."""
    half, f = taps // 2, min(cut / rate, 0.499)
    h = [(2 * f if k == 0 else math.sin(2 * math.pi * f * k) / (math.pi * k)) * (0.54 + 0.46 * math.cos(math.pi * k / half)) for k in range(-half, half + 1)]
    return [v / sum(h) for v in h]


def bandpass_kernel(low: float, high: float, rate: float, taps: int) -> list[float]:
    """Difference of two low-passes, clamped below half the rate."""
    high = min(high, 0.499 * rate)
    return [a - b for a, b in zip(lowpass_kernel(high, rate, taps), lowpass_kernel(low, rate, taps), strict=True)]


def notch_kernel(low: float, high: float, rate: float, taps: int) -> list[float]:
    """All but a band."""
    return [(k == taps // 2) - v for k, v in enumerate(bandpass_kernel(low, high, rate, taps))]


def convolved(samples: DataFrame, kernel: list[float]) -> DataFrame:
    """``x`` filtered by an odd, centred kernel within its row; nothing stands beyond the ends."""
    return filters.convolved(samples, kernel)


def cleaned(samples: DataFrame, rate: float, low: float = 0.5, high: float = 45.0, notches: tuple[float, ...] = (50.0, 60.0), taps: int | None = None, to_rate: float | None = None) -> DataFrame:
    """Band-pass, then a notch of two Hz at each mains frequency below half the rate, then resampling if asked.

    Without ``taps`` a kernel is as long as an edge at ``low`` that falls off within ``low`` Hz
    needs. All kernels are symmetric, so no phase moves; they are one kernel, as filters in a row are.
    """
    taps = taps or filters.taps_for(rate, low)
    kernel = np.array(bandpass_kernel(low, high, rate, taps))
    for hz in notches:
        if hz + 1 < rate / 2:
            kernel = np.convolve(kernel, notch_kernel(hz - 1, hz + 1, rate, taps))
    out = convolved(samples, kernel)
    if to_rate is None or to_rate == rate:
        return out
    share = Fraction(to_rate / rate).limit_denominator(1000)
    return filters.rational(out, share.numerator, share.denominator)


def downsample(samples: DataFrame, up: int, down: int) -> DataFrame:
    """Polyphase resampling by up / down behind its own low-pass."""
    return filters.rational(samples, up, down)


def resampled(rows: DataFrame, n: int, m: int) -> DataFrame:
    """Arrays ``x`` of ``n`` samples as arrays of ``m``, by Fourier resampling."""
    return filters.fourier_resampled(rows, n, m)


def psd(samples: DataFrame, size: int, rate: float) -> DataFrame:
    """(row key, bin, hz, density): one-sided power density by Welch's method, half overlap, constant detrend."""
    energy = sum((0.5 - 0.5 * math.cos(2 * math.pi * k / size)) ** 2 for k in range(size))
    power = spectra.mean_power(samples, size, size // 2).withColumnRenamed("power", "p")
    both = F.when((F.col("bin") > 0) & (F.col("bin") < size // 2), 2.0).otherwise(1.0)
    return power.select(*ROW, "bin", (F.col("bin") * (rate / size)).alias("hz"), (F.col("p") * size * both / (rate * energy)).alias("density"))


def band_power(density: DataFrame, key: list[str], bands: dict[str, tuple[float, float]], step: float) -> DataFrame:
    """(key, band, power): sum of densities with low <= hz <= high, times the step of frequencies; 0 without a bin."""
    table = F.array(*(F.struct(F.lit(n).alias("band"), F.lit(a).alias("low"), F.lit(b).alias("high")) for n, (a, b) in bands.items()))
    rows = density.withColumn("b", F.explode(table))
    inside = (F.col("hz") >= F.col("b.low")) & (F.col("hz") <= F.col("b.high"))
    return rows.groupBy(*key, F.col("b.band").alias("band")).agg((F.sum(F.when(inside, F.col("density")).otherwise(0.0)) * step).alias("power"))


def band_distortion(decoded: DataFrame, size: int, rate: float, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """(band, distortion_pct): mean over rows of the relative change of band power between ``z`` and ``z_hat``."""
    power = lambda c, name: band_power(psd(decoded.withColumn("x", F.col(c)), size, rate), ROW, bands, rate / size).withColumnRenamed("power", name)
    both = power("z", "before").join(power("z_hat", "after"), [*ROW, "band"])
    change = F.when(F.col("before") > 0, F.abs(F.col("before") - F.col("after")) / F.col("before") * 100).otherwise(0.0)
    return both.groupBy("band").agg(F.avg(change).alias("distortion_pct"))


def spectral_vectors(samples: DataFrame, size: int, hop: int) -> DataFrame:
    """(row key, frame, bin, z): log power of each frame, z-scored over its bins."""
    return spectra.binned(samples, size, hop, finish=spectra.log_scaled).withColumnRenamed("power", "z")


def spectral_flat(samples: DataFrame, size: int, hop: int) -> DataFrame:
    """(row key, x): log powers of all frames, by frame and bin, as one array."""
    power = spectra.spectra(samples, size, hop, finish=np.log1p)
    return power.groupBy(*ROW).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("frame", "power"))), lambda s: s["power"])).alias("x"))


def frame_size(n_times: int, wanted: int) -> int:
    """A frame is a quarter of a row at most."""
    return max(2, min(wanted, n_times // 4))


def fft_log_power(samples: DataFrame, n: int, rate: float, low: float, high: float) -> DataFrame:
    """(row key, bin, log_power) of rows of ``n`` samples as one Hann frame, for low <= hz <= high."""
    bins = [k for k in range(n // 2 + 1) if low <= k * (rate / n) <= high]
    return spectra.binned(samples.where(F.col("t") < n), n, n, finish=np.log1p, bins=bins).select(*ROW, "bin", F.col("power").alias("log_power"))


def described(before: DataFrame, after: DataFrame, rate_before: float, rate_after: float) -> DataFrame:
    """Rows, samples, longest row in seconds and range of ``x`` before and after preprocessing."""
    def one(s: DataFrame, name: str, rate: float) -> DataFrame:
        n = s.groupBy(*ROW).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        return n.agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_samples"), (F.max("n") / rate).alias("seconds"), F.min("low").alias("low"), F.max("high").alias("high")).select(F.lit(name).alias("stage"), "*")

    return one(before, "before", rate_before).unionByName(one(after, "after", rate_after))


#: The band in Hz of an envelope for each paradigm, of any other one, and the bands of several envelopes.
PARADIGM_BANDS = {"motor": (8.0, 30.0), "sleep": (0.5, 30.0), "ssvep": (6.0, 20.0), "p300": (1.0, 20.0), "workload": (8.0, 30.0)}
OTHER_BAND = (8.0, 30.0)
SEVERAL_BANDS = {"theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0)}
VIEW_RATE = 64.0  # Hz of the downsampled view and of envelopes
SPECTRAL_SECONDS, SPECTRAL_BAND = 1.0, (1.0, 45.0)

APPROACHES = ("raw", "downsample", "envelope", "spectral", "delta", "multiband")


def to_rate(samples: DataFrame, rate: float, target: float = VIEW_RATE) -> DataFrame:
    """Polyphase resampling between two whole rates."""
    return filters.rational(samples, int(target), int(rate))


def spectral_view(samples: DataFrame, rate: float, n_times: int) -> DataFrame:
    """Log powers of half-overlapping frames of a second, or a quarter of a row, within 1 to 45 Hz; ``t`` counts frames, then bins."""
    size = frame_size(n_times, int(rate * SPECTRAL_SECONDS))
    bins = [k for k in range(size // 2 + 1) if SPECTRAL_BAND[0] <= k * rate / size <= SPECTRAL_BAND[1]]
    place = F.array_position(F.array(*map(F.lit, bins)), F.col("bin")) - 1
    power = spectra.binned(samples, size, max(1, size // 2), finish=np.log1p, bins=bins).withColumn("t", (F.col("frame") * len(bins) + place).cast("int"))
    names = [c for c in samples.columns if c not in (*ROW, "t", "x")]
    out = power.select(*ROW, "t", F.col("power").alias("x"))
    return out.join(samples.select(*ROW, *names).distinct(), ROW) if names else out


def preprocessed(samples: DataFrame, approach: str, paradigm: str, rate: float, n_times: int) -> DataFrame:
    """Samples by one of six named approaches; an envelope takes its paradigm's band, kept below 0.9 of half the rate, and stays raw where nothing is left of it."""
    from siglex.operators import models

    safe = lambda band: (band[0], min(band[1], 0.9 * rate / 2))
    if approach == "downsample":
        return to_rate(samples, rate)
    if approach == "spectral":
        return spectral_view(samples, rate, n_times)
    if approach == "delta":
        return delta(samples).withColumn("x", F.col("dx")).drop("dx")
    if approach == "envelope":
        low, high = safe(PARADIGM_BANDS.get(paradigm, OTHER_BAND))
        return to_rate(models.envelope(samples, rate, low, high), rate) if low < high else samples
    if approach == "multiband":
        bands = {name: safe(band) for name, band in SEVERAL_BANDS.items()}
        bands = {name: band for name, band in bands.items() if band[0] < band[1]}
        return to_rate(models.multiband_envelope(samples, rate, bands), rate) if bands else samples
    if approach != "raw":
        raise ValueError(f"unknown approach {approach!r}")
    return samples
