"""Report tables over runs (dataset, model, vocab, seed, acc)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siglex.sources.tables import union_results


def marked(runs: DataFrame, chance: float, near: float = 0.002) -> DataFrame:
    """Mean accuracy of each data set and model; marks within ``near`` of the best, flags at ``chance`` or below."""
    m = runs.groupBy("dataset", "model").agg(F.avg("acc").alias("acc"))
    best = F.max("acc").over(Window.partitionBy("dataset"))
    return m.withColumn("mark", F.when(F.col("acc") >= best - near, "best").otherwise("")).withColumn("flag", F.when(F.col("acc") <= chance, "chance").otherwise(""))


def best_vocabulary(runs: DataFrame) -> DataFrame:
    """(dataset, best_vocab, best_acc, curve) with the curve by size of vocabulary."""
    v = runs.groupBy("dataset", "vocab").agg(F.avg("acc").alias("acc"))
    return v.groupBy("dataset").agg(F.max_by("vocab", "acc").alias("best_vocab"), F.max("acc").alias("best_acc"), F.array_sort(F.collect_list(F.struct("vocab", "acc"))).alias("curve"))


def pivoted(runs: DataFrame, key: list[str], column: str, values: list) -> DataFrame:
    """Mean accuracy with a column for each of ``values``."""
    return runs.groupBy(*key).pivot(column, values).agg(F.avg("acc"))


def ablations(runs: DataFrame, columns: list[str]) -> DataFrame:
    """(ablation, dataset, setting, acc) of every varied column, one below the other."""
    return union_results(*(runs.groupBy("dataset", F.col(c).cast("string").alias("setting")).agg(F.avg("acc").alias("acc")).select(F.lit(c).alias("ablation"), "dataset", "setting", "acc") for c in columns))


def gap(runs: DataFrame, token_models: tuple[str, ...], tie: float = 1.0) -> DataFrame:
    """Best token model against the best other one of each data set, the gap in points and its flag."""
    m = runs.groupBy("dataset", "model").agg(F.avg("acc").alias("acc"))
    ours = F.col("model").isin(*token_models)
    best = m.groupBy("dataset").agg(
        F.max_by(F.when(ours, F.col("model")), F.when(ours, F.col("acc"))).alias("token_model"), F.max(F.when(ours, F.col("acc"))).alias("token_acc"),
        F.max_by(F.when(~ours, F.col("model")), F.when(~ours, F.col("acc"))).alias("baseline"), F.max(F.when(~ours, F.col("acc"))).alias("baseline_acc"),
    ).where("token_acc is not null and baseline_acc is not null")
    pp = (F.col("token_acc") - F.col("baseline_acc")) * 100
    return best.withColumn("gap_pp", pp).withColumn("flag", F.when(F.col("gap_pp") > tie, "win").when(F.col("gap_pp") < -tie, "loss").otherwise("tie"))


def trend(runs: DataFrame) -> DataFrame:
    """Whether accuracy only rises or only falls with the vocabulary, or peaks, and where."""
    v = runs.groupBy("dataset", "vocab").agg(F.avg("acc").alias("acc"))
    step = v.withColumn("step", F.col("acc") - F.lag("acc").over(Window.partitionBy("dataset").orderBy("vocab")))
    out = step.groupBy("dataset").agg(F.min("step").alias("least"), F.max("step").alias("most"), F.max_by("vocab", "acc").alias("peak"))
    return out.select("dataset", F.when(F.col("least") >= 0, "up").when(F.col("most") <= 0, "down").otherwise("peak").alias("trend"), "peak")


def wins(gaps: DataFrame, paradigms: dict[str, str]) -> DataFrame:
    """Wins and fails of token models by paradigm."""
    names = F.create_map(*(F.lit(x) for pair in paradigms.items() for x in pair))
    return gaps.groupBy(names[F.col("dataset")].alias("paradigm")).agg(F.count_if(F.col("gap_pp") > 0).alias("wins"), F.count_if(F.col("gap_pp") <= 0).alias("fails"), F.avg("gap_pp").alias("mean_gap"))


def transfer_matrix(results: DataFrame, names: list[str]) -> DataFrame:
    """Accuracy of each source on each target, its native one, and what transfer loses."""
    own = F.avg(F.when(F.col("source") == F.col("target"), F.col("acc")))
    other = F.avg(F.when(F.col("source") != F.col("target"), F.col("acc")))
    cells = (F.avg(F.when(F.col("target") == n, F.col("acc"))).alias(n) for n in names)
    return results.groupBy("source").agg(*cells, own.alias("native"), (own - other).alias("loss"))


def status(runs: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """Rows there against rows ``expected`` of each experiment."""
    n = runs.groupBy(*key).agg(F.count("*").alias("n"))
    rows = expected.join(n, key, "left").withColumn("n_rows", F.coalesce("n", F.lit(0)))
    return rows.withColumn("status", F.when(F.col("n_rows") == 0, "missing").when(F.col("n_rows") < F.col("expected"), "partial").otherwise("complete")).select(*key, "n_rows", "expected", "status")
