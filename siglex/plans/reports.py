"""Queries of report tables over a table of runs (dataset, model, vocab, seed, acc)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siglex.operators import reports, stats
from siglex.plans.common import query, r
from siglex.sources import tables as T

RUNS = "runs AS (SELECT c_mktsegment AS dataset, o_orderpriority AS model, 256 * CASE o_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END::BIGINT AS vocab, o_orderkey % 5 AS seed, avg(o_totalprice) / 499979 AS acc FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
#: Which models of the table of runs are token models, and what each data set is about.
TOKEN_MODELS = ("1-URGENT", "2-HIGH", "3-MEDIUM")
PARADIGMS = {"AUTOMOBILE": "motor", "BUILDING": "motor", "FURNITURE": "sleep", "HOUSEHOLD": "sleep", "MACHINERY": "workload"}
_MEAN = RUNS + ", m AS (SELECT dataset, model, avg(acc) AS acc FROM runs GROUP BY ALL)"
_KIND = "model IN (" + ", ".join(f"'{m}'" for m in TOKEN_MODELS) + ")"
_PARADIGM = "CASE dataset " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PARADIGMS.items()) + " END"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    o = T.table(spark, sf, "orders").join(T.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    vocab = (F.lit(256) * F.pow(F.lit(2), F.col("o_custkey") % 4)).cast("long")
    return o.groupBy(F.col("c_mktsegment").alias("dataset"), F.col("o_orderpriority").alias("model"), vocab.alias("vocab"), (F.col("o_orderkey") % 5).alias("seed")).agg((F.avg("o_totalprice") / 499979).alias("acc"))


@query("report_wide", _MEAN + f" SELECT dataset, model, {r('acc', 'acc')}, CASE WHEN acc >= max(acc) OVER (PARTITION BY dataset) - 0.002 THEN 'best' ELSE '' END AS mark, CASE WHEN acc <= 0.5 THEN 'chance' ELSE '' END AS flag FROM m")
def _(spark, sf):
    return reports.marked(runs(spark, sf), 0.5)


_CURVE = RUNS + ", v AS (SELECT dataset, vocab, avg(acc) AS acc FROM runs GROUP BY ALL)"


@query("report_best_vocab", _CURVE + f" SELECT dataset, arg_max(vocab, acc) AS best_vocab, {r('max(acc)', 'best_acc')}, {r('arg_min(acc, vocab)', 'first_acc')}, {r('arg_max(acc, vocab)', 'last_acc')}, count(*) AS n_points FROM v GROUP BY dataset")
def _(spark, sf):
    return reports.best_vocabulary(runs(spark, sf)).select("dataset", "best_vocab", "best_acc", F.col("curve")[0]["acc"].alias("first_acc"), F.element_at("curve", -1)["acc"].alias("last_acc"), F.size("curve").alias("n_points"))


@query("report_approaches", RUNS + " SELECT dataset, model, " + ", ".join(r(f"avg(acc) FILTER (vocab = {v})", f'"{v}"') for v in (256, 512, 1024, 2048)) + " FROM runs GROUP BY dataset, model")
def _(spark, sf):
    return reports.pivoted(runs(spark, sf), ["dataset", "model"], "vocab", [256, 512, 1024, 2048])


@query("report_ablations", RUNS + f", a AS (SELECT 'vocab' AS ablation, dataset, vocab::VARCHAR AS setting, avg(acc) AS acc FROM runs GROUP BY ALL UNION ALL SELECT 'seed', dataset, seed::VARCHAR, avg(acc) FROM runs GROUP BY ALL) SELECT ablation, dataset, setting, {r('acc', 'acc')} FROM (SELECT *, row_number() OVER (PARTITION BY ablation, dataset ORDER BY acc DESC, setting) AS n FROM a) WHERE n = 1")
def _(spark, sf):
    return stats.best_of(reports.ablations(runs(spark, sf), ["vocab", "seed"]), ["ablation", "dataset"], "acc")


_GAP = _MEAN + f", t AS (SELECT dataset, arg_max(model, acc) AS token_model, max(acc) AS token_acc FROM m WHERE {_KIND} GROUP BY dataset), b AS (SELECT dataset, arg_max(model, acc) AS baseline, max(acc) AS baseline_acc FROM m WHERE NOT {_KIND} GROUP BY dataset), g AS (SELECT *, (token_acc - baseline_acc) * 100 AS gap_pp FROM t JOIN b USING (dataset))"


@query("report_gap", _GAP + f" SELECT dataset, token_model, {r('token_acc', 'token_acc')}, baseline, {r('baseline_acc', 'baseline_acc')}, {r('gap_pp', 'gap_pp')}, CASE WHEN gap_pp > 1 THEN 'win' WHEN gap_pp < -1 THEN 'loss' ELSE 'tie' END AS flag FROM g")
def _(spark, sf):
    return reports.gap(runs(spark, sf), TOKEN_MODELS)


@query("report_trend", _CURVE + """, w AS (SELECT dataset, vocab, acc, acc - lag(acc) OVER (PARTITION BY dataset ORDER BY vocab) AS step FROM v), p AS (SELECT dataset, min(step) AS least, max(step) AS most, arg_max(vocab, acc) AS peak FROM w GROUP BY dataset)
SELECT dataset, CASE WHEN least >= 0 THEN 'up' WHEN most <= 0 THEN 'down' ELSE 'peak' END AS trend, peak FROM p""")
def _(spark, sf):
    return reports.trend(runs(spark, sf))


@query("report_wins", _GAP + f" SELECT {_PARADIGM} AS paradigm, count(*) FILTER (gap_pp > 0) AS wins, count(*) FILTER (gap_pp <= 0) AS fails, {r('avg(gap_pp)', 'mean_gap')} FROM g GROUP BY 1")
def _(spark, sf):
    return reports.wins(reports.gap(runs(spark, sf), TOKEN_MODELS), PARADIGMS)


_PAIRS = "x AS (SELECT l_returnflag AS source, CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS target, l_quantity / 50 AS acc FROM lineitem)"


@query("report_transfer", _PAIRS + " SELECT source, " + ", ".join(r(f"avg(acc) FILTER (target = '{t}')", f'"{t}"') for t in "ANR") + f", {r('avg(acc) FILTER (target = source)', 'native')}, {r('avg(acc) FILTER (target = source) - avg(acc) FILTER (target <> source)', 'loss')} FROM x GROUP BY source")
def _(spark, sf):
    target = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    x = T.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("source"), target.alias("target"), (F.col("l_quantity") / 50).alias("acc"))
    return reports.transfer_matrix(x, ["A", "N", "R"])


@query("report_status", RUNS + ", c AS (SELECT dataset, model, count(*) AS n_rows FROM runs GROUP BY ALL), w AS (SELECT dataset, model, 20::BIGINT AS expected FROM (SELECT DISTINCT c_mktsegment AS dataset FROM customer), (SELECT DISTINCT o_orderpriority AS model FROM orders)) SELECT dataset, model, coalesce(n_rows, 0) AS n_rows, expected, CASE WHEN n_rows IS NULL THEN 'missing' WHEN n_rows < expected THEN 'partial' ELSE 'complete' END AS status FROM w LEFT JOIN c USING (dataset, model)")
def _(spark, sf):
    rows = runs(spark, sf)
    models = [x[0] for x in T.table(spark, sf, "orders").select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]  # names of models
    grid = T.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("dataset")).distinct().withColumn("model", F.explode(F.array(*map(F.lit, models)))).withColumn("expected", F.lit(20))
    return reports.status(rows, grid, ["dataset", "model"])
