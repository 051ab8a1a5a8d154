"""Headline queries on the bench tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siglex.operators import bpe, signals
from siglex.plans import registry
from siglex.sources import shared, tables

HEADLINES = ("zscore_rows", "quantize_uniform", "quantize_adaptive", "pair_counts", "bpe_train_small", "bpe_apply_small", "hist_l1", "class_covariance", "stft_frames", "zipf_fit")
KEY = ["subject", "trial", "channel"]


def lineitem_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four channels of every line item as sequences of 64 codes."""
    z = signals.zscore(tables.lineitem_multi(spark, sf_dir))
    coded = signals.quantise(z, "uniform", 64).select(*KEY, z["t"].alias("pos"), F.col("code").alias("tok"))
    return shared.written(bpe.sequences(coded, KEY), "codes")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times, more = {}, {}

    def timed(name: str, f):
        began = time.time()
        out = f()
        times[name] = round(time.time() - began, 3)
        return out

    run = lambda df: df.write.format("noop").mode("overwrite").save()
    for name in HEADLINES:
        timed(name, lambda name=name: run(registry.queries()[name](spark, sf_dir)))
    codes = timed("lineitem_codes", lambda: lineitem_codes(spark, sf_dir))
    n_tokens = codes.agg(F.sum(F.size("toks"))).first()[0]
    exact = timed("lineitem_train_v128_exact", lambda: bpe.train(codes, 64, 128))
    whole = timed("lineitem_train_v256_exact", lambda: bpe.train(codes, 64, 256))
    relaxed = timed("lineitem_train_v128_relaxed", lambda: bpe.train(codes, 64, 128, relaxed=8))
    timed("lineitem_apply_v128", lambda: run(bpe.tokenise(codes, exact, 64)))
    timed("lineitem_apply_v256", lambda: run(bpe.tokenise(codes, whole, 64)))
    left = {n: bpe.tokenise(codes, m, 64).agg(F.sum(F.size("toks"))).first()[0] for n, m in (("exact", exact), ("relaxed", relaxed), ("v256", whole))}
    more = {"tokens": n_tokens, "apply_tokens_per_sec": round(n_tokens / times["lineitem_apply_v128"]), "compression_exact": round(n_tokens / left["exact"], 4), "compression_relaxed": round(n_tokens / left["relaxed"], 4), "compression_v256": round(n_tokens / left["v256"], 4), "merges_v256": len(whole)}
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), **more}))


if __name__ == "__main__":
    main()
