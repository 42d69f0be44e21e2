"""Headline queries, timed end to end. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "ldcp_change", "ema", "rsi", "turbulence", "technical_indicators", "feature_matrix", "feature_matrix_decay",
    "scaler_apply", "sequence_windows", "intraday_indicators", "dedup_cross_source", "headline_gate", "multi_label",
    "relevance_cascade", "daily_sentiment_pivot", "price_sentiment_join", "news_features_join", "extract_links",
    "parse_json_items", "auc", "metrics_summary", "early_stop", "stream_daily_sentiment",
)


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.sql.adaptive.enabled", "true")
        # Window work is heavy per byte: let small shuffles keep their partitions.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # One feature plan compiles more classes than the default cache of 100 holds.
        .config("spark.sql.codegen.cache.maxEntries", "1000")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    from registry.queries import QUERIES

    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    times = {}
    for name in HEADLINES:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, wall seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
