"""Headline timings: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
Each query is planned and fully computed (no-op sink), in one session.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from barloom.operators.features import build_features
from barloom.plans import catalog
from barloom.session import build_session
from barloom.sources.fixtures import HOURLY_SPEC, table

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "features_returns", "features_technical", "features_regime", "features_quantile_rank",
    "feature_ic_weekly", "snapshot_asof", "feature_ic_pooled", "matrix_rolling", "fama_macbeth",
    "pump_scores", "portfolio_weekly_metrics", "performance_report", "model_trees", "stream_bars",
]


def features_all_users(spark, sf_dir):
    """All 72 features, every user its own symbol: the load test of the feature table."""
    bars = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").cast("string").alias("symbol"),
                 F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
        .agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
             F.max_by("value", "ts").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    )
    return build_features(bars, HOURLY_SPEC)


def main() -> None:
    spark = build_session(f"local[{CPUS}]", "bench", 8, spark__ui__enabled="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()
    known = catalog.queries()
    todo = {"features_all_users": features_all_users, **{n: known[n] for n in HEADLINE}}
    times = {}
    for name, query in todo.items():
        start = time.perf_counter()
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
