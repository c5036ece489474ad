"""Bar views over the driver tables, so that every operator can run on them.

``hourly_bars``: events -> 8 symbols, hourly. ``daily_bars``: lineitem -> 20 symbols, daily.
Both are two-phase aggregates: what is shuffled is one row per (symbol, bucket) and map task.
Daily bars are staged, as a query reads them many times: lineitem is aggregated once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from ..spec import BarSpec

HOURLY_SPEC = BarSpec(4, 24, 15)
DAILY_SPEC = BarSpec(5, 20, 12)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # all times in the package are UTC
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    tick = F.struct("ts", "event_id")
    return (
        table(spark, sf_dir, "events")
        .select("ts", "event_id", "value",
                F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("symbol"),
                F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
        .groupBy("symbol", "hour")
        .agg(F.min_by("value", tick).alias("open"), F.max("value").alias("high"),
             F.min("value").alias("low"), F.max_by("value", tick).alias("close"),
             F.count(F.lit(1)).cast("double").alias("volume"))
        .withColumnRenamed("hour", "ts")
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    # (orderkey, linenumber) repeats, so the tie-break has to go down to the values.
    tick = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                    "l_extendedprice")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return stage(
        table(spark, sf_dir, "lineitem")
        .select(tick.alias("tick"), price.alias("price"), "l_quantity",
                F.concat(F.lit("L"), (F.col("l_suppkey") % 20).cast("string")).alias("symbol"),
                F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("ts"))
        .groupBy("symbol", "ts")
        .agg(F.min_by("price", "tick").alias("open"), F.max("price").alias("high"),
             F.min("price").alias("low"), F.max_by("price", "tick").alias("close"),
             F.sum("l_quantity").alias("volume"))
    )
