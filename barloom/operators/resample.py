"""Resampling, date splits and week calendars."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import timeframe_minutes


def time_bucket(ts: str | Column, timeframe: str) -> Column:
    """Start of the bucket a timestamp falls in, as timestamp_ntz. Weeks start on Monday."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    minutes = timeframe_minutes(timeframe)
    if minutes == 10080:
        return F.date_trunc("week", ts).cast("timestamp_ntz")
    start = F.window(ts.cast("timestamp_ntz"), f"{minutes} minutes")
    return start.getField("start").cast("timestamp_ntz")


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """OHLCV bars of a coarser timeframe: one two-phase aggregate, empty buckets do not appear."""
    return (
        bars.groupBy("symbol", time_bucket("ts", timeframe).alias("_bucket"))
        .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"),
             F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
             F.sum("volume").alias("volume"))
        .withColumnRenamed("_bucket", "ts")
        .select("symbol", "ts", "open", "high", "low", "close", "volume")
    )


def week_of(ts: str | Column) -> Column:
    return F.date_trunc("week", F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")


def following_week(ts: str | Column) -> Column:
    """Monday after the timestamp: the first week that may use the row."""
    return (week_of(ts) + F.expr("INTERVAL 7 DAYS")).cast("timestamp_ntz")


def week_grid(bars: DataFrame, start: datetime | None = None) -> DataFrame:
    """Consecutive (week, week_start, week_end) Monday pairs inside the data range.

    One two-column aggregate; the sequence is expanded from a single row.
    """
    span = bars.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    if start is not None:
        span = span.withColumn("lo", F.lit(start).cast("timestamp_ntz"))
    lo, hi = F.col("lo").cast("timestamp_ntz"), F.col("hi").cast("timestamp_ntz")
    monday = week_of("lo")
    first = F.when(monday < lo, monday + F.expr("INTERVAL 7 DAYS")).otherwise(monday)
    starts = span.select(F.explode(
        F.sequence(first.cast("timestamp_ntz"), week_of(hi), F.expr("INTERVAL 7 DAYS"))
    ).alias("week_start"))
    order = Window.orderBy("week_start")  # one row per calendar week: a few thousand at most
    return (
        starts.select(
            F.row_number().over(order).cast("long").alias("week"), "week_start",
            F.lead("week_start").over(order).alias("week_end"))
        .where(F.col("week_end").isNotNull())
    )


def _range(bars: DataFrame) -> tuple[datetime, datetime]:
    row = bars.agg(F.min("ts"), F.max("ts")).first()
    return row[0], row[1]


def rolling_splits(bars: DataFrame) -> dict[str, datetime]:
    """Training end and out-of-sample midpoint: 104 weeks from 208 on, half from 104 on, else a third."""
    lo, hi = _range(bars)
    span = hi - lo
    if span >= timedelta(weeks=208):
        train_end = lo + timedelta(weeks=104)
    elif span >= timedelta(weeks=104):
        train_end = lo + span / 2
    else:
        train_end = lo + span / 3
    return {"start": lo, "train_end": train_end, "oos_mid": train_end + (hi - train_end) / 2,
            "end": hi}


def third_splits(bars: DataFrame) -> dict[str, datetime]:
    lo, hi = _range(bars)
    third = (hi - lo) / 3
    return {"start": lo, "train_end": lo + third, "oos_mid": lo + 2 * third, "end": hi}


def zone(week_end: str | Column, oos_mid: datetime) -> Column:
    week_end = F.col(week_end) if isinstance(week_end, str) else week_end
    return F.when(week_end <= F.lit(oos_mid).cast("timestamp_ntz"), F.lit("Y2")).otherwise(F.lit("Y3"))
