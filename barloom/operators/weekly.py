"""Weekly panel: point-in-time snapshots and realised returns, all weeks in one job.

The as-of join "last row before the week" is an equi-bucket: a row belongs to the Monday after it,
the newest row per (symbol, Monday) is a map-side-combined max_by, and weeks without fresh rows are
filled forward on the small (symbol, week) table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import log_ratio
from .layout import positions
from .resample import following_week, week_of


def weekly_returns(bars: DataFrame, max_abs: float | None = 0.5, min_bars: int = 2) -> DataFrame:
    """(symbol, week, ret, n_bars): log return first to last close of the week.

    Weeks with too few bars, a non-positive first close or a move beyond ``max_abs`` are left out.
    """
    agg = bars.groupBy("symbol", week_of("ts").alias("week")).agg(
        F.min_by("close", "ts").alias("first"), F.max_by("close", "ts").alias("last"),
        F.count(F.lit(1)).alias("n_bars"))
    out = agg.where((F.col("n_bars") >= min_bars) & (F.col("first") > 0)).select(
        "symbol", "week", log_ratio("last", "first").alias("ret"), "n_bars")
    out = out.where(F.col("ret").isNotNull())
    return out.where(F.abs("ret") <= max_abs) if max_abs is not None else out


def summed_returns(feats: DataFrame, column: str = "ret_1bar") -> DataFrame:
    """Weekly return as the sum of bar returns, for tables without a close."""
    return feats.groupBy("symbol", week_of("ts").alias("week")).agg(
        F.coalesce(F.sum(column), F.lit(0.0)).alias("ret"))


def _fill_weeks(snaps: DataFrame, payload: Sequence[str]) -> DataFrame:
    """Carry each symbol's newest payload to every later week, up to the week of the newest row.

    Each row is repeated up to the next one of its symbol. The newest week is asked of the very
    table that is filled, all its columns included, so that Spark computes and shuffles that small
    table once and reads it twice.
    """
    snaps = snaps.where(F.col("week").isNotNull()).repartition("symbol", "week")
    week = F.expr("INTERVAL 7 DAYS")
    # Rows of the newest week are filed under the Monday after it.
    last_week = snaps.agg(
        (F.max(F.struct("week", "symbol", *payload))["week"] - week).alias("_hi")).scalar()
    upcoming = F.lead("week").over(Window.partitionBy("symbol").orderBy("week"))
    held = snaps.withColumn("_hi", last_week).withColumn(
        "_end", F.least(upcoming - week, F.col("_hi"))).where(F.col("week") <= F.col("_hi"))
    return held.select(
        "symbol", F.explode(F.sequence("week", "_end", week)).alias("week"), *payload)


def snapshots(feats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Last row strictly before each week start, per (symbol, week), with its time ``as_of``."""
    newest = feats.groupBy("symbol", following_week("ts").alias("week")).agg(
        *[F.max_by(c, "ts").alias(c) for c in columns], F.max("ts").alias("as_of"))
    return _fill_weeks(newest, [*columns, "as_of"])


def last_rows(feats: DataFrame, columns: Sequence[str], k: int = 12) -> DataFrame:
    """The last ``k`` rows before each week start, one output row each (symbol, week, ts, columns).

    Top-k per (symbol, week bucket) is limited before the shuffle; since every bucket holds at least
    one row, k buckets always hold the last k rows.
    """
    newest_first = Window.partitionBy("symbol", "week").orderBy(F.desc("ts"))
    top = (
        feats.select("symbol", following_week("ts").alias("week"), "ts", *columns)
        .withColumn("_rn", F.row_number().over(newest_first)).where(F.col("_rn") <= k).drop("_rn")
    )
    packed = top.groupBy("symbol", "week").agg(
        F.sort_array(F.collect_list(F.struct("ts", *columns))).alias("_rows"))
    recent = Window.partitionBy("symbol").orderBy("week").rowsBetween(-(k - 1), 0)
    joined = F.flatten(F.collect_list("_rows").over(recent))
    packed = packed.withColumn("_all", joined).withColumn(
        "_rows", F.slice("_all", F.greatest(F.size("_all") - k + 1, F.lit(1)), F.lit(k)))
    filled = _fill_weeks(packed.select("symbol", "week", "_rows"), ["_rows"])
    return filled.select("symbol", "week", F.explode("_rows").alias("_r")).select(
        "symbol", "week", *[F.col(f"_r.{c}").alias(c) for c in ["ts", *columns]])


def weekly_scores(rows: DataFrame, features: Sequence[str], score: Column) -> DataFrame:
    """Mean score of the complete rows of each (symbol, week)."""
    return (
        rows.na.drop(how="any", subset=list(features))
        .groupBy("symbol", "week").agg(F.avg(score).alias("pred"))
    )


def at_or_before(rows: DataFrame, moment, columns: Sequence[str]) -> DataFrame:
    """Newest row per symbol not later than ``moment``."""
    cut = moment if isinstance(moment, Column) else F.lit(moment).cast("timestamp_ntz")
    return rows.where(F.col("ts") <= cut).groupBy("symbol").agg(
        *[F.max_by(c, "ts").alias(c) for c in columns], F.max("ts").alias("as_of"))


def latest_prices(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))


def latest_valid(feats: DataFrame, column: str, out: str) -> DataFrame:
    """Newest non-null value per symbol."""
    return feats.where(F.col(column).isNotNull()).groupBy("symbol").agg(
        F.max_by(column, "ts").alias(out))


def sampled_times(rows: DataFrame, target: int = 500) -> DataFrame:
    """Every n-th distinct timestamp over all symbols, n chosen to leave about ``target``."""
    times = rows.where(F.col("ts").isNotNull()).select("ts").distinct()
    numbered = positions(times, ["ts"], F.date_trunc("week", "ts"))
    n_times = times.agg(F.count(F.lit(1))).scalar()
    step = F.greatest(F.lit(1), F.floor(n_times / target))
    return numbered.where(F.col("_i") % step == 0).select("ts")
