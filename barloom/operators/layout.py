"""Row layout for ordered windows: cut long series into chunks with a halo of earlier rows.

A window partitioned by symbol puts a whole symbol into one task. When one symbol may hold a third
of all bars that is the bottleneck, so a long series is cut by time into chunks of bounded size;
each chunk also receives the rows just before (and after) it that its windows read. Every window
of the package runs on ``Layout.keys`` and ``Layout.trim`` keeps the rows a chunk owns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK_ROWS = 100_000
# A chunk plan has one row per (symbol, time bucket); above this many it is joined by shuffle.
BROADCAST_ROWS = 500_000
_UNITS = (("week", 7.0), ("day", 1.0), ("hour", 1.0 / 24), ("minute", 1.0 / 1440))
# Rows for one task of a windowed plan: few while cores are idle, more once tasks are plenty.
SMALL_TASK, FULL_TASK = 5_000, 500_000
_PROBES = 256
_probed: WeakKeyDictionary[SparkSession, dict[tuple, Shape]] = WeakKeyDictionary()


class Shape(NamedTuple):
    """Rows of the longest series, densest rows per day, rows of all series."""

    longest: int
    per_day: float
    rows: int


@dataclass(frozen=True)
class Layout:
    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunked: bool

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def last_rows(self, n: int) -> WindowSpec:
        return self.window().rowsBetween(-(n - 1), Window.currentRow)

    def running(self, upto: int = 0) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, upto)

    def trim(self, df: DataFrame) -> DataFrame:
        """Keep each row once and drop the helper columns."""
        if self.chunked:
            df = df.where(F.col("_chunk") == F.col("_own"))
        return df.drop("_chunk", "_own", "_blk", "_pos")

    def with_df(self, df: DataFrame) -> "Layout":
        return Layout(df, self.keys, self.order, self.chunked)


def series_shape(bars: DataFrame, key: str = "symbol", ts: str = "ts") -> Shape:
    """Sizes that steer the physical layout: one aggregate over two columns.

    Results never depend on them, so they are remembered for each session and logical plan, the
    newest ones only.
    """
    probed = _probed.setdefault(bars.sparkSession, {})
    token = (bars.semanticHash(), key, ts)
    if token not in probed:
        days = F.greatest(F.datediff(F.max(ts), F.min(ts)) + 1, F.lit(1))
        row = (
            bars.groupBy(key)
            .agg(F.count(F.lit(1)).alias("n"), days.alias("d"))
            .agg(F.max("n"), F.max(F.col("n") / F.col("d")), F.sum("n"))
            .first()
        )
        if len(probed) >= _PROBES:
            del probed[next(iter(probed))]
        probed[token] = Shape(int(row[0] or 0), float(row[1] or 0.0), int(row[2] or 0))
    return probed[token]


def window_tasks(rows: int, cores: int) -> int:
    """Tasks for windowed work on ``rows`` rows.

    Windows cost far more time than bytes, so tasks sized by bytes would leave most cores idle on a
    small table: up to four tasks a core are made of small tasks, and beyond that full ones.
    """
    return max(1, min(math.ceil(rows / SMALL_TASK), 4 * cores), math.ceil(rows / FULL_TASK))


def _chunk_plan(
    bars: DataFrame, key: str, bucket: Column, lookback: int, lookahead: int, chunk_rows: int
) -> DataFrame:
    """(key, bucket) -> owning chunk and all chunks that read the bucket."""
    counts = bars.groupBy(key, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(key).orderBy("_bucket")
    end = F.sum("_n").over(run)
    biggest = F.max("_n").over(Window.partitionBy(key))
    placed = counts.withColumn("_end", end).withColumn("_big", biggest)
    start = F.col("_end") - F.col("_n")
    # Bucket rows sit at positions [start, end); chunk k owns the buckets starting in [kC, (k+1)C).
    first = F.floor((start - lookahead - F.col("_big")) / chunk_rows) if lookahead else None
    own = F.floor(start / chunk_rows)
    lo = F.greatest(F.least(first, own), F.lit(0)) if lookahead else own
    hi = F.greatest(F.floor((F.col("_end") - 1 + lookback) / chunk_rows), own)
    return placed.select(
        key, "_bucket", own.cast("int").alias("_own"),
        F.sequence(lo.cast("int"), hi.cast("int")).alias("_targets"),
    )


def lay_out(
    bars: DataFrame,
    lookback: int,
    lookahead: int = 0,
    key: str = "symbol",
    ts: str = "ts",
    chunk_rows: int = CHUNK_ROWS,
    shape: Shape | None = None,
) -> Layout:
    """Choose the window partitioning for windows reaching ``lookback`` rows back.

    Series that fit one chunk are dealt by ``key``. Longer ones are cut; the cut follows row counts
    per time bucket, so it is exact whatever the gaps in the series. Either way rows are shuffled
    once, into as many tasks as their number asks for, and every window runs on that shuffle.
    ``shape`` is that of the same rows, where the caller knows it.
    """
    longest, per_day, rows = shape or series_shape(bars, key, ts)
    tasks = window_tasks(rows, bars.sparkSession.sparkContext.defaultParallelism)
    if longest <= chunk_rows:
        return Layout(bars.repartition(tasks, key), (key,), (ts,), False)
    unit = next((u for u, d in _UNITS if per_day * d <= chunk_rows / 8), "minute")
    bucket = F.date_trunc(unit, F.col(ts))
    plan = _chunk_plan(bars, key, bucket, lookback, lookahead, chunk_rows)
    n_plan = bars.select(key, bucket.alias("_bucket")).distinct().count()
    if n_plan <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    cut = (
        bars.withColumn("_bucket", bucket)
        .join(plan, [key, "_bucket"])
        .withColumn("_chunk", F.explode("_targets"))
        .drop("_targets", "_bucket")
        .repartition(tasks, key, "_chunk")
    )
    return Layout(cut, (key, "_chunk"), (ts,), True)


def in_blocks(layout: Layout, block_rows: int) -> Layout:
    """Number the rows and add the block id used by the running-weight recurrences.

    Ordering by (block, ts) equals ordering by ts, and lets per-block and per-chunk windows share
    one sort.
    """
    ts = layout.order[-1]
    df = layout.df.withColumn("_pos", F.row_number().over(layout.window()) - 1)
    df = df.withColumn("_blk", F.floor(F.col("_pos") / block_rows).cast("int"))
    return Layout(df, layout.keys, ("_blk", ts), layout.chunked)


def chunk_offsets(layout: Layout, amount: str, key: str = "symbol") -> DataFrame | None:
    """Total of ``amount`` in all earlier chunks of the series, per chunk (None when uncut).

    Turns a running sum inside a chunk into the running sum of the whole series.
    """
    if not layout.chunked:
        return None
    per_chunk = (
        layout.df.where(F.col("_chunk") == F.col("_own"))
        .groupBy(*layout.keys)
        .agg(F.sum(amount).alias("_sum"))
    )
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return per_chunk.select(
        *layout.keys, F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_carry")
    )


def block_length(alpha: float) -> int:
    """Longest block whose weights (1 - alpha)^-n stay inside double range."""
    return max(16, min(1024, int(600 / -math.log1p(-alpha))))


def positions(
    rows: DataFrame, order: Sequence[str], bucket: str | Column, by: Sequence[str] = (),
    out: str = "_i",
) -> DataFrame:
    """0-based position of every row in ``order`` (per ``by``), cut over (by, bucket).

    ``bucket`` must grow with the order. Its counts are prefix-summed on a small table, so a sort
    never spans more than one bucket; join and window share one shuffle on (by, bucket).
    """
    by = list(by)
    placed = rows.withColumn("_bk", F.col(bucket) if isinstance(bucket, str) else bucket)
    counts = placed.groupBy(*by, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_bk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*by, "_bk").orderBy(*order)
    return placed.join(offsets, [*by, "_bk"]).withColumn(
        out, F.col("_off") + F.row_number().over(inside) - 1).drop("_off", "_bk")
