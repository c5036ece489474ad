"""Average ranks and rank correlation, in a bounded-group and a distributed form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalars import ratio

# Buckets per factor of two in the order-preserving bucketing of doubles.
BUCKETS_PER_OCTAVE = 1024
_ZERO_SHIFT = 1100 * BUCKETS_PER_OCTAVE


def average_rank(x: str | Column, by: Sequence[str]) -> Column:
    """Average-tie rank inside a group known to be small (a weekly cross-section).

    One sort serves both functions: the first position of a tie is rank(), its last
    position is the RANGE-framed running count.
    """
    w = Window.partitionBy(*by).orderBy(x)
    first = F.rank().over(w)
    last = F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return (first + last) / 2.0


def value_bucket(x: str) -> Column:
    """Order-preserving integer bucket of a double: fine enough to cut one group over many tasks."""
    c = F.col(x)
    size = F.floor(F.log2(F.abs(c)) * BUCKETS_PER_OCTAVE) + F.lit(_ZERO_SHIFT)
    # Among negatives a larger magnitude sorts first.
    return F.when(c > 0, size).when(c < 0, -size - 1).otherwise(F.lit(0)).cast("long")


def rank_table(df: DataFrame, x: str, by: Sequence[str] = (), out: str = "rank",
               counts: bool = False) -> DataFrame:
    """Average-tie rank of every distinct value of ``x`` (per ``by``), without one task per group.

    With ``counts``, also ``_lo`` (rows below the value) and ``_n`` (rows at it).

    Ties are folded by a map-side aggregate; each (group, value bucket) then counts on its own and
    adds the total of the buckets before it, so a group holding most of the rows is cut up by value.
    """
    by = list(by)
    freq = (
        df.where(F.col(x).isNotNull())
        .groupBy(*by, x)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", value_bucket(x))
    )
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        freq.groupBy(*by, "_b")
        .agg(F.sum("_n").alias("_bn"))
        .select(*by, "_b", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"))
    )
    inside = (
        Window.partitionBy(*by, "_b").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    )
    below = F.col("_off") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    placed = freq.join(offsets, [*by, "_b"]).withColumn("_lo", below)
    extra = ["_lo", "_n"] if counts else []
    return placed.select(*by, x, (F.col("_lo") + (F.col("_n") + 1) / 2.0).alias(out), *extra)


def quantiles(df: DataFrame, x: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per ``by``, an array ``q`` in ``probs`` order.

    Reads the order statistics off the distributed rank table; nothing gathers a whole column.
    """
    by = list(by)
    table = rank_table(df, x, by, counts=True)
    total = (
        df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_total"))
    )
    wanted = total.select(*by, "_total", F.posexplode(F.array(*[F.lit(p) for p in probs])).alias(
        "_k", "_p")).withColumn("_h", (F.col("_total") - 1) * F.col("_p"))
    at = [F.floor("_h"), F.ceil("_h")]
    spot = lambda i: (F.col("_lo") <= i) & (i < F.col("_lo") + F.col("_n"))
    if by:
        hits = table.join(wanted, by).where(spot(at[0]) | spot(at[1]))
    else:
        # One row per probability.
        hits = table.join(F.broadcast(wanted), spot(at[0]) | spot(at[1]))
    low = F.max(F.when(spot(at[0]), F.col(x)))
    high = F.max(F.when(spot(at[1]), F.col(x)))
    value = low + (high - low) * F.max(F.col("_h") - F.floor("_h"))
    per = hits.groupBy(*by, "_k").agg(value.alias("_v"))
    packed = F.sort_array(F.collect_list(F.struct("_k", "_v")))
    return per.groupBy(*by).agg(F.transform(packed, lambda s: s["_v"]).alias("q"))


def with_rank(df: DataFrame, x: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Attach the distributed average rank of ``x``; rows with NULL get NULL.

    The join runs on (group, value): a value that fills many rows is split by the adaptive
    skew join, since the rank side holds each value once.
    """
    return df.join(rank_table(df, x, by, out), [*by, x], "left")


def spearman_small(
    df: DataFrame, x: str, y: str, by: Sequence[str], min_obs: int, out: str = "ic",
    keep_short: bool = True,
) -> DataFrame:
    """Rank correlation per group for groups of cross-section size.

    Pairs with a NULL on either side are left out. Groups with fewer than ``min_obs`` pairs, or
    with a constant side, give 0.
    """
    by = list(by)
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = pairs.select(
        *by, average_rank(x, by).alias("_rx"), average_rank(y, by).alias("_ry")
    )
    ic = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_obs"), _rank_corr("_rx", "_ry").alias("_c")
    )
    if not keep_short:
        ic = ic.where(F.col("n_obs") >= min_obs)
    value = F.when((F.col("n_obs") >= min_obs), F.coalesce("_c", F.lit(0.0))).otherwise(0.0)
    return ic.select(*by, "n_obs", value.alias(out))


def spearman(
    df: DataFrame, x: str, y: str, by: Sequence[str] = (), min_obs: int = 50, out: str = "ic",
) -> DataFrame:
    """Rank correlation per group for groups of any size (both ranks distributed)."""
    by = list(by)
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = with_rank(with_rank(pairs, x, by, "_rx"), y, by, "_ry")
    ic = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_obs"), plain_corr("_rx", "_ry").alias("_c")
    )
    value = F.when(F.col("n_obs") >= min_obs, F.coalesce("_c", F.lit(0.0))).otherwise(0.0)
    return ic.select(*by, "n_obs", value.alias(out))


def _rank_corr(a: str, b: str) -> Column:
    """Pearson correlation of average ranks 1 to n; NULL for a constant side.

    Doubled ranks are whole numbers with the mean n + 1, so the sums are exact (up to some 100,000
    ranks): the value does not depend on the order of the rows, and no correlation is exactly 0.
    """
    n = F.count(F.lit(1)).cast("double")
    moment = lambda x, y: F.sum(4 * F.col(x) * F.col(y)) - n * (n + 1) * (n + 1)
    return ratio(moment(a, b), F.sqrt(moment(a, a) * moment(b, b)))


def plain_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation over pairs free of NULL; NULL (corr() would raise) for a constant side."""
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
