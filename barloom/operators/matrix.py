"""Training matrices: windowing, subsampling, exact-size sampling and target transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import plain_corr, quantiles, with_rank
from ..functions.scalars import clip
from ..session import stage
from .layout import positions
from .resample import week_of
from .universe import complete_rows, enough_history, in_range, training_window

SORTED_ROWS = 10_000


def hash_text(seed: int, columns: Sequence[str]) -> Column:
    """Seeded digest of a row's key; the same in any engine that has MD5."""
    parts = []
    for c in columns:
        parts.append(F.when(F.col(c).isNotNull(), F.col(c).cast("string")).otherwise(F.lit("")))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def row_key(df: DataFrame) -> DataFrame:
    """Add ``_key``, the text that identifies a bar row: symbol and epoch microseconds."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")).cast("string")
    return df.withColumn("_key", F.concat_ws("|", F.col("symbol"), micros))


def hash_fraction(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def thin(rows: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th row of each symbol in time order, starting with its first."""
    placed = positions(rows, ["ts"], week_of("ts"), ["symbol"])
    return placed.where(F.col("_i") % step == 0).drop("_i")


def exact_sample(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all if fewer), chosen by smallest seeded digest.

    Counts per digest cell find the cell that holds the n-th row. A crowded cell is cut into finer
    ones by three more digits, so that what is sorted in the end stays small whatever ``n`` is.
    """
    keyed = row_key(rows).withColumn("_hash", hash_text(seed, ["_key"]))
    left, prefix, size = n, "", None
    while size is None or size > SORTED_ROWS and len(prefix) < 30:
        inside = keyed.where(F.col("_hash").startswith(prefix)) if prefix else keyed
        cells = inside.groupBy(F.substring("_hash", 1, len(prefix) + 3).alias("_cell")).count().collect()  # <= 4096
        for cell, count in sorted((r["_cell"], r["count"]) for r in cells):
            if count > left:
                prefix, size = cell, count
                break
            left -= count
        else:
            return rows
    whole = keyed.where((F.col("_hash") < prefix) & ~F.col("_hash").startswith(prefix))
    part = keyed.where(F.col("_hash").startswith(prefix)).orderBy("_hash", "_key").limit(left)
    return whole.unionByName(part).drop("_key", "_hash")


def bernoulli_sample(rows: DataFrame, fraction: float | Column, seed: int = 42) -> DataFrame:
    """Independent row sample by seeded digest; repeatable, no state."""
    share = hash_fraction(hash_text(seed, ["_key"]))
    return row_key(rows).where(share < fraction).drop("_key")


def demean_by_day(rows: DataFrame, target: str, out: str) -> DataFrame:
    """Subtract the UTC-day mean where the day has more than one row."""
    day = F.to_date("ts")
    means = rows.groupBy(day.alias("_day")).agg(
        F.avg(target).alias("_mean"), F.count(F.lit(1)).alias("_n"))
    shift = F.when(F.col("_n") > 1, F.col("_mean")).otherwise(0.0)
    return rows.withColumn("_day", day).join(means, "_day").withColumn(
        out, F.col(target) - shift).drop("_day", "_mean", "_n")


def winsorise(rows: DataFrame, column: str, pct: float = 1.0) -> DataFrame:
    """Clip at the exact pct and 100 - pct percentiles."""
    edges = quantiles(rows, column, [pct / 100, 1 - pct / 100]).scalar()
    return rows.withColumn(column, clip(column, edges[0], edges[1]))


def rank_normalise(rows: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """2 * average rank / (n + 1) - 1 over all rows."""
    out = out or column
    n = rows.agg(F.count(column)).scalar()
    ranked = with_rank(rows, column, (), "_rank")
    return ranked.withColumn(out, 2.0 * F.col("_rank") / (n + 1) - 1.0).drop("_rank")


def rolling_matrix(
    feats: DataFrame, features: Sequence[str], target: str, end, weeks: int = 104,
    embargo_minutes: int = 60, horizon_bars: int = 12, bar_minutes: int = 5, step: int = 12, min_rows: int = 62,
    max_rows: int | None = 2_000_000, beta_neutral: bool = True, winsor_pct: float | None = 1.0,
    seed: int = 42,
) -> DataFrame:
    """(symbol, ts, features, y_raw, y_neutral) of the last ``weeks`` before ``end``.

    The embargo is at least the target's horizon, so no target reaches beyond ``end``. ``max_rows``
    bounds the rows a model is fitted on. Each transform reads its predecessor's rows several times,
    so every one is written once.
    """
    embargo = max(embargo_minutes, horizon_bars * bar_minutes)
    window = training_window(feats.select("symbol", "ts", *features, target), end, weeks, embargo)
    rows = stage(thin(complete_rows(enough_history(window, min_rows), [*features, target]), step))
    if max_rows:
        rows = stage(exact_sample(rows, max_rows, seed))
    rows = rows.withColumn("y_raw", F.col(target).cast("double"))
    rows = stage(demean_by_day(rows, "y_raw", "y_neutral") if beta_neutral else rows.withColumn(
        "y_neutral", F.col("y_raw")))
    if winsor_pct:
        rows = stage(winsorise(rows, "y_neutral", winsor_pct))
    return rank_normalise(rows, "y_neutral").select(
        "symbol", "ts", *features, "y_raw", "y_neutral")


def expanding_matrix(
    feats: DataFrame, features: Sequence[str], target: str, start, end, step: int = 12,
    min_rows: int = 62, max_rows: int = 2_000_000, seed: int = 42,
) -> DataFrame:
    """(symbol, ts, features, y) of everything in [start, end), pre-sampled down to ``max_rows``."""
    window = in_range(feats.select("symbol", "ts", *features, target), start, end)
    rows = stage(thin(complete_rows(enough_history(window, min_rows), [*features, target]), step))
    total = rows.count()
    if total > max_rows:
        rows = bernoulli_sample(rows, max_rows / total, seed)
    return rows.withColumnRenamed(target, "y")


def feature_pairs(features: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]


def correlation_pairs(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, r) for a before b: every pair in one aggregate pass."""
    pairs = feature_pairs(features)
    made = rows.agg(*[plain_corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return made.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"p{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ])))


def collinear_pairs(rows: DataFrame, features: Sequence[str], limit: float = 0.8) -> DataFrame:
    return correlation_pairs(rows, features).where(F.abs("r") > limit).orderBy(F.desc(F.abs("r")))
