"""Information coefficients: weekly cross-sections, decay over horizons, filters and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import spearman, spearman_small
from ..functions.scalars import log_ratio
from ..session import stage
from .layout import CHUNK_ROWS, lay_out, positions
from .weekly import snapshots, week_of, weekly_returns


def melt(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(features), "feature", "value")


def weekly_feature_ic(feats: DataFrame, bars: DataFrame, features: Sequence[str],
                      min_symbols: int = 10, max_abs: float = 0.5) -> DataFrame:
    """(week, feature, n_obs, ic): last value before the week against the return of the week."""
    snap = snapshots(feats, features)
    joined = snap.join(weekly_returns(bars, max_abs), ["symbol", "week"])
    return spearman_small(
        melt(joined, ["week", "symbol", "ret"], features), "value", "ret", ["week", "feature"],
        min_symbols)


def in_week_ic(feats: DataFrame, features: Sequence[str], target: str, min_symbols: int = 5,
               min_rows: int = 3) -> DataFrame:
    """(week, feature, n_obs, ic) of per-symbol means of feature and target inside the week.

    Both means run over the rows where the two are present; symbols with fewer than ``min_rows``
    rows in the week are left out.
    """
    both = lambda f: F.col(f).isNotNull() & F.col(target).isNotNull()
    means = feats.groupBy(week_of("ts").alias("week"), "symbol").agg(
        F.count(F.lit(1)).alias("_n"), *[F.struct(
            F.lit(f).alias("feature"), F.avg(F.when(both(f), F.col(f))).alias("value"),
            F.avg(F.when(both(f), F.col(target))).alias("_y")).alias(f"_f{i}") for i, f in enumerate(features)])
    long = means.where(F.col("_n") >= min_rows).select(
        "week", "symbol", F.inline(F.array(*[F.col(f"_f{i}") for i in range(len(features))])))
    return spearman_small(long, "value", "_y", ["week", "feature"], min_symbols)


def model_ic(preds: DataFrame, rets: DataFrame, min_symbols: int = 10,
             dynamic: bool = False) -> DataFrame:
    """(week, n_obs, ic) of predictions against realised returns.

    ``dynamic`` lowers the minimum to half the common symbols, between 5 and 10.
    """
    both = preds.join(rets.select("symbol", "week", "ret"), ["symbol", "week"])
    ic = spearman_small(both, "pred", "ret", ["week"], 2 if dynamic else min_symbols)
    if not dynamic:
        return ic
    need = F.greatest(F.lit(5), F.least(F.lit(10), F.floor(F.col("n_obs") / 2)))
    return ic.withColumn("ic", F.when(F.col("n_obs") >= need, F.col("ic")).otherwise(0.0))


def pooled_ic(rows: DataFrame, features: Sequence[str], target: str, min_obs: int = 50) -> DataFrame:
    """(feature, n_obs, ic) over all rows, ranks distributed by value."""
    return spearman(melt(rows.select(target, *features), [target], features), "value", target,
                    ["feature"], min_obs)


def row_positions(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``_i``, the 0-based position of every row in the total order ``order``.

    Rows are counted per value of the first order column; the prefix sum runs over those counts
    (one per bar time) and the sort is confined to one value at a time.
    """
    return positions(rows, order, order[0])


def block_icir(rows: DataFrame, features: Sequence[str], target: str, order: Sequence[str],
               n_blocks: int = 10, min_block: int = 500, min_obs: int = 50) -> DataFrame:
    """(feature, icir): mean over deviation of the IC in contiguous row blocks; 0 when too short."""
    sized = row_positions(rows, order).withColumn(
        "_total", rows.agg(F.count(F.lit(1))).scalar())
    size = F.greatest(F.lit(min_block), F.floor(F.col("_total") / n_blocks))
    blocks = sized.withColumn("_block", F.floor(F.col("_i") / size)).withColumn("_size", size)
    blocks = blocks.where((F.col("_size") * 2 <= F.col("_total")) & (F.col("_block") < n_blocks))
    per_block = spearman(
        melt(blocks.select("_block", target, *features), ["_block", target], features),
        "value", target, ["_block", "feature"], min_obs)
    # Blocks without rows count as zero IC.
    mean = F.sum("ic") / n_blocks
    spread = F.sqrt(F.greatest(F.sum(F.col("ic") * F.col("ic")) / n_blocks - mean * mean, F.lit(0.0)))
    icir = per_block.groupBy("feature").agg(
        F.when(spread > 1e-10, mean / F.nullif(spread, F.lit(0.0))).otherwise(0.0).alias("icir"))
    names = rows.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(icir, "feature", "left").select(
        "feature", F.coalesce("icir", F.lit(0.0)).alias("icir"))


def rank_features(rows: DataFrame, features: Sequence[str], target: str, order: Sequence[str],
                  **kw) -> DataFrame:
    """(feature, ic, icir, abs_ic), strongest first."""
    ic = pooled_ic(rows, features, target).select("feature", "ic")
    return ic.join(block_icir(rows, features, target, order, **kw), "feature").withColumn(
        "abs_ic", F.abs("ic")).orderBy(F.desc("abs_ic"), "feature")


def filter_features(ics: DataFrame, threshold: float = 0.005, min_features: int = 20) -> DataFrame:
    """Add ``selected``: |ic| at the threshold or above, or the strongest ``min_features`` if fewer pass.

    ``ics`` has one row per feature, so the unpartitioned windows see tens of rows.
    """
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.desc(F.abs("ic")), "feature"))
    passing = F.sum((F.abs("ic") >= threshold).cast("int")).over(everything)
    return ics.withColumn("_place", place).withColumn("_passing", passing).select(
        *ics.columns,
        F.when(F.col("_passing") < min_features, F.col("_place") <= min_features)
        .otherwise(F.abs("ic") >= threshold).alias("selected"))


def select_recent(history: DataFrame, features: Sequence[str], last: int = 8, min_obs: int = 4,
                  min_features: int = 20) -> DataFrame:
    """Features whose mean IC over the newest ``last`` weeks is not negative (0 when few or no weeks).

    ``history`` is (week, feature, ic); falls back to the best ``min_features``.
    """
    newest = Window.partitionBy("feature").orderBy(F.desc("week"))
    recent = history.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= last)
    known = recent.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.when(F.count(F.lit(1)) >= min_obs, F.avg("ic")).otherwise(0.0).alias("mean_ic"))
    names = history.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    mean = names.join(known, "feature", "left").select(
        "feature", F.coalesce("n_obs", F.lit(0)).alias("n_obs"), F.coalesce("mean_ic", F.lit(0.0)).alias("mean_ic"))
    place = F.row_number().over(Window.orderBy(F.desc("mean_ic"), "feature"))
    passing = F.sum((F.col("mean_ic") >= 0).cast("int")).over(Window.partitionBy())
    return mean.withColumn("_place", place).withColumn("_passing", passing).select(
        "feature", "n_obs", "mean_ic",
        F.when(F.col("_passing") < min_features, F.col("_place") <= min_features)
        .otherwise(F.col("mean_ic") >= 0).alias("selected"))


def signal_decay(feats: DataFrame, features: Sequence[str], horizons: Sequence[int],
                 min_obs: int = 100, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(feature, horizon, ic_mean, n_symbols): mean per-symbol time-series IC per horizon."""
    layout = lay_out(feats, 0, max(horizons), chunk_rows=chunk_rows)
    w = layout.window()
    ahead = layout.df.withColumns({f"_c{h}": F.lead("close", h).over(w) for h in horizons})
    # Values, ranks of one side and of the other: three passes, so the returns are written once.
    ahead = stage(layout.trim(ahead).select(
        "symbol", *features, *[log_ratio(f"_c{h}", "close").alias(f"_r{h}") for h in horizons]))
    long = ahead.select("symbol", *features, F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"_r{h}").alias("fwd")) for h in horizons
    ])).alias("_h")).select("symbol", *features, "_h.horizon", "_h.fwd")
    ics = spearman(
        melt(long.where(F.col("fwd").isNotNull()), ["symbol", "horizon", "fwd"], features),
        "value", "fwd", ["feature", "horizon", "symbol"], min_obs)
    kept = F.when(F.col("n_obs") >= min_obs, F.col("ic"))
    return ics.groupBy("feature", "horizon").agg(
        F.coalesce(F.avg(kept), F.lit(0.0)).alias("ic_mean"), F.count(kept).alias("n_symbols"))


def best_horizon(decay: DataFrame) -> DataFrame:
    """One row: the horizon with the largest mean |ic| over features."""
    return decay.groupBy("horizon").agg(F.avg(F.abs("ic_mean")).alias("mean_abs_ic")).orderBy(
        F.desc("mean_abs_ic"), "horizon").limit(1)


def decay_warning(weekly: DataFrame, last: int = 4, threshold: float = 0.005) -> DataFrame:
    """Mean IC of the ``last`` weeks before each week, and whether it is near zero."""
    w = Window.orderBy("week")
    prior = w.rowsBetween(-last, -1)
    mean = F.when(F.count("ic").over(prior) >= last, F.avg("ic").over(prior))
    return weekly.select("week", mean.alias("recent_ic")).withColumn(
        "decayed", F.abs("recent_ic") < threshold)


def ic_gate(weekly: DataFrame, threshold: float = 0.0, last: int = 4) -> DataFrame:
    """Per week: is the mean live IC of the ``last`` weeks below the threshold (skip the week)?"""
    prior = Window.orderBy("week").rowsBetween(-last, -1)
    mean = F.when(F.count("ic").over(prior) >= last, F.avg("ic").over(prior))
    return weekly.select("week", mean.alias("gate_ic")).withColumn(
        "gated", F.coalesce(F.col("gate_ic") < threshold, F.lit(False)))


def feature_ic_gate(history: DataFrame, min_features: int = 4, threshold: float = 0.0) -> DataFrame:
    """One row: mean of each feature's newest IC, and whether it closes the gate."""
    newest = history.groupBy("feature").agg(F.max_by("ic", "week").alias("ic"))
    mean = F.when(F.count("ic") >= min_features, F.avg("ic"))
    return newest.agg(mean.alias("mean_latest_ic"), F.count("ic").alias("n_features")).withColumn(
        "gated", F.coalesce(F.col("mean_latest_ic") < threshold, F.lit(False)))
