"""Market regimes and the pump-and-dump detector."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import Roll, with_rolls
from ..functions.scalars import clip, log_ratio, ratio
from ..spec import BarSpec
from .layout import CHUNK_ROWS, lay_out
from .weekly import at_or_before, snapshots

BULL, BEAR, HIGH_VOL, LOW_VOL = "BULL_TREND", "BEAR_TREND", "HIGH_VOL_LATERAL", "LOW_VOL_GRIND"
KILL_SWITCH, IC_GATED = "KILL_SWITCH", "IC_GATED"


def classify(ret: Column, recent_vol: Column, base_vol: Column, trend: float = 0.03,
             vol_factor: float = 1.3) -> Column:
    high = F.coalesce(recent_vol > base_vol * vol_factor, F.lit(False))
    return (
        F.when((ret > trend) & ~high, BULL).when(ret < -trend, BEAR)
        .when(high, HIGH_VOL).otherwise(LOW_VOL)
    )


def regime_by_week(proxy: DataFrame, spec: BarSpec = BarSpec(), min_vol_obs: int = 100,
                   chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(week, regime) as of each week start, from the last four days of the proxy's bars.

    The statistics are trailing windows of the bars; the newest value before the week is taken, so
    all weeks cost one pass.
    """
    d = spec.bars_per_day
    back = 4 * d
    layout = lay_out(proxy, max(back, min_vol_obs) + 2, chunk_rows=chunk_rows)
    w = layout.window()
    layout = layout.with_df(layout.df.withColumn(
        "_lr", log_ratio("close", F.lag("close", 1).over(w))))
    layout = with_rolls(layout, {
        "_base": Roll("std", "_lr", back - 1, 2), "_recent": Roll("std", "_lr", d, 2),
    })
    # Rows a bar has behind it, as far as the rules ask.
    seen = lambda n: F.lag(F.lit(1), n - 1).over(w).isNotNull()
    start = F.coalesce(F.lag("close", back - 1).over(w), F.first("close").over(layout.running()))
    marks = layout.df.select(
        *layout.df.columns, start.alias("_start"), seen(d).alias("_day"),
        seen(d + 2).alias("_beyond_day"), seen(min_vol_obs + 2).alias("_enough"))
    base = F.when(F.col("_enough"), F.col("_base")).otherwise(0.02)
    recent = F.when(F.col("_beyond_day"), F.col("_recent")).otherwise(base)
    label = F.when(
        F.col("_day"), classify(log_ratio("close", "_start"), recent, base)).otherwise(LOW_VOL)
    rows = layout.trim(marks.withColumn("regime", label)).select("symbol", "ts", "regime")
    return snapshots(rows, ["regime"]).select("week", "regime")


def regime_from_features(feats: DataFrame, spec: BarSpec = BarSpec(),
                         chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(week, regime) from rvol_1d and ret_1w where the proxy has no close."""
    d = spec.bars_per_day
    back = 4 * d
    layout = with_rolls(lay_out(feats, back, chunk_rows=chunk_rows), {
        "_base": Roll("mean", "rvol_1d", back, 1), "_recent": Roll("mean", "rvol_1d", d, 1),
        "_long": Roll("mean", "rvol_1d", back, d + 1),
    })
    w = layout.window()
    recent = F.when(F.col("_long").isNotNull(), F.col("_recent")).otherwise(F.col("_base"))
    ret = F.last("ret_1w", ignorenulls=True).over(layout.last_rows(back))
    df = layout.df.withColumn("_ret", F.coalesce(ret, F.lit(0.0))).withColumn(
        "_day", F.lag(F.lit(1), d - 1).over(w).isNotNull())
    label = F.when(F.col("_day"), classify(F.col("_ret"), recent, F.col("_base"))).otherwise(LOW_VOL)
    rows = layout.trim(df.withColumn("regime", label)).select("symbol", "ts", "regime")
    return snapshots(rows, ["regime"]).select("week", "regime")


@dataclass(frozen=True)
class PumpConfig:
    """Detector settings; the defaults are fixed values for 5-minute bars."""

    vol_window: int = 288
    ret_window: int = 288
    hour_bars: int = 12
    warmup: int = 288
    ret_z: float = 3.0
    vol_z: float = 2.5
    range_z: float = 2.5
    reversal_window: int = 12
    reversal_share: float = 0.6
    w_price: float = 0.3
    w_volume: float = 0.25
    w_range: float = 0.2
    w_reversal: float = 0.25


def pump_scores(bars: DataFrame, cfg: PumpConfig = PumpConfig(), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per bar: three z-scores, reversal flag, composite score, pump and dump flags."""
    back = cfg.hour_bars + max(cfg.vol_window, cfg.ret_window, cfg.warmup) + cfg.reversal_window + 2
    layout = lay_out(bars, back, chunk_rows=chunk_rows)
    w = layout.window()
    layout = layout.with_df(layout.df.withColumns({
        "_ret": log_ratio("close", F.lag("close", cfg.hour_bars).over(w)),
        "_rng": F.col("high") - F.col("low"),
        "_warm": F.lag(F.lit(1), cfg.warmup).over(w).isNull(),
    }))
    layout = layout.with_df(layout.df.withColumn("_ret_1", F.lag("_ret", 1).over(w)))
    rv, rr = cfg.vol_window, cfg.ret_window
    layout = with_rolls(layout, {
        "_rm": Roll("mean", "_ret", rr, rr // 2), "_rs": Roll("std", "_ret", rr, rr // 2),
        "_vm": Roll("mean", "volume", rv, rv // 2), "_vs": Roll("std", "volume", rv, rv // 2),
        "_gm": Roll("mean", "_rng", rv, rv // 2), "_gs": Roll("std", "_rng", rv, rv // 2),
        "_hi": Roll("max", "_ret_1", cfg.reversal_window, 1),
        "_lo": Roll("min", "_ret_1", cfg.reversal_window, 1),
    })
    ret = F.col("_ret")
    down = (F.col("_hi") > 0) & (ret < -F.col("_hi") * cfg.reversal_share)
    up = (F.col("_lo") < 0) & (ret > -F.col("_lo") * cfg.reversal_share)
    df = layout.df.withColumns({
        "price_spike_z": ratio(ret - F.col("_rm"), "_rs"),
        "volume_spike_z": ratio(F.col("volume") - F.col("_vm"), "_vs"),
        "range_spike_z": ratio(F.col("_rng") - F.col("_gm"), "_gs"),
        "reversal_score": F.coalesce(down | up, F.lit(False)).cast("double"),
    })
    pull = lambda z, at: 1 / (1 + F.exp((at - F.abs(z)) * 2))
    score = (
        cfg.w_price * pull("price_spike_z", cfg.ret_z)
        + cfg.w_volume * pull("volume_spike_z", cfg.vol_z)
        + cfg.w_range * pull("range_spike_z", cfg.range_z)
        + cfg.w_reversal * F.col("reversal_score")
    )
    df = df.withColumn(
        "pump_dump_score", F.when(F.col("_warm"), 0.0).otherwise(clip(score, 0, 1)))
    hot = (F.col("volume_spike_z") > cfg.vol_z * 0.5) & (F.col("pump_dump_score") > 0.5)
    no = F.lit(False)
    df = df.withColumns({
        "is_pump": F.coalesce((F.col("price_spike_z") > cfg.ret_z) & hot, no),
        "is_dump": F.coalesce((F.col("price_spike_z") < -cfg.ret_z) & hot, no),
    })
    return layout.trim(df).select(
        "symbol", "ts", "price_spike_z", "volume_spike_z", "range_spike_z", "reversal_score",
        "pump_dump_score", "is_pump", "is_dump")


def pump_regime(scores: DataFrame, window: int = 12, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Label each bar by flags in the last ``window`` and 3x ``window`` bars."""
    layout = lay_out(scores, 3 * window, chunk_rows=chunk_rows)
    seen = lambda flag, n: F.max(F.col(flag).cast("int")).over(layout.last_rows(n)) > 0
    df = layout.df.withColumns({
        "_pump": seen("is_pump", window), "_dump": seen("is_dump", window),
        "_pump3": seen("is_pump", 3 * window), "_dump3": seen("is_dump", 3 * window),
    })
    label = (
        F.when(F.col("_dump"), "DUMP_ACTIVE").when(F.col("_pump"), "PUMP_ACTIVE")
        .when(F.col("_pump3") & F.col("_dump3"), "POST_PUMP_DUMP").otherwise("NORMAL")
    )
    return layout.trim(df.withColumn("pump_regime", label)).select(*scores.columns, "pump_regime")


def symbols_to_avoid(scores: DataFrame, moment, threshold: float = 0.6) -> DataFrame:
    """Symbols whose newest bar at ``moment`` scores above the threshold or is flagged."""
    now = at_or_before(scores, moment, ["pump_dump_score", "is_pump", "is_dump"])
    bad = F.coalesce(F.col("pump_dump_score") > threshold, F.lit(False))
    return now.where(bad | F.col("is_pump") | F.col("is_dump")).select("symbol")


def pump_summary(scores: DataFrame) -> DataFrame:
    share = lambda t: F.avg(F.coalesce((F.col("pump_dump_score") > t).cast("double"), F.lit(0.0))) * 100
    return scores.groupBy("symbol").agg(
        F.count_if("is_pump").alias("n_pumps"), F.count_if("is_dump").alias("n_dumps"),
        F.avg("pump_dump_score").alias("mean_score"), F.max("pump_dump_score").alias("max_score"),
        share(0.5).alias("pct_above_05"), share(0.7).alias("pct_above_07"))
