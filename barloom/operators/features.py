"""The 72 windowed bar features.

One table in, one wide table out. Every feature reads bars up to and including its own and is then
moved down one bar, so a row never sees itself. Unrequested features cost nothing: their window
expressions are pruned by the optimizer, and the array kernels and the rank join are only planned
when one of their features is asked for.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import series
from ..functions.ranks import average_rank, with_rank
from ..functions.rolling import Roll, ema_block, with_ema, with_rolls
from ..functions.scalars import clip, finite, log_ratio, ratio
from ..session import favour_compiled_code
from ..spec import BarSpec
from .layout import CHUNK_ROWS, Layout, chunk_offsets, in_blocks, lay_out, series_shape

# Feature names by family, in table order.
FAMILIES = {
    "returns": ["ret_1bar", "ret_1h", "ret_4h", "ret_1d", "ret_2d", "ret_3d", "ret_1w"],
    "reversal": ["rev_1h", "rev_4h", "rev_1d", "rev_2d", "mean_rev_zscore_1h",
                 "mean_rev_zscore_4h", "overbought_rev", "oversold_rev"],
    "volume": ["vol_ratio", "vol_ret_1h", "vol_ret_1d", "obv_change", "vpt_change",
               "vol_momentum"],
    "volatility": ["rvol_1h", "rvol_4h", "rvol_1d", "vol_ratio_1h_1d", "atr_norm",
                   "parkinson_vol", "garman_klass"],
    "technical": ["rsi_14", "rsi_6", "macd_hist", "bb_pos", "bb_width", "stoch_k", "stoch_d",
                  "cci_14", "adx_14", "dmi_diff"],
    "microstructure": ["vwap_dev", "amihud", "kyle_lambda", "spread_proxy", "body_ratio",
                       "candle_dir"],
    "structure": ["wick_top", "wick_bot", "price_accel", "skew_1d", "kurt_1d", "max_ret_4h"],
    "alphas": ["wq_alpha001", "wq_alpha012", "wq_alpha031", "wq_alpha098", "vol_adjusted_mom",
               "trend_consistency"],
    "regime": ["vol_regime", "trend_strength", "corr_btc_proxy", "hurst_exp", "fft_strength"],
    "memory": ["frac_diff_close"],
    "pump_dump": ["pump_score", "dump_score", "vol_spike_zscore", "ret_vol_ratio_1h",
                  "tail_risk_1h", "abnormal_range"],
    "quantile_rank": ["qrank_ret_1h", "qrank_rvol_1d", "qrank_rev_1h", "qrank_vol_ratio"],
}
FEATURES: list[str] = [name for names in FAMILIES.values() for name in names]

EMA_FEATURES = {"overbought_rev", "oversold_rev", "rsi_14", "rsi_6", "macd_hist", "atr_norm",
                "adx_14", "dmi_diff", "trend_strength"}
KERNEL_FEATURES = {"vol_regime", "hurst_exp", "fft_strength", "frac_diff_close", "qrank_ret_1h",
                   "qrank_rvol_1d", "qrank_rev_1h", "qrank_vol_ratio"}
# Moving ranks: feature -> column it ranks.
RANKED = {"vol_regime": "rvol_1d", "qrank_ret_1h": "ret_1h", "qrank_rvol_1d": "rvol_1d",
          "qrank_rev_1h": "rev_1h", "qrank_vol_ratio": "vol_ratio"}
_PRICES = ["open", "high", "low", "close", "volume"]


def _lags(layout: Layout, spec: BarSpec) -> dict[str, Column]:
    bph, bpd = spec.bars_per_hour, spec.bars_per_day
    w = layout.window()
    steps = {"1": 1, "h": bph, "4h": 4 * bph, "d": bpd, "2d": 2 * bpd, "3d": 3 * bpd, "w": 5 * bpd}
    lagged = {f"_c_{k}": F.lag("close", n).over(w) for k, n in steps.items()}
    lagged |= {f"_v_{k}": F.lag("volume", steps[k]).over(w) for k in ("1", "h", "d")}
    return lagged | {"_h_1": F.lag("high", 1).over(w), "_l_1": F.lag("low", 1).over(w)}


def _unbounded_log_ratio(a: Column, b: Column) -> Column:
    """log(a / b) as IEEE division gives it: infinite over zero, NaN for zero over zero."""
    over_zero = F.when(a > 0, float("inf")).when(a == 0, float("nan"))
    return F.when(b == 0, over_zero).otherwise(log_ratio(a, b))


def _bar_terms(unbounded: bool = False) -> dict[str, Column]:
    """Per-bar quantities: plain arithmetic on a bar and its lags."""
    c, o, h, lo, v = (F.col(x) for x in ("close", "open", "high", "low", "volume"))
    lr = log_ratio(c, "_c_1")
    inside = _unbounded_log_ratio if unbounded else log_ratio
    hl = inside(h, lo)
    up, down = h - F.col("_h_1"), F.col("_l_1") - lo
    body_top, body_low = F.greatest(c, o), F.least(c, o)
    rng = h - lo
    return {
        "ret_1bar": lr,
        "ret_1h": log_ratio(c, "_c_h"), "ret_4h": log_ratio(c, "_c_4h"),
        "ret_1d": log_ratio(c, "_c_d"), "ret_2d": log_ratio(c, "_c_2d"),
        "ret_3d": log_ratio(c, "_c_3d"), "ret_1w": log_ratio(c, "_c_w"),
        "vol_ret_1h": log_ratio(v, "_v_h"), "vol_ret_1d": log_ratio(v, "_v_d"),
        "spread_proxy": ratio(rng, c),
        "body_ratio": ratio(F.abs(c - o), rng), "candle_dir": F.signum(c - o),
        "wick_top": ratio(h - body_top, rng), "wick_bot": ratio(body_low - lo, rng),
        "_tp": (h + lo + c) / 3, "_rng": rng,
        "_m1": ratio(c, "_c_h") - 1,
        "_pk": F.sqrt(hl * hl / (4 * math.log(2))),
        "_gk": 0.5 * hl * hl - (2 * math.log(2) - 1) * F.pow(inside(c, o), F.lit(2.0)),
        # greatest() skips NULLs: the first bar has only its own range.
        "_tr": F.greatest(rng, F.abs(h - F.col("_c_1")), F.abs(lo - F.col("_c_1"))),
        "_dmp": F.when((up > 0) & (up > down), up).otherwise(0.0),
        "_dmm": F.when((down > 0) & (down > up), down).otherwise(0.0),
        "_gain": clip(c - F.col("_c_1"), lo=0), "_loss": clip(F.col("_c_1") - c, lo=0),
    }


def _return_terms() -> dict[str, Column]:
    v, c = F.col("volume"), F.col("close")
    return {
        "rev_1h": -F.col("ret_1h"), "rev_4h": -F.col("ret_4h"),
        "rev_1d": -F.col("ret_1d"), "rev_2d": -F.col("ret_2d"),
        "_sgn": F.signum("ret_1bar"), "_abs": F.abs("ret_1bar"),
        "_sv": F.signum("ret_1bar") * v, "_rv": F.col("ret_1bar") * v,
        "_tpv": F.col("_tp") * v,
        "_ami": ratio(F.abs("ret_1bar"), v), "_kyle": ratio(F.abs("ret_1bar"), v * c),
    }


def _second_lags(layout: Layout, spec: BarSpec) -> dict[str, Column]:
    w, bph = layout.window(), spec.bars_per_hour
    return {
        "_m1_h": F.lag("_m1", bph).over(w),
        "_lr_1": F.lag("ret_1bar", 1).over(w),
        "_sv_at_h": F.lag("_sv", bph).over(w),
    }


def _signed_volume_level(layout: Layout) -> Layout:
    """Size of the running signed volume counted from the start of the whole series."""
    df = layout.df.withColumn(
        "_obv", F.when(F.col("_sv").isNotNull(), F.sum("_sv").over(layout.running())))
    offsets = chunk_offsets(layout, "_sv")
    level = F.col("_obv")
    if offsets is not None:
        # A chunk's running sum starts at its halo; the carry already counts those rows.
        halo = F.when(F.col("_chunk") != F.col("_own"), F.coalesce("_sv", F.lit(0.0)))
        df = df.withColumn("_halo", F.sum(halo).over(Window.partitionBy(*layout.keys)))
        df = df.join(offsets, list(layout.keys), "left")
        level = level + F.coalesce("_carry", F.lit(0.0)) - F.coalesce("_halo", F.lit(0.0))
    return layout.with_df(df.withColumn("_abs_obv", F.abs(level)).drop("_halo", "_carry", "_obv"))


def _rolls(spec: BarSpec) -> dict[str, Roll]:
    h, d = spec.bars_per_hour, spec.bars_per_day
    half = max(2, h // 2)
    lr = "ret_1bar"
    return {
        "_ma_1h": Roll("mean", "close", h, half), "_sd_1h": Roll("std", "close", h, half),
        "_ma_4h": Roll("mean", "close", 4 * h, h), "_sd_4h": Roll("std", "close", 4 * h, h),
        "_av": Roll("mean", "volume", d, h), "_sv_d": Roll("std", "volume", d, h),
        "_av_h": Roll("mean", "volume", h, 2),
        "_obv_abs": Roll("mean", "_abs_obv", d, h),
        "_obv_step": Roll("sum", "_sv", h, 1), "_vpt_step": Roll("sum", "_rv", h, 1),
        "rvol_1h": Roll("std", lr, h, half), "rvol_4h": Roll("std", lr, 4 * h, h),
        "rvol_1d": Roll("std", lr, d, h),
        "parkinson_vol": Roll("mean", "_pk", d, h), "garman_klass": Roll("mean", "_gk", d, h),
        "_ma20": Roll("mean", "close", 20, 10), "_sd20": Roll("std_pop", "close", 20, 10),
        "_lo14": Roll("min", "low", 14, 7), "_hi14": Roll("max", "high", 14, 7),
        "_tp14": Roll("mean", "_tp", 14, 7),
        "_tpv_d": Roll("sum", "_tpv", d, h), "_v_sum": Roll("sum", "volume", d, h),
        "amihud": Roll("mean", "_ami", d, h), "kyle_lambda": Roll("mean", "_kyle", d, h),
        "skew_1d": Roll("skew", lr, d, max(4, h)), "kurt_1d": Roll("kurt", lr, d, max(4, h)),
        "max_ret_4h": Roll("max", lr, max(2, 4 * h), h),
        "trend_consistency": Roll("sum", "_sgn", min(48, d // 2), max(2, h)),
        "corr_btc_proxy": Roll("corr", lr, d, h, "_lr_1"),
        "_max_abs": Roll("max", "_abs", h, 2), "_rng_d": Roll("mean", "_rng", d, h),
        "_pv": Roll("corr", "_rank", d, h, "volume"),
    }


def _roll_terms() -> dict[str, Column]:
    c, v = F.col("close"), F.col("volume")
    d1 = F.col("rvol_1d")
    vz = ratio(v - F.col("_av"), "_sv_d")
    tp_dev = F.abs(F.col("_tp") - F.col("_tp14"))
    k = clip(ratio(c - F.col("_lo14"), F.col("_hi14") - F.col("_lo14")), 0, 1)
    band = 4 * F.col("_sd20")
    both_ends = F.col("_sv").isNotNull() & F.col("_sv_at_h").isNotNull()
    return {
        "mean_rev_zscore_1h": -ratio(c - F.col("_ma_1h"), "_sd_1h"),
        "mean_rev_zscore_4h": -ratio(c - F.col("_ma_4h"), "_sd_4h"),
        "vol_ratio": ratio(v, "_av"),
        "obv_change": F.when(both_ends, F.col("_obv_step") / (F.col("_obv_abs") + 1e-8)),
        "vpt_change": F.when(both_ends, F.col("_vpt_step")),
        "vol_momentum": ratio("_av_h", "_av"),
        "vol_ratio_1h_1d": ratio("rvol_1h", d1),
        "bb_pos": clip(ratio(c - F.col("_ma20") + 2 * F.col("_sd20"), band), 0, 1),
        "bb_width": ratio(F.when(band != 0, band), "_ma20"),
        "stoch_k": k, "_tp_dev": tp_dev,
        "vwap_dev": ratio(c - ratio("_tpv_d", "_v_sum"), c),
        "price_accel": F.col("_m1") - F.col("_m1_h"),
        "wq_alpha001": F.signum("ret_1d") * d1,
        "wq_alpha012": F.signum(v - F.col("_v_1")) * -F.col("ret_1bar"),
        "wq_alpha098": ratio("ret_1d", d1),
        "vol_adjusted_mom": ratio("ret_4h", "rvol_4h"),
        "vol_spike_zscore": vz,
        "pump_score": ratio(clip("ret_1h", lo=0), d1) * clip(vz, lo=0),
        "dump_score": ratio(clip(-F.col("ret_1h"), lo=0), d1) * clip(vz, lo=0),
        "ret_vol_ratio_1h": ratio("ret_1h", "rvol_1h"),
        "tail_risk_1h": ratio("_max_abs", d1),
        "abnormal_range": ratio("_rng", "_rng_d"),
        "wq_alpha031": -F.col("_pv"),
    }


_SECOND_ROLLS = {
    "stoch_d": Roll("mean", "stoch_k", 3, 3), "_tp_mad": Roll("mean", "_tp_dev", 14, 7),
}


def _second_roll_terms() -> dict[str, Column]:
    cci = clip(ratio(F.col("_tp") - F.col("_tp14"), 0.015 * F.col("_tp_mad")), -3, 3) / 3
    return {"cci_14": cci}


_EMA_BASE = {
    "_g14": ("_gain", 1 / 14), "_l14": ("_loss", 1 / 14),
    "_g6": ("_gain", 1 / 6), "_l6": ("_loss", 1 / 6),
    "_e12": ("close", 2 / 13), "_e26": ("close", 2 / 27),
    "_atr": ("_tr", 2 / 15), "_pdm": ("_dmp", 2 / 15), "_mdm": ("_dmm", 2 / 15),
}
_EMA_CHAINED = {"_sig": ("_macd", 2 / 10), "_adx": ("_dx", 2 / 15)}
_EMA_BLOCK = ema_block([a for _, a in (*_EMA_BASE.values(), *_EMA_CHAINED.values())])


def _ema_terms() -> dict[str, Column]:
    rsi = lambda g, l: 1 - 1 / (1 + ratio(g, l))  # noqa: E731, E741
    pdi, mdi = 100 * ratio("_pdm", "_atr"), 100 * ratio("_mdm", "_atr")
    r14 = rsi("_g14", "_l14")
    return {
        "rsi_14": r14, "rsi_6": rsi("_g6", "_l6"),
        "overbought_rev": -2 * clip(r14 - 0.5, lo=0), "oversold_rev": 2 * clip(0.5 - r14, lo=0),
        "_macd": F.col("_e12") - F.col("_e26"),
        "atr_norm": ratio("_atr", "close"),
        "_dx": 100 * ratio(F.abs(pdi - mdi), pdi + mdi),
        "dmi_diff": (pdi - mdi) / 100,
    }


def _chained_ema_terms() -> dict[str, Column]:
    return {
        "macd_hist": ratio(F.col("_macd") - F.col("_sig"), "close"),
        "adx_14": F.col("_adx") / 100,
        "trend_strength": F.col("_adx") / 100,
    }


def _reads(made: Column | Roll | tuple) -> set[str]:
    """Names a stage entry refers to."""
    if isinstance(made, Roll):
        return {made.x, made.y} if made.y else {made.x}
    if isinstance(made, tuple):
        return {made[0]}
    return set(re.findall(r"\w+", str(made)))


def _needed(stages: list[tuple[str, dict]], wanted: set[str]) -> list[tuple[str, dict]]:
    """Stages reduced to what the wanted features reach, found back to front."""
    out, need = [], set(wanted)
    for kind, made in reversed(stages):
        kept = {name: expr for name, expr in made.items() if name in need}
        for expr in kept.values():
            need |= _reads(expr)
        if kept:
            out.append((kind, kept))
    return out[::-1]


def _kernel_stage(
    layout: Layout, wanted: Sequence[str], spec: BarSpec, ffd_d: float, ffd_threshold: float,
) -> Layout:
    """Array kernels per chunk, on the partitioning the windows already have.

    Runs before the wide windows, so only bars and the ranked inputs pass through Python. The new
    columns come out moved down one bar, like every other feature.
    """
    d = spec.bars_per_day
    weights = series.fractional_weights(ffd_d, ffd_threshold)
    df = layout.df
    passed = [c for c in df.columns if not c.startswith("_in_")]
    schema = T.StructType(
        [df.schema[c] for c in passed] + [T.StructField(n, T.DoubleType()) for n in wanted]
    )

    def run(rows: pa.Table) -> pa.Table:
        at = rows["ts"].to_numpy()
        if (at[1:] < at[:-1]).any():
            rows = rows.take(pa.array(np.argsort(at, kind="stable")))
        close = rows["close"].to_numpy().astype(float)
        out = rows.select(passed)
        for name in wanted:
            if name in RANKED:
                value = series.moving_rank(rows[f"_in_{RANKED[name]}"].to_numpy().astype(float), 5 * d, d)
            elif name == "hurst_exp":
                value = series.rescaled_range(close, d)
            elif name == "fft_strength":
                value = series.spectral_peak(close, min(d, 288))
            else:
                logs = np.log(np.clip(close, 1e-10, None))
                value = series.fractional_difference(logs, weights)
            shifted = np.full(len(close), np.nan)
            shifted[1:] = value[:-1]
            out = out.append_column(name, pa.array(shifted))
        return out

    made = df.groupBy(*layout.keys).applyInArrow(run, schema)
    made = made.withColumns({n: finite(n) for n in wanted})
    return Layout(made, layout.keys, ("ts",), layout.chunked)


def feature_lookback(spec: BarSpec, wanted: Sequence[str], ffd_d: float, ffd_threshold: float) -> int:
    """Rows of history a chunk needs so that its own rows come out exact."""
    back = spec.feature_lookback
    if "frac_diff_close" in wanted:
        back = max(back, len(series.fractional_weights(ffd_d, ffd_threshold)) + 1)
    if EMA_FEATURES & set(wanted):
        back = max(back, 600)
    return back


def build_features(
    bars: DataFrame,
    spec: BarSpec = BarSpec(),
    features: Sequence[str] | None = None,
    keep: Sequence[str] = ("close",),
    ffd_d: float = 0.4,
    ffd_threshold: float = 1e-5,
    chunk_rows: int = CHUNK_ROWS,
    block_rows: int | None = None,
    unbounded_ranges: bool = False,
) -> DataFrame:
    """Features of bars(symbol, ts, open, high, low, close, volume), one row per bar.

    A bar with a low or open of zero is missing from ``parkinson_vol`` and ``garman_klass``; with
    ``unbounded_ranges`` it makes the windows that hold it infinite (or NaN).
    ``keep`` columns are passed through unshifted. ``wq_alpha031`` ranks the close over the whole
    series and so looks ahead; every other feature depends on earlier bars only.
    """
    wanted = list(dict.fromkeys(features or FEATURES))
    unknown = [f for f in wanted if f not in FEATURES]
    if unknown:
        raise ValueError(f"unknown features: {unknown}")
    favour_compiled_code(bars.sparkSession)
    bars = bars.select(
        "symbol", "ts", *[c for c in keep if c not in _PRICES],
        *[finite(F.col(p).cast("double")).alias(p) for p in _PRICES],
    )
    shape = series_shape(bars)
    ranked = "wq_alpha031" in wanted
    if ranked and shape.longest > chunk_rows:
        bars, ranked = with_rank(bars, "close", ["symbol"], "_rank"), False
    layout = lay_out(
        bars, feature_lookback(spec, wanted, ffd_d, ffd_threshold), chunk_rows=chunk_rows, shape=shape)
    if ranked:
        # Whole series share a task here: ranking them takes a sort and no shuffle.
        layout = layout.with_df(layout.df.withColumn(
            "_rank", F.when(F.col("close").isNotNull(), average_rank(F.col("close").asc_nulls_last(), ["symbol"]))))
    kernels = [f for f in wanted if f in KERNEL_FEATURES]
    plain = [f for f in wanted if f not in KERNEL_FEATURES]

    if kernels:
        base = layout.df.columns
        inputs = sorted({RANKED[k] for k in kernels if k in RANKED})
        fed = _run_stages(layout, spec, set(inputs))
        fed = fed.with_df(fed.df.select(*base, *[F.col(c).alias(f"_in_{c}") for c in inputs]))
        layout = _kernel_stage(fed, kernels, spec, ffd_d, ffd_threshold)
    if EMA_FEATURES & set(plain):
        # Blocks first: every later window then shares the (block, ts) order.
        layout = in_blocks(layout, block_rows or _EMA_BLOCK)
    layout = _run_stages(layout, spec, set(plain), unbounded_ranges)
    w = layout.window()
    helpers = [c for c in ("_chunk", "_own") if layout.chunked]
    df = layout.df.select(
        "symbol", "ts", *keep, *helpers, *kernels,
        *[F.lag(f, 1).over(w).alias(f) for f in plain])
    return layout.trim(df).select("symbol", "ts", *keep, *wanted)


def _run_stages(layout: Layout, spec: BarSpec, wanted: set[str], unbounded: bool = False) -> Layout:
    """Add the wanted columns (not yet moved down) and whatever they are built from."""
    stages = [
        ("columns", _lags(layout, spec)), ("columns", _bar_terms(unbounded)), ("columns", _return_terms()),
        ("columns", _second_lags(layout, spec)), ("level", {"_abs_obv": F.col("_sv")}),
        ("rolls", _rolls(spec)), ("columns", _roll_terms()),
        ("rolls", _SECOND_ROLLS), ("columns", _second_roll_terms()),
        ("ema", _EMA_BASE), ("columns", _ema_terms()),
        ("ema", _EMA_CHAINED), ("columns", _chained_ema_terms()),
    ]
    for kind, made in _needed(stages, wanted):
        if kind == "columns":
            layout = layout.with_df(layout.df.withColumns(made))
        elif kind == "rolls":
            layout = with_rolls(layout, made)
        elif kind == "ema":
            layout = with_ema(layout, made)
        else:
            layout = _signed_volume_level(layout)
    return layout
