"""Feature families on hourly bars, with the check SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators.features import FAMILIES, build_features
from ..operators.targets import cache_targets
from ..sources.fixtures import HOURLY_SPEC, hourly_bars
from .sql import BARS_H, W, ema, lag, r, roll, roll_corr

FFD_THRESHOLD = 1e-2
H, D = HOURLY_SPEC.bars_per_hour, HOURLY_SPEC.bars_per_day
HALF = max(2, H // 2)


def _family(names: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = build_features(hourly_bars(spark, sf_dir), HOURLY_SPEC, names,
                            ffd_threshold=FFD_THRESHOLD, unbounded_ranges=True)
        return df.select("symbol", "ts", *[r6(n).alias(n) for n in names])
    return run


GROUPS: dict[str, list[str]] = {
    "features_returns": FAMILIES["returns"],
    "features_reversal": FAMILIES["reversal"],
    "features_volume": FAMILIES["volume"],
    "features_volatility": FAMILIES["volatility"],
    "features_technical": FAMILIES["technical"],
    "features_microstructure": FAMILIES["microstructure"],
    "features_structure": FAMILIES["structure"],
    "features_alphas": FAMILIES["alphas"],
    "features_regime": FAMILIES["regime"],
    "features_memory": FAMILIES["memory"],
    "features_pump_dump": FAMILIES["pump_dump"],
    "features_quantile_rank": FAMILIES["quantile_rank"],
}


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = hourly_bars(spark, sf_dir)
    names = ["future_ret", *HOURLY_SPEC.horizons]
    df = cache_targets(bars, HOURLY_SPEC)
    return df.select("symbol", "ts", *[r6(n).alias(n) for n in names])


QUERIES = {name: _family(names) for name, names in GROUPS.items()}
QUERIES["forward_targets"] = targets

# ---------------------------------------------------------------------------------------------
# Check SQL

_BASE = f"""{BARS_H},
b0 as (select *, row_number() over ({W}) - 1 as pos, {lag('close')} as c1, {lag('volume')} as v1,
  {lag('high')} as h1, {lag('low')} as l1,
  {lag('close', H)} as ch, {lag('close', 4 * H)} as c4h, {lag('close', D)} as cd,
  {lag('close', 2 * D)} as c2d, {lag('close', 3 * D)} as c3d, {lag('close', 5 * D)} as cw,
  {lag('volume', H)} as vh, {lag('volume', D)} as vd,
  (high + low + close) / 3 as tp, high - low as rng from bars_h),
b1 as (select *, ln(close / c1) as ret_1bar, ln(close / ch) as ret_1h, ln(close / c4h) as ret_4h,
  ln(close / cd) as ret_1d, ln(close / c2d) as ret_2d, ln(close / c3d) as ret_3d,
  ln(close / cw) as ret_1w, abs(ln(close / c1)) as alr,
  sign(ln(close / c1)) * volume as sv, ln(close / c1) * volume as rv,
  sign(ln(close / c1)) as sgn, close / ch - 1 as m1,
  greatest(rng, abs(high - c1), abs(low - c1)) as tr,
  case when c1 is not null then greatest(close - c1, 0) end as gain,
  case when c1 is not null then greatest(c1 - close, 0) end as loss,
  case when high - h1 > 0 and high - h1 > l1 - low then high - h1 else 0.0 end as dmp,
  case when l1 - low > 0 and l1 - low > high - h1 then l1 - low else 0.0 end as dmm
  from b0),
b2 as (select *, lag(ret_1bar) over ({W}) as lr1,
  {roll('stddev_samp', 'ret_1bar', H, HALF)} as rvol_1h,
  {roll('stddev_samp', 'ret_1bar', 4 * H, H)} as rvol_4h,
  {roll('stddev_samp', 'ret_1bar', D, H)} as rvol_1d,
  {roll('avg', 'volume', D, H)} as av, {roll('stddev_samp', 'volume', D, H)} as sdv,
  {roll('avg', 'volume', H, 2)} as avh
  from b1)"""


def _shifted(source: str, exprs: dict[str, str], ctes: str = "") -> str:
    inner = ", ".join(f"{e} as {n}" for n, e in exprs.items())
    outer = ", ".join(r(n, n) for n in exprs)
    moved = ", ".join(f"lag({n}) over ({W}) as {n}" for n in exprs)
    return (f"with recursive {_BASE}{ctes}, f as (select symbol, ts, {inner} from {source}), "
            f"s as (select symbol, ts, {moved} from f) select symbol, ts, {outer} from s")


_RSI = "1 - 1 / (1 + g{n} / nullif(l{n}, 0))"
_EMAS = ", e as materialized (" + ema("b1", {
    "g14": ("gain", 1 / 14), "l14": ("loss", 1 / 14), "g6": ("gain", 1 / 6),
    "l6": ("loss", 1 / 6), "e12": ("close", 2 / 13), "e26": ("close", 2 / 27),
    "atr": ("tr", 2 / 15), "pdm": ("dmp", 2 / 15), "mdm": ("dmm", 2 / 15),
}) + f"""), e1 as (select b2.*, e.* exclude (symbol, ts, pos),
  e12 - e26 as macd, 100 * pdm / nullif(atr, 0) as pdi, 100 * mdm / nullif(atr, 0) as mdi,
  {_RSI.format(n=14)} as r14, {_RSI.format(n=6)} as r6
  from b2 join e using (symbol, ts)),
e2 as materialized (select *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) as dx from e1),
e3 as materialized (""" + ema("e2", {"sig": ("macd", 0.2), "adx": ("dx", 2 / 15)}) + """),
x as (select e2.*, e3.sig, e3.adx from e2 join e3 using (symbol, ts))"""

_HL = "ln(high / low)"
_VWAP = f"({roll('sum', 'tp * volume', D, H)}) / nullif({roll('sum', 'volume', D, H)}, 0)"
_VZ = "(volume - av) / nullif(sdv, 0)"


def _rank_sql(x: str, name: str) -> str:
    return f"""{name} as (select a.symbol, a.ts, case when count(b.{x}) >= {D} and max(a.{x}) is not null
   then (count(case when b.{x} < a.{x} then 1 end)
     + (count(case when b.{x} = a.{x} then 1 end) + 1) / 2.0) / count(b.{x}) end as v
  from q a join q b on a.symbol = b.symbol and b.pos between a.pos - {5 * D - 1} and a.pos
  group by 1, 2)"""


_Q = ", q as materialized (select *, volume / nullif(av, 0) as vol_ratio, -ret_1h as rev_1h from b2), "

ORACLES = {
    "features_returns": _shifted("b2", {n: n for n in FAMILIES["returns"]}),
    "features_reversal": _shifted("x", {
        "rev_1h": "-ret_1h", "rev_4h": "-ret_4h", "rev_1d": "-ret_1d", "rev_2d": "-ret_2d",
        "mean_rev_zscore_1h": f"-(close - ({roll('avg', 'close', H, HALF)})) "
                              f"/ nullif({roll('stddev_samp', 'close', H, HALF)}, 0)",
        "mean_rev_zscore_4h": f"-(close - ({roll('avg', 'close', 4 * H, H)})) "
                              f"/ nullif({roll('stddev_samp', 'close', 4 * H, H)}, 0)",
        "overbought_rev": "case when r14 is not null then -2 * greatest(r14 - 0.5, 0) end",
        "oversold_rev": "case when r14 is not null then 2 * greatest(0.5 - r14, 0) end",
    }, _EMAS),
    "features_volume": _shifted("ob", {
        "vol_ratio": "volume / nullif(av, 0)",
        "vol_ret_1h": "ln(volume / vh)", "vol_ret_1d": "ln(volume / vd)",
        "obv_change": f"(obv - lag(obv, {H}) over ({W})) / (({roll('avg', 'abs(obv)', D, H)}) + 1e-8)",
        "vpt_change": f"vpt - lag(vpt, {H}) over ({W})",
        "vol_momentum": "avh / nullif(av, 0)",
    }, f""", ob as (select *, case when sv is not null then sum(sv) over ({W}) end as obv,
      case when rv is not null then sum(rv) over ({W}) end as vpt from b2)"""),
    "features_volatility": _shifted("x", {
        "rvol_1h": "rvol_1h", "rvol_4h": "rvol_4h", "rvol_1d": "rvol_1d",
        "vol_ratio_1h_1d": "rvol_1h / nullif(rvol_1d, 0)", "atr_norm": "atr / close",
        "parkinson_vol": roll("avg", f"sqrt({_HL} * {_HL} / (4 * ln(2)))", D, H),
        "garman_klass": roll(
            "avg", f"(0.5 * {_HL} * {_HL} - (2 * ln(2) - 1) * pow(ln(close / open), 2))", D, H),
    }, _EMAS),
    "features_technical": _shifted("t2", {
        "rsi_14": "r14", "rsi_6": "r6", "macd_hist": "(macd - sig) / close",
        "bb_pos": "case when sd20 > 0 then least(greatest((close - ma20 + 2 * sd20) / (4 * sd20), 0), 1) end",
        "bb_width": "4 * nullif(sd20, 0) / nullif(ma20, 0)",
        "stoch_k": "k", "stoch_d": roll("avg", "k", 3, 3),
        "cci_14": f"case when (tp - tp14) is not null and ({roll('avg', 'abs(tp - tp14)', 14, 7)}) > 0 then "
                  f"least(greatest((tp - tp14) / (0.015 * ({roll('avg', 'abs(tp - tp14)', 14, 7)})), -3), 3) / 3 end",
        "adx_14": "adx / 100", "dmi_diff": "(pdi - mdi) / 100",
    }, _EMAS + f""", t1 as (select *, {roll('avg', 'close', 20, 10)} as ma20,
      {roll('stddev_pop', 'close', 20, 10)} as sd20, {roll('min', 'low', 14, 7)} as lo14,
      {roll('max', 'high', 14, 7)} as hi14, {roll('avg', 'tp', 14, 7)} as tp14 from x),
     t2 as (select *, case when hi14 > lo14 then
      least(greatest((close - lo14) / (hi14 - lo14), 0), 1) end as k from t1)"""),
    "features_microstructure": _shifted("b2", {
        "vwap_dev": f"(close - {_VWAP}) / close",
        "amihud": roll("avg", "alr / volume", D, H),
        "kyle_lambda": roll("avg", "alr / (volume * close)", D, H),
        "spread_proxy": "rng / close", "body_ratio": "abs(close - open) / nullif(rng, 0)",
        "candle_dir": "cast(sign(close - open) as double)",
    }),
    "features_structure": _shifted("b2", {
        "wick_top": "(high - greatest(close, open)) / nullif(rng, 0)",
        "wick_bot": "(least(close, open) - low) / nullif(rng, 0)",
        "price_accel": f"m1 - lag(m1, {H}) over ({W})",
        "skew_1d": roll("skewness", "ret_1bar", D, max(4, H)),
        "kurt_1d": roll("kurtosis", "ret_1bar", D, max(4, H)),
        "max_ret_4h": roll("max", "ret_1bar", max(2, 4 * H), H),
    }),
    "features_alphas": _shifted("rk", {
        "wq_alpha001": "sign(ret_1d) * rvol_1d", "wq_alpha012": "sign(volume - v1) * -ret_1bar",
        "wq_alpha031": f"-({roll_corr('crank', 'volume', D, H)})",
        "wq_alpha098": "ret_1d / nullif(rvol_1d, 0)", "vol_adjusted_mom": "ret_4h / nullif(rvol_4h, 0)",
        "trend_consistency": roll("sum", "sgn", min(48, D // 2), max(2, H)),
    }, """, rk as (select *, rank() over (partition by symbol order by close)
      + (count(*) over (partition by symbol, close) - 1) / 2.0 as crank from b2)"""),
    "features_regime": _shifted("g", {
        "vol_regime": "vol_regime", "trend_strength": "adx / 100",
        "corr_btc_proxy": roll_corr("ret_1bar", "lr1", D, H),
        "hurst_exp": "rs", "fft_strength": "peak",
    }, _EMAS + _Q + _rank_sql("rvol_1d", "vr") + f""",
     seg as materialized (select a.symbol, a.ts, b.pos - (a.pos - {D}) as j, b.close,
        b.close - avg(b.close) over (partition by a.symbol, a.ts) as dev
       from q a join q b on a.symbol = b.symbol and b.pos between a.pos - {D} and a.pos - 1
       where a.pos >= {D}),
     walk as (select symbol, ts, close, sum(dev) over (partition by symbol, ts order by j) as cum from seg),
     rs as (select symbol, ts, (max(cum) - min(cum)) / nullif(stddev_pop(close), 0) as rs
       from walk group by 1, 2),
     ret as (select symbol, ts, j, ln((close + 1e-10) / (lag(close) over (partition by symbol, ts order by j) + 1e-10)) as x
       from seg),
     mag as (select symbol, ts, f, sqrt(pow(sum(x * cos(2 * pi() * f * (j - 1) / {D - 1})), 2)
        + pow(sum(x * sin(2 * pi() * f * (j - 1) / {D - 1})), 2)) as m
       from ret, (select unnest(range(1, {(D - 1) // 2 + 1})) as f) where x is not null group by 1, 2, 3),
     ft as (select symbol, ts, max(m) / (avg(m) + 1e-10) as peak from mag group by 1, 2),
     g as (select x.*, vr.v as vol_regime, rs.rs, ft.peak from x left join vr using (symbol, ts)
       left join rs using (symbol, ts) left join ft using (symbol, ts))"""),
    "features_memory": _shifted("fd", {"frac_diff_close": "v"}, f""",
     wts(k, w) as (select 0, cast(1.0 as double) union all
       select k + 1, w * (k - 0.4) / (k + 1) from wts where abs(w * (k - 0.4) / (k + 1)) >= {FFD_THRESHOLD}),
     fd as (select a.symbol, a.ts, case when count(b.close) = (select count(*) from wts)
        then sum(w * ln(b.close)) end as v
       from b0 a cross join wts left join b0 b on a.symbol = b.symbol and b.pos = a.pos - k
       group by 1, 2)"""),
    "features_pump_dump": _shifted("b2", {
        "pump_score": f"greatest(ret_1h, 0) / nullif(rvol_1d, 0) * greatest({_VZ}, 0)"
                      f" + 0 * ret_1h + 0 * ({_VZ})",
        "dump_score": f"greatest(-ret_1h, 0) / nullif(rvol_1d, 0) * greatest({_VZ}, 0)"
                      f" + 0 * ret_1h + 0 * ({_VZ})",
        "vol_spike_zscore": _VZ, "ret_vol_ratio_1h": "ret_1h / nullif(rvol_1h, 0)",
        "tail_risk_1h": f"({roll('max', 'alr', H, 2)}) / nullif(rvol_1d, 0)",
        "abnormal_range": f"rng / nullif({roll('avg', 'rng', D, H)}, 0)",
    }),
    "features_quantile_rank": _shifted("qr", {n: n for n in FAMILIES["quantile_rank"]},
        _Q + ", ".join(_rank_sql(x, f"k{i}") for i, x in enumerate(
            ["ret_1h", "rvol_1d", "rev_1h", "vol_ratio"])) + """,
     qr as (select q.*, k0.v as qrank_ret_1h, k1.v as qrank_rvol_1d, k2.v as qrank_rev_1h,
       k3.v as qrank_vol_ratio from q join k0 using (symbol, ts) join k1 using (symbol, ts)
       join k2 using (symbol, ts) join k3 using (symbol, ts))"""),
    "forward_targets": f"with {BARS_H} select symbol, ts, " + ", ".join(
        r(f"ln(lead(close, {k}) over ({W}) / close)", n)
        for n, k in {"future_ret": HOURLY_SPEC.four_hour_bars, **HOURLY_SPEC.horizons}.items()
    ) + " from bars_h",
}
