"""Regimes, detector, training matrices and statistical validation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import matrix, regime, validation
from ..operators.features import build_features
from ..operators.layout import positions
from ..operators.targets import forward_returns
from ..operators.universe import market_proxy
from ..operators.weekly import snapshots, weekly_returns
from ..session import stage
from ..sources.fixtures import DAILY_SPEC, daily_bars, hourly_bars
from .sql import BARS_D, BARS_H, W, lag, r, roll, spearman_cte
from .weekly_queries import (
    FEAT_D, FEATS, MATRIX_H, SNAP, WEEKLY_RET, _MATRIX_NAMES, _complete_matrix, _hourly_matrix,
    daily_features, melt_sql, predictions,
)

H, D = DAILY_SPEC.bars_per_hour, DAILY_SPEC.bars_per_day
MIN_VOL_OBS = 15
PUMP = regime.PumpConfig(vol_window=24, ret_window=24, hour_bars=4, warmup=24, ret_z=1.2, vol_z=1.0,
                         range_z=1.0, reversal_window=4)
TRAIN_END = dt.datetime(1999, 1, 4)


def _proxy(spark, sf):
    return market_proxy(daily_bars(spark, sf), ("L5",))


def regime_weekly(spark, sf):
    return regime.regime_by_week(_proxy(spark, sf), DAILY_SPEC, MIN_VOL_OBS)


def regime_fallback(spark, sf):
    feats = build_features(_proxy(spark, sf), DAILY_SPEC, ["rvol_1d", "ret_1w"])
    return regime.regime_from_features(feats, DAILY_SPEC)


def _scores(spark, sf):
    return regime.pump_scores(hourly_bars(spark, sf), PUMP)


_Z = ["price_spike_z", "volume_spike_z", "range_spike_z", "reversal_score", "pump_dump_score"]


def pump_scores(spark, sf):
    return _scores(spark, sf).select("symbol", "ts", *[r6(c).alias(c) for c in _Z], "is_pump", "is_dump")


def pump_regime(spark, sf):
    return regime.pump_regime(_scores(spark, sf), 12).select("symbol", "ts", "pump_regime")


def pump_summary(spark, sf):
    out = regime.pump_summary(_scores(spark, sf))
    return out.select("symbol", "n_pumps", "n_dumps", *[
        r6(c).alias(c) for c in ("mean_score", "max_score", "pct_above_05", "pct_above_07")])


def pump_avoid(spark, sf):
    at = F.to_timestamp_ntz(F.lit("2024-01-20 12:30:00"))
    return regime.symbols_to_avoid(_scores(spark, sf), at, 0.3)


def thinned_rows(spark, sf):
    _, rows = _complete_matrix(spark, sf)
    return matrix.thin(rows, 12).select("symbol", "ts", r6("ret_1h").alias("ret_1h"))


def exact_sample(spark, sf):
    _, rows = _complete_matrix(spark, sf)
    return matrix.exact_sample(rows, 1000, 7).select("symbol", "ts", r6("ret_1h").alias("ret_1h"))


def bernoulli_sample(spark, sf):
    _, rows = _complete_matrix(spark, sf)
    return matrix.bernoulli_sample(rows, 0.25, 7).select("symbol", "ts", r6("ret_1h").alias("ret_1h"))


def beta_neutral(spark, sf):
    _, rows = _complete_matrix(spark, sf)
    return matrix.demean_by_day(rows, "future_ret_1h", "y").select("symbol", "ts", r6("y").alias("y"))


def winsorised(spark, sf):
    _, rows = _complete_matrix(spark, sf)
    return matrix.winsorise(rows, "future_ret_1h", 5.0).select(
        "symbol", "ts", r6("future_ret_1h").alias("y"))


def rank_normalised(spark, sf):
    _, rows = _complete_matrix(spark, sf)
    return matrix.rank_normalise(rows, "future_ret_1h").select(
        "symbol", "ts", r6("future_ret_1h").alias("y"))


def _daily_matrix_rows(spark, sf):
    bars, feats = daily_features(spark, sf)
    return forward_returns(feats, {"future_ret": H})


def training_matrix(spark, sf, max_rows: int | None = 1500):
    out = matrix.rolling_matrix(_daily_matrix_rows(spark, sf), FEATS, "future_ret", TRAIN_END, 104,
                                60, step=5, min_rows=55, max_rows=max_rows, seed=7)
    return out.select("symbol", "ts", *[r6(c).alias(c) for c in [*FEATS, "y_raw", "y_neutral"]])


def training_matrix_all(spark, sf):
    """All rows of the window; the check SQL of ``matrix_rolling`` samples 1,500 of them."""
    return training_matrix(spark, sf, None)


def training_matrix_expanding(spark, sf):
    out = matrix.expanding_matrix(_daily_matrix_rows(spark, sf), FEATS, "future_ret",
                                  dt.datetime(1995, 1, 2), TRAIN_END, step=5, min_rows=55,
                                  max_rows=2_000_000)
    return out.select("symbol", "ts", *[r6(c).alias(c) for c in [*FEATS, "y"]])


def collinear_pairs(spark, sf):
    names, rows = _complete_matrix(spark, sf)
    return matrix.collinear_pairs(rows, names, 0.05).select("feature_a", "feature_b", r6("r").alias("r"))


FM = ["rev_1d", "vol_ratio"]


def fama_macbeth(spark, sf):
    rows = stage(_daily_matrix_rows(spark, sf))
    return validation.fama_macbeth(rows, FM, "future_ret", 10).select(
        "feature", *[r6(c).alias(c) for c in ("coef_mean", "coef_std", "t_stat")], "n_periods")


def fama_macbeth_pvalues(spark, sf):
    rows = stage(_daily_matrix_rows(spark, sf))
    return validation.fama_macbeth(rows, FEATS, "future_ret", 10)


def false_discovery(spark, sf):
    """Share of above-average events per type and day as a p-value stand-in for the ranking rule."""
    tests = snapshots(daily_features(spark, sf)[1], ["vol_ratio"]).groupBy("symbol").agg(
        F.avg((F.col("vol_ratio") > 2.2).cast("double")).alias("p_value"))
    return validation.benjamini_hochberg(tests, 0.12, name="symbol").select(
        "symbol", r6("p_value").alias("p_value"), "bh_rank", r6("bh_threshold").alias("bh_threshold"),
        "significant")


def orthogonality(spark, sf):
    names, rows = _complete_matrix(spark, sf)
    return validation.spearman_pairs(rows, names).select(
        "feature_a", "feature_b", r6("r").alias("r"))


def redundant(spark, sf):
    names, rows = _complete_matrix(spark, sf)
    gone = validation.redundant_features(validation.spearman_pairs(rows, names), names, 0.1)
    return spark.createDataFrame([(n, n in gone) for n in names], "feature string, redundant boolean")


def stationarity(spark, sf):
    names, rows = _hourly_matrix(spark, sf)
    return validation.stationarity(rows, names).select(
        "feature", r6("mean_stat").alias("mean_stat"), r6("pct_stationary").alias("pct_stationary"), "n_series")


def full_validation(spark, sf):
    rows = stage(_daily_matrix_rows(spark, sf))
    return validation.full_validation(rows, FEATS, "future_ret", min_symbols=10)


def _importance(feats, lo, hi):
    part = feats.where((F.col("ts") >= lo) & (F.col("ts") < hi))
    sums = part.agg(*[F.avg(F.abs(c)).alias(c) for c in FEATS])
    return sums.unpivot([], FEATS, "feature", "importance")


def importance_drift(spark, sf):
    feats = stage(daily_features(spark, sf)[1])
    lit = lambda t: F.to_timestamp_ntz(F.lit(t))
    cur = _importance(feats, lit("1999-01-04"), lit("2002-01-01"))
    prev = _importance(feats, lit("1995-01-01"), lit("1999-01-04"))
    out = validation.importance_drift(cur, prev, 2)
    return out.select(r6("drift_rmse").alias("drift_rmse"), r6("rank_corr").alias("rank_corr"),
                      F.array_join("top_movers", ",").alias("top_movers"))


def _pred_halves(spark, sf):
    preds = stage(predictions(daily_features(spark, sf)[1]))
    cut = F.to_timestamp_ntz(F.lit("1999-01-04"))
    return preds.where(F.col("week") >= cut), preds.where(F.col("week") < cut)


def ks_shift(spark, sf):
    cur, prev = _pred_halves(spark, sf)
    return validation.ks_two_sample(cur, prev, "pred").select(
        r6("ks_stat").alias("ks_stat"), r6("p_value").alias("p_value"), "n_current", "n_previous")


def prediction_moments(spark, sf):
    cur, _ = _pred_halves(spark, sf)
    return validation.distribution_summary(cur, "pred").select(
        *[r6(c).alias(c) for c in ("mean", "std", "skew", "kurt")])


def governance(spark, sf):
    feats = stage(daily_features(spark, sf)[1])
    cut = F.to_timestamp_ntz(F.lit("1999-01-04"))
    lo, hi = (F.to_timestamp_ntz(F.lit(t)) for t in ("1990-01-01", "2010-01-01"))
    cur, prev = _pred_halves(spark, sf)
    out = validation.governance(0.09, 0.02, _importance(feats, cut, hi), _importance(feats, lo, cut),
                                cur, prev)
    numbers = ["ic_gap", "drift_rmse", "rank_corr", "pred_mean", "pred_std", "pred_skew", "pred_kurt",
               "ks_stat", "ks_p_value"]
    return out.select(*[r6(c).alias(c) for c in numbers], *[
        F.array_join(c, ",").alias(c) for c in ("top_movers", "warnings")])


def leak_test(spark, sf):
    names, rows = _complete_matrix(spark, sf)
    out = validation.leak_test(rows, names, "future_ret_1h", 4, max_shuffled=0.05)
    return out.select(r6("shuffled_mean_abs_ic").alias("shuffled_mean_abs_ic"),
                      r6("past_feature_ic").alias("past_feature_ic"),
                      (F.col("leaked_feature_ic") > 0.999).alias("pipeline_detects"),
                      "shuffled_test_pass", "leaked_test_pass")


def deflated_sharpe(spark, sf):
    w = weekly_returns(daily_bars(spark, sf))
    runs = w.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("ret") / F.stddev_pop("ret")).alias("sharpe"),
        F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt"))
    out = validation.deflated_sharpe(runs, "sharpe", "n", "skew", "kurt", 2)
    return out.select("symbol", "n", *[r6(c).alias(c) for c in (
        "sharpe", "expected_max_sharpe", "deflated_sharpe", "p_value")], "significant")


def _matrix_query(kind):
    def run(spark, sf):
        w = weekly_returns(daily_bars(spark, sf))
        names = [f"L{i}" for i in range(20)]
        return validation.return_matrix(w, names, kind, 5).select("a", "b", "n", r6("value").alias("value"))
    return run


def fold_bounds_positions(spark, sf):
    """Row positions in time order, the index every purged fold is cut from."""
    _, rows = _complete_matrix(spark, sf)
    return positions(rows, ["symbol"], "ts").select("symbol", "ts", F.col("_i").cast("long").alias("i"))


QUERIES = {
    "regime_weekly": regime_weekly,
    "regime_fallback": regime_fallback,
    "pump_scores": pump_scores,
    "pump_regime": pump_regime,
    "pump_summary": pump_summary,
    "pump_avoid": pump_avoid,
    "matrix_thinned": thinned_rows,
    "matrix_exact_sample": exact_sample,
    "matrix_bernoulli_sample": bernoulli_sample,
    "matrix_beta_neutral": beta_neutral,
    "matrix_winsorised": winsorised,
    "matrix_rank_normalised": rank_normalised,
    "matrix_rolling": training_matrix,
    "matrix_rolling_all": training_matrix_all,
    "matrix_expanding": training_matrix_expanding,
    "matrix_collinear_pairs": collinear_pairs,
    "matrix_row_positions": fold_bounds_positions,
    "fama_macbeth": fama_macbeth,
    "fama_macbeth_pvalues": fama_macbeth_pvalues,
    "false_discovery": false_discovery,
    "orthogonality_pairs": orthogonality,
    "redundant_features": redundant,
    "stationarity": stationarity,
    "validation_summary": full_validation,
    "importance_drift": importance_drift,
    "prediction_shift_ks": ks_shift,
    "prediction_moments": prediction_moments,
    "governance_report": governance,
    "leak_test": leak_test,
    "deflated_sharpe": deflated_sharpe,
    "return_covariance": _matrix_query("cov"),
    "return_correlation": _matrix_query("corr"),
}

# --- check SQL -------------------------------------------------------------------------------

def _unit(seed: int) -> str:
    """Seeded digest of a row as a number in [0, 1)."""
    return (f"(cast(concat('0x', substr(md5(concat('{seed}|', symbol, '|', cast(epoch_us(ts) as varchar))), 1, 8)) as bigint)"
            " / 4294967296.0)")


_LABEL = ("case when ret > 0.03 and not coalesce(rv > bv * 1.3, false) then 'BULL_TREND' "
          "when ret < -0.03 then 'BEAR_TREND' when coalesce(rv > bv * 1.3, false) then 'HIGH_VOL_LATERAL' "
          "else 'LOW_VOL_GRIND' end")
_B = 4 * D
_WEEK_L5 = """wk as (select unnest(generate_series(
    (select date_trunc('week', min(ts))::timestamp + interval 7 day from p),
    (select date_trunc('week', max(ts))::timestamp from p), interval 7 day)) as week)"""
_REGIME = f"""with {BARS_D},
 p as (select *, row_number() over (order by ts) as pos, ln(close / lag(close) over (order by ts)) as lr
   from bars_d where symbol = 'L5'),
 {_WEEK_L5},
 lk as (select wk.week, p.*, row_number() over (partition by week order by ts desc) as back
   from wk join p on p.ts < wk.week),
 lb as (select *, case when row_number() over (partition by week order by ts) > 1 then lr end as lr2
   from lk where back <= {_B}),
 st as (select week, count(*) as n, count(lr2) as n_lr, ln(max_by(close, ts) / min_by(close, ts)) as ret,
    stddev_samp(lr2) as sd_all, stddev_samp(case when back <= {D} then lr2 end) as sd_day from lb group by 1),
 v as (select week, n, ret, case when n_lr > {MIN_VOL_OBS} then sd_all else 0.02 end as bv,
    case when n_lr > {D} then sd_day else case when n_lr > {MIN_VOL_OBS} then sd_all else 0.02 end end as rv from st)
 select week, case when n < {D} then 'LOW_VOL_GRIND' else {_LABEL} end as regime from v"""
_REGIME_F = f"""with {FEAT_D}, p as (select * from feat_d where symbol = 'L5'), {_WEEK_L5},
 lk as (select wk.week, p.*, row_number() over (partition by week order by ts desc) as back
   from wk join p on p.ts < wk.week),
 st as (select week, count(*) as n, avg(case when back <= {_B} then rvol_1d end) as bv,
    count(case when back <= {_B} then rvol_1d end) as nv, avg(case when back <= {D} then rvol_1d end) as dv,
    coalesce(max_by(ret_1w, ts) filter (where ret_1w is not null and back <= {_B}), 0) as ret from lk group by 1),
 v as (select week, n, bv, case when nv > {D} then dv else bv end as rv, ret from st)
 select week, case when n < {D} then 'LOW_VOL_GRIND' else {_LABEL} end as regime from v"""

P = PUMP
_PUMP = f"""with {BARS_H},
 p0 as (select *, high - low as rng, ln(close / {lag('close', P.hour_bars)}) as ret,
   row_number() over ({W}) as rn from bars_h),
 p1 as (select *, lag(ret) over ({W}) as ret1 from p0),
 p2 as (select *, (ret - ({roll('avg', 'ret', 24, 12)})) / nullif({roll('stddev_samp', 'ret', 24, 12)}, 0) as pz,
   (volume - ({roll('avg', 'volume', 24, 12)})) / nullif({roll('stddev_samp', 'volume', 24, 12)}, 0) as vz,
   (rng - ({roll('avg', 'rng', 24, 12)})) / nullif({roll('stddev_samp', 'rng', 24, 12)}, 0) as gz,
   {roll('max', 'ret1', 4, 1)} as hi, {roll('min', 'ret1', 4, 1)} as lo from p1),
 p3 as (select *, case when coalesce((hi > 0 and ret < -hi * 0.6) or (lo < 0 and ret > -lo * 0.6), false)
   then 1.0::double else 0.0::double end as rev from p2),
 p4 as (select *, case when rn <= 24 then 0 else 0.3 / (1 + exp((1.2 - abs(pz)) * 2))
   + 0.25 / (1 + exp((1.0 - abs(vz)) * 2)) + 0.2 / (1 + exp((1.0 - abs(gz)) * 2)) + 0.25 * rev end as score from p3),
 ps as materialized (select *, coalesce(pz > 1.2 and vz > 0.5 and score > 0.5, false) as is_pump,
   coalesce(pz < -1.2 and vz > 0.5 and score > 0.5, false) as is_dump from p4)"""


def _flag(name: str, n: int) -> str:
    return f"bool_or({name}) over ({W} rows between {n - 1} preceding and current row)"


_KEY7 = "md5(concat('7|', symbol, '|', cast(epoch_us(ts) as varchar)))"
_MC = f"with {MATRIX_H}"
_DM = f"""{FEAT_D}, dm as (select *, ln(lead(close, {H}) over ({W}) / close) as y from feat_d)"""
_FULL = " and ".join(f"{c} is not null" for c in [*FEATS, "y"])


def _thin_sql(cond: str) -> str:
    return f"""win as (select * from dm where {cond}),
 ok as (select symbol from win group by 1 having count(*) >= 55),
 th as (select * from (select *, row_number() over ({W}) - 1 as i from win
   where symbol in (select symbol from ok) and {_FULL}) where i % 5 = 0)"""


def _quantile(q: float, x: str, t: str) -> str:
    return f"(select quantile_cont({x}, {q}) from {t})"


_FMS = f"""with {_DM},
 x as (select ts, rev_1d as a, vol_ratio as b, y from dm where rev_1d is not null and vol_ratio is not null and y is not null),
 g as (select ts, var_pop(a) as aa, var_pop(b) as bb, covar_pop(a, b) as ab, covar_pop(a, y) as ay,
   covar_pop(b, y) as yb from x group by 1 having count(*) >= 10),
 be as (select ts, 'rev_1d' as feature, sqrt(aa) * (ay * bb - yb * ab) / (aa * bb - ab * ab) as beta from g
   union all select ts, 'vol_ratio', sqrt(bb) * (yb * aa - ay * ab) / (aa * bb - ab * ab) from g),
 dmn as (select feature, ts, beta - avg(beta) over (partition by feature) as d, beta,
   row_number() over (partition by feature order by ts) as k, count(*) over (partition by feature) as n,
   floor(pow(count(*) over (partition by feature), 1/3::double)) as lags from be),
 gam as (select a.feature, a.k - b.k as l, any_value(a.n) as n, any_value(a.lags) as lags,
   sum(a.d * b.d) / any_value(a.n) as gamma from dmn a join dmn b on a.feature = b.feature
   and a.k - b.k between 0 and a.lags group by 1, 2),
 nw as (select feature, any_value(n) as n, sqrt(sum(case when l = 0 then gamma
   else 2 * (1 - l / (lags + 1)) * gamma end) / any_value(n)) as se from gam group by 1),
 ag as (select feature, avg(beta) as m, stddev_pop(beta) as s from be group by 1)"""

_PREDS_STAGE = f"with {FEAT_D}, "
from .weekly_queries import LASTK  # noqa: E402

_HALVES = f"""with {FEAT_D}, {LASTK},
 h as (select pred as x, week >= timestamp '1999-01-04' as cur from preds)"""


def _imp(name: str, cond: str) -> str:
    return f"{name} as (" + " union all ".join(
        f"select '{c}' as feature, avg(abs({c})) as v from feat_d where {cond}" for c in FEATS) + ")"


_PAIRS = [(a, b) for i, a in enumerate(_MATRIX_NAMES) for b in _MATRIX_NAMES[i + 1:]]


def _ranked(source: str) -> str:
    return "rk as (select " + ", ".join(
        f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}"
        for c in _MATRIX_NAMES) + f" from {source})"


def _pairs_sql(source: str) -> str:
    return " union all ".join(
        f"select '{a}' as feature_a, '{b}' as feature_b, corr({a}, {b}) as r from {source}" for a, b in _PAIRS)


def _redundant_sql() -> str:
    ctes, seen = [], []
    for i, f in enumerate(_MATRIX_NAMES):
        conds = [f"(abs((select r from pr where feature_a = '{a}' and feature_b = '{f}')) > 0.1 "
                 f"and not (select d from k{j}))" for j, a in enumerate(_MATRIX_NAMES[:i])]
        ctes.append(f"k{i} as (select '{f}' as feature, {' or '.join(conds) or 'false'} as d)")
        seen.append(f"select feature, d as redundant from k{i}")
    return (f"{_MC}, {_ranked('mc')}, pr as ({_pairs_sql('rk')}), " + ", ".join(ctes)
            + " " + " union all ".join(seen))


_PHI = "(0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * ser)"

ORACLES = {
    "regime_weekly": _REGIME,
    "regime_fallback": _REGIME_F,
    "pump_scores": f"""{_PUMP} select symbol, ts, {r('pz', 'price_spike_z')}, {r('vz', 'volume_spike_z')},
      {r('gz', 'range_spike_z')}, {r('rev', 'reversal_score')}, {r('score', 'pump_dump_score')}, is_pump, is_dump from ps""",
    "pump_regime": f"""{_PUMP}, f as (select symbol, ts, {_flag('is_pump', 12)} as p, {_flag('is_dump', 12)} as d,
      {_flag('is_pump', 36)} as p3, {_flag('is_dump', 36)} as d3 from ps)
      select symbol, ts, case when d then 'DUMP_ACTIVE' when p then 'PUMP_ACTIVE'
       when p3 and d3 then 'POST_PUMP_DUMP' else 'NORMAL' end as pump_regime from f""",
    "pump_summary": f"""{_PUMP} select symbol, count(*) filter (where is_pump) as n_pumps,
      count(*) filter (where is_dump) as n_dumps, {r('avg(score)', 'mean_score')}, {r('max(score)', 'max_score')},
      {r('avg(case when score > 0.5 then 1.0 else 0.0 end) * 100', 'pct_above_05')},
      {r('avg(case when score > 0.7 then 1.0 else 0.0 end) * 100', 'pct_above_07')} from ps group by 1""",
    "pump_avoid": f"""{_PUMP}, n as (select * from ps where ts <= timestamp '2024-01-20 12:30:00'
      qualify row_number() over (partition by symbol order by ts desc) = 1)
      select symbol from n where coalesce(score > 0.3, false) or is_pump or is_dump""",
    "matrix_thinned": f"""{_MC} select symbol, ts, {r('ret_1h', 'ret_1h')} from
      (select *, row_number() over ({W}) - 1 as i from mc) where i % 12 = 0""",
    "matrix_exact_sample": f"""{_MC} select symbol, ts, {r('ret_1h', 'ret_1h')} from
      (select * from mc order by {_KEY7} limit 1000)""",
    "matrix_bernoulli_sample": f"""{_MC} select symbol, ts, {r('ret_1h', 'ret_1h')} from mc
      where cast(concat('0x', substr({_KEY7}, 1, 8)) as bigint) / 4294967296.0 < 0.25""",
    "matrix_beta_neutral": f"""{_MC} select symbol, ts, {r('''future_ret_1h - case when
      count(*) over (partition by ts::date) > 1 then avg(future_ret_1h) over (partition by ts::date) else 0 end''', 'y')} from mc""",
    "matrix_winsorised": f"""{_MC} select symbol, ts, {r(f'''least(greatest(future_ret_1h,
      {_quantile(0.05, 'future_ret_1h', 'mc')}), {_quantile(0.95, 'future_ret_1h', 'mc')})''', 'y')} from mc""",
    "matrix_rank_normalised": f"""{_MC}, k as (select *, rank() over (order by future_ret_1h)
      + (count(*) over (partition by future_ret_1h) - 1) / 2.0 as rk, count(*) over () as n from mc)
      select symbol, ts, {r('2.0 * rk / (n + 1) - 1', 'y')} from k""",
    "matrix_rolling": f"""with {_DM}, {_thin_sql("ts >= timestamp '1999-01-04' - interval 728 day and ts < timestamp '1999-01-04' - interval 60 minute")},
      sm as (select * from th order by {_KEY7} limit 1500),
      dn as (select *, y - case when count(*) over (partition by ts::date) > 1
        then avg(y) over (partition by ts::date) else 0 end as yn from sm),
      wi as (select *, least(greatest(yn, {_quantile(0.01, 'yn', 'dn')}), {_quantile(0.99, 'yn', 'dn')}) as yw from dn),
      k as (select *, rank() over (order by yw) + (count(*) over (partition by yw) - 1) / 2.0 as rk,
        count(*) over () as n from wi)
      select symbol, ts, {", ".join(r(c, c) for c in FEATS)}, {r('y', 'y_raw')},
        {r('2.0 * rk / (n + 1) - 1', 'y_neutral')} from k""",
    "matrix_expanding": f"""with {_DM}, {_thin_sql("ts >= timestamp '1995-01-02' and ts < timestamp '1999-01-04'")}
      select symbol, ts, {", ".join(r(c, c) for c in FEATS)}, {r('y', 'y')} from th""",
    "matrix_collinear_pairs": f"""{_MC}, pr as ({_pairs_sql('mc')})
      select feature_a, feature_b, {r('r', 'r')} from pr where abs(r) > 0.05""",
    "matrix_row_positions": f"{_MC} select symbol, ts, row_number() over (order by ts, symbol) - 1 as i from mc",
    "fama_macbeth": f"""{_FMS} select feature, {r('m', 'coef_mean')}, {r('s', 'coef_std')}, {r('m / se', 't_stat')},
      n as n_periods from ag join nw using (feature)""",
    "false_discovery": f"""with {FEAT_D}, {SNAP},
      t as (select symbol, avg(case when vol_ratio > 2.2 then 1.0 when vol_ratio is not null then 0.0 end) as p
        from snap group by 1),
      k as (select *, row_number() over (order by p, symbol) as rk, count(*) over () as n from t),
      z as (select *, max(case when p <= rk * 0.12 / n then rk end) over () as last from k)
      select symbol, {r('p', 'p_value')}, rk as bh_rank, {r('rk * 0.12 / n', 'bh_threshold')},
        rk <= coalesce(last, 0) as significant from z""",
    "orthogonality_pairs": f"""{_MC}, {_ranked('mc')},
      pr as ({_pairs_sql('rk')}) select feature_a, feature_b, {r('r', 'r')} from pr""",
    "redundant_features": _redundant_sql(),
    "stationarity": f"""{_MC}, l as (select * from ({melt_sql('mx', 'symbol, ts', _MATRIX_NAMES)})
        where value is not null),
      s as (select *, lag(value) over (partition by feature, symbol order by ts) as prev from l),
      g as (select feature, symbol, count(*) as obs, regr_count(value - prev, prev) as n, regr_slope(value - prev, prev) as b,
        regr_sxx(value - prev, prev) as sxx, regr_syy(value - prev, prev) as syy, regr_sxy(value - prev, prev) as sxy
        from s group by 1, 2 having count(*) >= 100),
      q as (select feature, b / sqrt((syy - b * sxy) / (n - 2) / sxx) as stat from g where sxx > 0)
      select feature, {r('avg(stat)', 'mean_stat')}, {r('avg(case when stat < -2.86 then 1.0 else 0.0 end) * 100', 'pct_stationary')},
        count(*) as n_series from q group by 1""",
    "importance_drift": f"""with {FEAT_D}, {_imp('cu', "ts >= timestamp '1999-01-04' and ts < timestamp '2002-01-01'")},
      {_imp('pv', "ts >= timestamp '1995-01-01' and ts < timestamp '1999-01-04'")},
      b as (select feature, cu.v as c, pv.v as p, rank() over (order by cu.v) as rc, rank() over (order by pv.v) as rp,
        row_number() over (order by abs(cu.v - pv.v) desc, feature) as place from cu join pv using (feature))
      select {r('sqrt(avg(pow(c - p, 2)))', 'drift_rmse')}, {r('corr(rc, rp)', 'rank_corr')},
        string_agg(case when place <= 2 then feature end, ',' order by place) as top_movers from b""",
    "prediction_shift_ks": f"""{_HALVES}, f as (select x, count(*) filter (where cur) as a, count(*) filter (where not cur) as b
        from h group by 1),
      c as (select sum(a) over (order by x) / sum(a) over ()::double as fa, sum(b) over (order by x) / sum(b) over ()::double as fb,
        sum(a) over () as na, sum(b) over () as nb from f),
      d as (select max(abs(fa - fb)) as d, any_value(na)::bigint as na, any_value(nb)::bigint as nb from c),
      l as (select *, sqrt(na::double * nb / (na + nb)) * d as lam from d),
      s as (select any_value(d) as d, any_value(na) as na, any_value(nb) as nb, any_value(lam) as lam,
        sum(case when k % 2 = 1 then 2.0 else -2.0 end * exp(-2.0 * k * k * lam * lam)) as p
        from l, (select unnest(range(1, 101)) as k))
      select {r('d', 'ks_stat')}, {r('case when lam < 0.2 then 1.0 else least(greatest(p, 0), 1) end', 'p_value')},
        na as n_current, nb as n_previous from s""",
    "governance_report": f"""{_HALVES},
      {_imp('cu', "ts >= timestamp '1999-01-04'")}, {_imp('pv', "ts < timestamp '1999-01-04'")},
      b as (select feature, cu.v as c, pv.v as p, rank() over (order by cu.v) as rc, rank() over (order by pv.v) as rp,
        row_number() over (order by abs(cu.v - pv.v) desc, feature) as place from cu join pv using (feature)),
      im as (select sqrt(avg(pow(c - p, 2))) as rm, corr(rc, rp) as rr,
        string_agg(case when place <= 5 then feature end, ',' order by place) as tm from b),
      f as (select x, count(*) filter (where cur) as a, count(*) filter (where not cur) as b from h group by 1),
      c as (select sum(a) over (order by x) / sum(a) over ()::double as fa, sum(b) over (order by x) / sum(b) over ()::double as fb,
        sum(a) over () as na, sum(b) over () as nb from f),
      d as (select max(abs(fa - fb)) as d, any_value(na)::double as na, any_value(nb)::double as nb from c),
      l as (select *, sqrt(na * nb / (na + nb)) * d as lam from d),
      s as (select any_value(d) as d, any_value(lam) as lam,
        sum(case when k % 2 = 1 then 2.0 else -2.0 end * exp(-2.0 * k * k * lam * lam)) as p
        from l, (select unnest(range(1, 101)) as k)),
      kp as (select d, case when lam < 0.2 then 1.0 else least(greatest(p, 0), 1) end as p from s),
      mo as (select avg(x) as mu, stddev_pop(x) as sd from h where cur),
      ms as (select any_value(mu) as mu, any_value(sd) as sd, avg(pow((x - mu) / sd, 3)) as sk,
        avg(pow((x - mu) / sd, 4)) - 3 as ku from h, mo where cur)
      select {r('0.07', 'ic_gap')}, {r('rm', 'drift_rmse')}, {r('rr', 'rank_corr')}, {r('mu', 'pred_mean')}, {r('sd', 'pred_std')},
        {r('sk', 'pred_skew')}, {r('ku', 'pred_kurt')}, {r('kp.d', 'ks_stat')}, {r('kp.p', 'ks_p_value')}, tm as top_movers,
        concat_ws(',', 'OVERFIT', case when rr < 0.5 then 'DRIFT' end, case when kp.p < 0.01 then 'SHIFT' end) as warnings
      from im, kp, ms""",
    "prediction_moments": f"""{_HALVES}, m as (select avg(x) as mu, stddev_pop(x) as sd from h where cur)
      select {r('any_value(mu)', 'mean')}, {r('any_value(sd)', 'std')}, {r('avg(pow((x - mu) / sd, 3))', 'skew')},
        {r('avg(pow((x - mu) / sd, 4)) - 3', 'kurt')} from h, m where cur""",
    "leak_test": f"""{_MC}, kk as (select *, md5(concat('42|', symbol, '|', cast(epoch_us(ts) as varchar))) as hsh from mc),
      a as (select *, row_number() over (order by ts, symbol) as i, row_number() over (order by hsh) as j from kk),
      pm as (select a.* exclude (future_ret_1h), b.future_ret_1h as yp from a join a b on a.i = b.j),
      l as ({melt_sql('pm', 'yp', _MATRIX_NAMES)}),
      {spearman_cte('sp', 'l', 'value', 'yp', 'feature', 101)},
      pa as (select 1 as one, future_ret_1h as y, lag(future_ret_1h, 5) over ({W}) as past from mc),
      {spearman_cte('pp', 'pa', 'past', 'y', 'one', 2)},
      le as (select 1 as one, future_ret_1h as y, future_ret_1h + sqrt(-2 * ln(greatest({_unit(43)}, 1e-12))) * cos(2 * pi() * {_unit(44)})
        * (select stddev_pop(future_ret_1h) from mc) * 1e-6 as leak from mc),
      {spearman_cte('lp', 'le', 'leak', 'y', 'one', 101)}
      select {r('(select avg(abs(ic)) from sp)', 'shuffled_mean_abs_ic')}, {r('(select ic from pp)', 'past_feature_ic')},
        (select ic from lp) > 0.999 as pipeline_detects, (select avg(abs(ic)) from sp) < 0.05 as shuffled_test_pass,
        (select ic from lp) > 0.95 as leaked_test_pass""",
    "deflated_sharpe": f"""with {BARS_D}, {WEEKLY_RET},
      m as (select symbol, count(*) as n, avg(ret) as mu, stddev_pop(ret) as sd from wret group by 1),
      g as (select symbol, any_value(n) as n, any_value(mu / sd) as s, avg(pow((ret - mu) / sd, 3)) as sk,
        avg(pow((ret - mu) / sd, 4)) as ku from wret join m using (symbol) group by 1),
      e as (select sqrt(2 * ln(2)) - (0.5772156649 + ln(ln(2))) / (2 * sqrt(2 * ln(2))) as mx),
      z as (select g.*, mx, (s - mx) / sqrt(greatest((1 - sk * s + (ku - 1) / 4 * s * s) / greatest(n - 1, 1), 1e-10)) as z from g, e),
      t as (select symbol, any_value(z) as z, sum(exp((2 * k + 1) * ln(abs(z)) - k * ln(2) - lgamma(k + 1)) * pow(-1, k) / (2 * k + 1)) * sign(any_value(z)) as ser0
        from z, (select unnest(range(0, 200)) as k) group by 1),
      o as (select z.*, case when abs(z.z) > 6 then case when z.z > 0 then 1.0 else 0.0 end else 0.5 + ser0 / sqrt(2 * pi()) end as dsr from z join t using (symbol))
      select symbol, n, {r('s', 'sharpe')}, {r('mx', 'expected_max_sharpe')}, {r('dsr', 'deflated_sharpe')},
        {r('1 - dsr', 'p_value')}, dsr > 0.95 as significant from o""",
    "return_covariance": f"""with {BARS_D}, {WEEKLY_RET} select a.symbol as a, b.symbol as b, count(*) as n,
      {r('covar_samp(a.ret, b.ret)', 'value')} from wret a join wret b on a.week = b.week and substr(a.symbol, 2)::int <= substr(b.symbol, 2)::int
      group by 1, 2 having count(*) >= 5""",
    "return_correlation": f"""with {BARS_D}, {WEEKLY_RET} select a.symbol as a, b.symbol as b, count(*) as n,
      {r('corr(a.ret, b.ret)', 'value')} from wret a join wret b on a.week = b.week and substr(a.symbol, 2)::int <= substr(b.symbol, 2)::int
      group by 1, 2 having count(*) >= 5""",
}
ORACLES["matrix_rolling_all"] = ORACLES["matrix_rolling"].replace(f" order by {_KEY7} limit 1500", "")
