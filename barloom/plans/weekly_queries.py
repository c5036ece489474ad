"""Calendars, point-in-time joins, universe filters and information coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import ic, resample, universe, weekly
from ..operators.features import build_features
from ..session import stage
from ..sources.fixtures import DAILY_SPEC, daily_bars, hourly_bars, table
from .sql import BARS_D, BARS_H, W, lag, r, roll, spearman_cte

FEATS = ["ret_1h", "rev_1d", "rvol_1d", "vol_ratio"]
H, D = DAILY_SPEC.bars_per_hour, DAILY_SPEC.bars_per_day


def daily_features(spark: SparkSession, sf_dir: str, names=FEATS) -> tuple[DataFrame, DataFrame]:
    bars = daily_bars(spark, sf_dir)
    return bars, build_features(bars, DAILY_SPEC, names)


def score() -> F.Column:
    """A fixed linear score standing in for a fitted model."""
    return 0.05 * F.col("rev_1d") + 0.01 * F.col("ret_1h") - 0.02 * F.col("rvol_1d")


def predictions(feats: DataFrame) -> DataFrame:
    return weekly.weekly_scores(weekly.last_rows(feats, FEATS, 12), FEATS, score())


SCORE_SQL = "0.05 * rev_1d + 0.01 * ret_1h - 0.02 * rvol_1d"

FEAT_D = f"""{BARS_D},
d0 as (select *, row_number() over ({W}) as pos, ln(close / {lag('close')}) as lr,
  ln(close / {lag('close', H)}) as x1h, ln(close / {lag('close', D)}) as x1d,
  ln(close / {lag('close', 3 * D)}) as x3d, ln(close / {lag('close', 5 * D)}) as x1w from bars_d),
d1 as (select *, {roll('stddev_samp', 'lr', D, H)} as sd, volume / nullif({roll('avg', 'volume', D, H)}, 0) as vr
  from d0),
feat_d as materialized (select symbol, ts, close, pos, lag(lr) over ({W}) as ret_1bar,
  lag(x1h) over ({W}) as ret_1h,
  lag(-x1d) over ({W}) as rev_1d, lag(sd) over ({W}) as rvol_1d, lag(vr) over ({W}) as vol_ratio,
  lag(x3d) over ({W}) as ret_3d, lag(x1w) over ({W}) as ret_1w from d1)"""

WEEKLY_RET = """wret as (select symbol, week, ln(last / first) as ret, n_bars from (
  select symbol, date_trunc('week', ts)::timestamp as week, min_by(close, ts) as first,
   max_by(close, ts) as last, count(*) as n_bars from bars_d group by 1, 2)
  where n_bars >= 2 and first > 0 and abs(ln(last / first)) <= 0.5)"""

WEEKS = """grid as (select symbol, week from (select symbol,
   unnest(generate_series(date_trunc('week', min(ts))::timestamp + interval 7 day,
    (select date_trunc('week', max(ts))::timestamp from bars_d), interval 7 day)) as week
   from bars_d group by symbol))"""

SNAP = f"""{WEEKS}, snap as (select grid.symbol, grid.week, f.* exclude (symbol, ts), f.ts as as_of
  from grid asof join feat_d f on grid.symbol = f.symbol and grid.week > f.ts)"""

LASTK = f"""{SNAP}, lastk as (select s.symbol, s.week, f.ts, f.ret_1h, f.rev_1d, f.rvol_1d, f.vol_ratio
  from snap s join feat_d f on s.symbol = f.symbol and f.pos between s.pos - 11 and s.pos),
preds as (select symbol, week, avg({SCORE_SQL}) as pred from lastk
  where ret_1h is not null and rev_1d is not null and rvol_1d is not null and vol_ratio is not null
  group by 1, 2)"""


def melt_sql(source: str, ids: str, names: list[str]) -> str:
    return " union all ".join(
        f"select {ids}, '{n}' as feature, {n} as value from {source}" for n in names)


# --- queries ---------------------------------------------------------------------------------

def resample_weekly(spark, sf):
    df = resample.resample(daily_bars(spark, sf), "1w")
    return df


def resample_six_hours(spark, sf):
    df = resample.resample(hourly_bars(spark, sf), "6h")
    return df


def week_grid(spark, sf):
    return resample.week_grid(daily_bars(spark, sf))


def _splits(fn):
    def run(spark, sf):
        span = fn(daily_bars(spark, sf))
        return spark.createDataFrame([(k, v) for k, v in span.items()], "edge string, at timestamp_ntz")
    return run


def zones(spark, sf):
    bars = daily_bars(spark, sf)
    mid = resample.rolling_splits(bars)["oos_mid"]
    ret = weekly.weekly_returns(bars)
    end = (F.col("week") + F.expr("INTERVAL 7 DAYS")).cast("timestamp_ntz")
    return ret.withColumn("zone", resample.zone(end, mid)).groupBy("zone").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("ret")).alias("total"), r6(F.avg("ret")).alias("mean"))


def weekly_returns(spark, sf):
    return weekly.weekly_returns(daily_bars(spark, sf)).select(
        "symbol", "week", r6("ret").alias("ret"), "n_bars")


def summed_returns(spark, sf):
    _, feats = daily_features(spark, sf, ["ret_1bar"])
    return weekly.summed_returns(feats).select("symbol", "week", r6("ret").alias("ret"))


def snapshot_asof(spark, sf):
    _, feats = daily_features(spark, sf)
    return weekly.snapshots(feats, FEATS).select(
        "symbol", "week", "as_of", *[r6(c).alias(c) for c in FEATS])


def last_k_rows(spark, sf):
    _, feats = daily_features(spark, sf)
    return weekly.last_rows(feats, FEATS, 12).select(
        "symbol", "week", "ts", *[r6(c).alias(c) for c in FEATS])


def weekly_predictions(spark, sf):
    _, feats = daily_features(spark, sf)
    return predictions(feats).select("symbol", "week", r6("pred", 8).alias("pred"))


def _moment():
    return F.to_timestamp_ntz(F.lit("1999-03-10 00:00:00"))


def at_or_before(spark, sf):
    _, feats = daily_features(spark, sf)
    return weekly.at_or_before(feats, _moment(), FEATS).select(
        "symbol", "as_of", *[r6(c).alias(c) for c in FEATS])


def latest_prices(spark, sf):
    return weekly.latest_prices(hourly_bars(spark, sf))


def latest_rvol(spark, sf):
    _, feats = daily_features(spark, sf, ["rvol_1d"])
    return weekly.latest_valid(feats, "rvol_1d", "rvol").select("symbol", r6("rvol").alias("rvol"))


def sampled_times(spark, sf):
    return weekly.sampled_times(hourly_bars(spark, sf), 50)


def tradeable_symbols(spark, sf):
    """Market segments as symbols; one of them is on the exclusion list here."""
    cust = table(spark, sf, "customer").select(F.concat(
        F.trim("c_mktsegment"), F.lit("USDT")).alias("symbol"))
    kept = universe.tradeable(cust, blacklist=["MACHINERYUSDT"], pegged=["BUILDING"])
    return kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


def pinned_universe(spark, sf):
    return universe.pin_universe(daily_bars(spark, sf), " l1, L7 ,l12").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"))


def live_universe(spark, sf):
    """Trained = symbols with bars; trading = suppliers with a positive balance; one is excluded."""
    trained = daily_bars(spark, sf).select("symbol")
    sup = table(spark, sf, "supplier").select(
        F.concat(F.lit("L"), (F.col("s_suppkey") % 20).cast("string")).alias("symbol"),
        F.when(F.col("s_acctbal") > 0, "TRADING").otherwise("BREAK").alias("status"),
        F.lit("USDT").alias("quote"))
    return universe.live_universe(trained, universe.trading_symbols(sup), blacklist=["L3"])


def time_range(spark, sf):
    import datetime as dt
    df = universe.training_window(daily_bars(spark, sf), dt.datetime(1999, 1, 4), 104, 60)
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"),
                                    F.max("ts").alias("last"))


def complete_rows(spark, sf):
    _, feats = daily_features(spark, sf)
    return universe.complete_rows(feats, FEATS).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))


def enough_history(spark, sf):
    return universe.enough_history(hourly_bars(spark, sf), 590).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


def fresh_symbols(spark, sf):
    bars = universe.drop_stale_epochs(daily_bars(spark, sf), 2001)
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


def market_proxy(spark, sf):
    return universe.market_proxy(daily_bars(spark, sf), ("L99", "L5")).select(
        "symbol", "ts", "close")


def market_proxy_longest(spark, sf):
    return universe.market_proxy(hourly_bars(spark, sf)).select("symbol", "ts", "close")


def clipped_columns(spark, sf):
    from ..functions.scalars import clip
    _, feats = daily_features(spark, sf)
    return feats.select("symbol", "ts", r6(clip("ret_1h", -0.1, 0.1)).alias("two_sided"),
                        r6(clip("rev_1d", lo=0)).alias("lower"), r6(clip("vol_ratio", hi=1)).alias("upper"))


def feature_ic_weekly(spark, sf):
    bars, feats = daily_features(spark, sf)
    return ic.weekly_feature_ic(feats, bars, FEATS).select(
        "week", "feature", "n_obs", r6("ic").alias("ic"))


def feature_ic_in_week(spark, sf):
    from ..operators.targets import forward_returns
    bars, feats = daily_features(spark, sf)
    with_target = forward_returns(feats, {"future_ret": H})
    return ic.in_week_ic(with_target, FEATS, "future_ret").select(
        "week", "feature", "n_obs", r6("ic").alias("ic"))


def model_ic_weekly(spark, sf):
    bars, feats = daily_features(spark, sf)
    return ic.model_ic(predictions(feats), weekly.weekly_returns(bars)).select(
        "week", "n_obs", r6("ic").alias("ic"))


def model_ic_dynamic(spark, sf):
    bars, feats = daily_features(spark, sf)
    return ic.model_ic(predictions(feats), weekly.weekly_returns(bars), dynamic=True).select(
        "week", "n_obs", r6("ic").alias("ic"))


def _hourly_matrix(spark, sf):
    from ..operators.targets import forward_returns
    names = ["ret_1h", "rev_1d", "rvol_1d", "vol_ratio", "vwap_dev"]
    from ..sources.fixtures import HOURLY_SPEC
    feats = build_features(hourly_bars(spark, sf), HOURLY_SPEC, names)
    return names, stage(forward_returns(feats, {"future_ret_1h": 4}))


def pooled_ic(spark, sf):
    names, rows = _hourly_matrix(spark, sf)
    return ic.pooled_ic(rows, names, "future_ret_1h").select("feature", "n_obs", r6("ic").alias("ic"))


def _complete_matrix(spark, sf):
    names, rows = _hourly_matrix(spark, sf)
    return names, universe.complete_rows(rows, [*names, "future_ret_1h"])


def icir_ranking(spark, sf):
    names, rows = _complete_matrix(spark, sf)
    return ic.rank_features(rows, names, "future_ret_1h", ["ts", "symbol"], min_block=300).select(
        "feature", *[r6(c).alias(c) for c in ("ic", "icir", "abs_ic")])


def ic_filter(spark, sf):
    names, rows = _complete_matrix(spark, sf)
    ics = ic.pooled_ic(rows, names, "future_ret_1h").select("feature", "ic")
    return ic.filter_features(ics, 0.02, 3).select("feature", r6("ic").alias("ic"), "selected")


def ic_selection_recent(spark, sf):
    bars, feats = daily_features(spark, sf)
    hist = ic.weekly_feature_ic(feats, bars, FEATS)
    return ic.select_recent(hist, [*FEATS, "unseen"], 8, 4, 2).select("feature", "n_obs", r6("mean_ic").alias("mean_ic"), "selected")


def signal_decay(spark, sf):
    names, rows = _hourly_matrix(spark, sf)
    return ic.signal_decay(rows, ["ret_1h", "rvol_1d"], [1, 4, 24]).select(
        "feature", "horizon", r6("ic_mean").alias("ic_mean"), "n_symbols")


def best_horizon(spark, sf):
    names, rows = _hourly_matrix(spark, sf)
    decay = ic.signal_decay(rows, ["ret_1h", "rvol_1d"], [1, 4, 24])
    return ic.best_horizon(decay).select("horizon", r6("mean_abs_ic").alias("mean_abs_ic"))


def ic_decay_warning(spark, sf):
    bars, feats = daily_features(spark, sf)
    return ic.decay_warning(ic.model_ic(predictions(feats), weekly.weekly_returns(bars)), 4, 0.05).select(
        "week", r6("recent_ic").alias("recent_ic"), "decayed")


def ic_gate(spark, sf):
    bars, feats = daily_features(spark, sf)
    return ic.ic_gate(ic.model_ic(predictions(feats), weekly.weekly_returns(bars)), -0.01).select(
        "week", r6("gate_ic").alias("gate_ic"), "gated")


def feature_ic_gate(spark, sf):
    bars, feats = daily_features(spark, sf)
    return ic.feature_ic_gate(ic.weekly_feature_ic(feats, bars, FEATS)).select(
        r6("mean_latest_ic").alias("mean_latest_ic"), "n_features", "gated")


QUERIES = {
    "resample_weekly": resample_weekly,
    "resample_six_hours": resample_six_hours,
    "week_grid": week_grid,
    "date_splits_rolling": _splits(resample.rolling_splits),
    "date_splits_thirds": _splits(resample.third_splits),
    "zone_totals": zones,
    "weekly_returns": weekly_returns,
    "weekly_returns_summed": summed_returns,
    "snapshot_asof": snapshot_asof,
    "snapshot_last_rows": last_k_rows,
    "weekly_predictions": weekly_predictions,
    "asof_at_or_before": at_or_before,
    "latest_prices": latest_prices,
    "latest_rvol": latest_rvol,
    "sampled_times": sampled_times,
    "tradeable_symbols": tradeable_symbols,
    "pinned_universe": pinned_universe,
    "live_universe": live_universe,
    "training_window": time_range,
    "complete_rows": complete_rows,
    "enough_history": enough_history,
    "fresh_symbols": fresh_symbols,
    "market_proxy": market_proxy,
    "market_proxy_longest": market_proxy_longest,
    "clipped_columns": clipped_columns,
    "feature_ic_weekly": feature_ic_weekly,
    "feature_ic_in_week": feature_ic_in_week,
    "model_ic_weekly": model_ic_weekly,
    "model_ic_dynamic": model_ic_dynamic,
    "feature_ic_pooled": pooled_ic,
    "feature_icir_ranking": icir_ranking,
    "feature_ic_filter": ic_filter,
    "feature_ic_recent": ic_selection_recent,
    "signal_decay": signal_decay,
    "best_horizon": best_horizon,
    "ic_decay_warning": ic_decay_warning,
    "ic_gate": ic_gate,
    "feature_ic_gate": feature_ic_gate,
}

# --- check SQL -------------------------------------------------------------------------------

_OHLCV = ["open", "high", "low", "close", "volume"]


def _resample_sql(bars: str, name: str, bucket: str) -> str:
    return (f"with {bars}, g as (select symbol, {bucket} as bucket, min_by(open, ts) as open, "
            f"max(high) as high, min(low) as low, max_by(close, ts) as close, sum(volume) as volume "
            f"from {name} group by 1, 2) select symbol, bucket as ts, "
            + ", ".join(_OHLCV) + " from g")


_SPAN = f"with {BARS_D}, s as (select min(ts) as lo, max(ts) as hi from bars_d)"
_EDGES = ("select 'start' as edge, lo as at from e union all select 'train_end', a from e "
          "union all select 'oos_mid', m from e union all select 'end', hi from e")
_ROLLING = """e0 as (select lo, hi, case when hi - lo >= interval 1456 day then lo + interval 1456 day / 2
   when hi - lo >= interval 728 day then lo + (hi - lo) / 2 else lo + (hi - lo) / 3 end as a from s),
  e as (select *, a + (hi - a) / 2 as m from e0)"""

from ..sources.fixtures import HOURLY_SPEC as _HS  # noqa: E402

_HH, _HD = _HS.bars_per_hour, _HS.bars_per_day
_MATRIX_NAMES = ["ret_1h", "rev_1d", "rvol_1d", "vol_ratio", "vwap_dev"]
_TPV = "(high + low + close) / 3 * volume"
MATRIX_H = f"""{BARS_H},
m0 as (select *, ln(close / {lag('close')}) as lr, ln(close / {lag('close', _HH)}) as x1h,
  ln(close / {lag('close', _HD)}) as x1d from bars_h),
m1 as (select *, {roll('stddev_samp', 'lr', _HD, _HH)} as sd,
  volume / nullif({roll('avg', 'volume', _HD, _HH)}, 0) as vr,
  (close - ({roll('sum', _TPV, _HD, _HH)}) / nullif({roll('sum', 'volume', _HD, _HH)}, 0)) / close as vd
  from m0),
mx as materialized (select symbol, ts, close, lag(x1h) over ({W}) as ret_1h, lag(-x1d) over ({W}) as rev_1d,
  lag(sd) over ({W}) as rvol_1d, lag(vr) over ({W}) as vol_ratio, lag(vd) over ({W}) as vwap_dev,
  ln(lead(close, 4) over ({W}) / close) as future_ret_1h from m1),
mc as (select * from mx where """ + " and ".join(
    f"{n} is not null" for n in [*_MATRIX_NAMES, "future_ret_1h"]) + ")"

_FIC = f"""with {FEAT_D}, {WEEKLY_RET}, {SNAP},
 j as (select snap.*, wret.ret from snap join wret using (symbol, week)),
 l as ({melt_sql('j', 'week, symbol, ret', FEATS)}),
 {spearman_cte('fic', 'l', 'value', 'ret', 'week, feature', 10)}"""
_MIC = f"""with {FEAT_D}, {WEEKLY_RET}, {LASTK},
 j as (select week, symbol, pred, ret from preds join wret using (symbol, week)),
 {spearman_cte('mic', 'j', 'pred', 'ret', 'week', 10)}"""
_MIC_DYN = f"""with {FEAT_D}, {WEEKLY_RET}, {LASTK},
 j as (select week, symbol, pred, ret from preds join wret using (symbol, week)),
 {spearman_cte('mic', 'j', 'pred', 'ret', 'week', 2)}"""
_DECAY = f"""with {MATRIX_H},
 h as (select symbol, ts, ret_1h, rvol_1d, horizon, ln(fut / close) as fwd from (
   select *, 1 as horizon, lead(close, 1) over ({W}) as fut from mx union all
   select *, 4, lead(close, 4) over ({W}) from mx union all
   select *, 24, lead(close, 24) over ({W}) from mx)),
 l as ({melt_sql('h', 'symbol, horizon, fwd', ['ret_1h', 'rvol_1d'])}),
 {spearman_cte('d', 'l', 'value', 'fwd', 'feature, horizon, symbol', 100)},
 dec as (select feature, horizon, coalesce(avg(case when n_obs >= 100 then ic end), 0.0) as ic_mean,
   count(case when n_obs >= 100 then ic end) as n_symbols from d group by 1, 2)"""

ORACLES = {
    "resample_weekly": _resample_sql(BARS_D, "bars_d", "date_trunc('week', ts)::timestamp"),
    "resample_six_hours": _resample_sql(BARS_H, "bars_h", "time_bucket(interval 6 hour, ts, timestamp '2000-01-01')"),
    "week_grid": f"""with {BARS_D}, m as (select unnest(generate_series(
        date_trunc('week', (select min(ts) from bars_d) + interval 6 day)::timestamp,
        date_trunc('week', (select max(ts) from bars_d))::timestamp, interval 7 day)) as ws),
      g as (select ws, lead(ws) over (order by ws) as we, row_number() over (order by ws) as week from m)
      select week, ws as week_start, we as week_end from g where we is not null""",
    "date_splits_rolling": f"{_SPAN}, {_ROLLING.replace('interval 1456 day / 2', 'interval 728 day')} {_EDGES}",
    "date_splits_thirds": f"{_SPAN}, e as (select *, lo + (hi - lo) / 3 as a, lo + 2 * ((hi - lo) / 3) as m from s) {_EDGES}",
    "zone_totals": f"""{_SPAN}, {_ROLLING.replace('interval 1456 day / 2', 'interval 728 day')}, {WEEKLY_RET}
      select case when week + interval 7 day <= (select m from e) then 'Y2' else 'Y3' end as zone,
        count(*) as n, {r('sum(ret)', 'total')}, {r('avg(ret)', 'mean')} from wret group by 1""",
    "weekly_returns": f"with {BARS_D}, {WEEKLY_RET} select symbol, week, {r('ret', 'ret')}, n_bars from wret",
    "weekly_returns_summed": f"""with {FEAT_D} select symbol, date_trunc('week', ts)::timestamp as week,
       {r('coalesce(sum(ret_1bar), 0)', 'ret')} from feat_d group by 1, 2""",
    "snapshot_asof": f"with {FEAT_D}, {SNAP} select symbol, week, as_of, "
        + ", ".join(r(c, c) for c in FEATS) + " from snap",
    "snapshot_last_rows": f"with {FEAT_D}, {LASTK} select symbol, week, ts, "
        + ", ".join(r(c, c) for c in FEATS) + " from lastk",
    "weekly_predictions": f"with {FEAT_D}, {LASTK} select symbol, week, {r('pred', 'pred', 8)} from preds",
    "asof_at_or_before": f"with {FEAT_D} select symbol, max(ts) as as_of, "
        + ", ".join(r(f"arg_max_null({c}, ts)", c) for c in FEATS)
        + " from feat_d where ts <= timestamp '1999-03-10' group by symbol",
    "latest_prices": f"with {BARS_H} select symbol, max_by(close, ts) as price from bars_h group by 1",
    "latest_rvol": f"with {FEAT_D} select symbol, {r('max_by(rvol_1d, ts)', 'rvol')} from feat_d "
                   "where rvol_1d is not null group by 1",
    "sampled_times": f"""with {BARS_H}, t as (select ts, row_number() over (order by ts) - 1 as i,
       count(*) over () as n from (select distinct ts from bars_h))
       select ts from t where i % greatest(1, n // 50) = 0""",
    "tradeable_symbols": """select concat(trim(c_mktsegment), 'USDT') as symbol, count(*) as n from customer
       where upper(trim(c_mktsegment)) not in ('MACHINERY', 'BUILDING') group by 1""",
    "pinned_universe": f"with {BARS_D} select symbol, count(*) as n from bars_d "
                       "where symbol in ('L1', 'L7', 'L12') group by 1",
    "live_universe": f"""with {BARS_D} select distinct symbol from bars_d where symbol <> 'L3' and symbol in
       (select concat('L', cast(s_suppkey % 20 as varchar)) from supplier where s_acctbal > 0)""",
    "training_window": f"""with {BARS_D} select symbol, count(*) as n, min(ts) as first, max(ts) as last
       from bars_d where ts >= timestamp '1999-01-04' - interval 728 day
       and ts < timestamp '1999-01-04' - interval 60 minute group by 1""",
    "complete_rows": f"with {FEAT_D} select symbol, count(*) as n, min(ts) as first from feat_d where "
        + " and ".join(f"{c} is not null" for c in FEATS) + " group by 1",
    "enough_history": f"""with {BARS_H} select symbol, count(*) as n, max(ts) as last from bars_h
       group by 1 having count(*) >= 590""",
    "fresh_symbols": f"""with {BARS_D} select symbol, count(*) as n, max(ts) as last from bars_d
       group by 1 having year(max(ts)) >= 2001""",
    "market_proxy": f"with {BARS_D} select symbol, ts, close from bars_d where symbol = 'L5'",
    "market_proxy_longest": f"""with {BARS_H} select symbol, ts, close from bars_h where symbol =
       (select symbol from bars_h group by 1 order by count(*) desc, symbol limit 1)""",
    "clipped_columns": f"""with {FEAT_D} select symbol, ts,
       {r('case when ret_1h is not null then least(greatest(ret_1h, -0.1), 0.1) end', 'two_sided')},
       {r('case when rev_1d is not null then greatest(rev_1d, 0) end', 'lower')},
       {r('case when vol_ratio is not null then least(vol_ratio, 1) end', 'upper')} from feat_d""",
    "feature_ic_weekly": f"{_FIC} select week, feature, n_obs, {r('ic', 'ic')} from fic",
    "feature_ic_in_week": f"""with {FEAT_D}, t as (select *, ln(lead(close, {H}) over ({W}) / close) as y from feat_d),
      big as (select date_trunc('week', ts)::timestamp as week, symbol from t group by 1, 2 having count(*) >= 3),
      lg as (select * from ({melt_sql('t', 'symbol, ts, y', FEATS)}) where value is not null and y is not null),
      l as (select date_trunc('week', ts)::timestamp as week, symbol, feature, avg(value) as value, avg(y) as ym
        from lg group by 1, 2, 3 having (date_trunc('week', min(ts))::timestamp, symbol) in (select (week, symbol) from big)),
      {spearman_cte('c', 'l', 'value', 'ym', 'week, feature', 5)}
      select week, feature, n_obs, {r('ic', 'ic')} from c""",
    "model_ic_weekly": f"{_MIC} select week, n_obs, {r('ic', 'ic')} from mic",
    "model_ic_dynamic": f"""{_MIC_DYN} select week, n_obs, {r(
        'case when n_obs >= greatest(5, least(10, n_obs // 2)) then ic else 0 end', 'ic')} from mic""",
    "feature_ic_pooled": f"with {MATRIX_H}, l as ({melt_sql('mx', 'future_ret_1h', _MATRIX_NAMES)}), "
        + spearman_cte("p", "l", "value", "future_ret_1h", "feature", 50)
        + f" select feature, n_obs, {r('ic', 'ic')} from p",
    "feature_icir_ranking": f"""with {MATRIX_H},
      num as (select *, row_number() over (order by ts, symbol) - 1 as i, count(*) over () as total from mc),
      blk as (select *, i // greatest(300, total // 10) as block from num
        where greatest(300, total // 10) * 2 <= total and i // greatest(300, total // 10) < 10),
      l as ({melt_sql('mc', 'future_ret_1h', _MATRIX_NAMES)}),
      lb as ({melt_sql('blk', 'block, future_ret_1h', _MATRIX_NAMES)}),
      {spearman_cte('p', 'l', 'value', 'future_ret_1h', 'feature', 50)},
      {spearman_cte('q', 'lb', 'value', 'future_ret_1h', 'block, feature', 50)},
      s as (select feature, sum(ic) / 10 as m, sqrt(greatest(sum(ic * ic) / 10 - pow(sum(ic) / 10, 2), 0)) as sd
        from q group by 1)
      select feature, {r('ic', 'ic')}, {r('case when sd > 1e-10 then m / sd else 0 end', 'icir')},
        {r('abs(ic)', 'abs_ic')} from p join s using (feature)""",
    "feature_ic_filter": f"""with {MATRIX_H}, l as ({melt_sql('mc', 'future_ret_1h', _MATRIX_NAMES)}),
      {spearman_cte('p', 'l', 'value', 'future_ret_1h', 'feature', 50)},
      k as (select *, row_number() over (order by abs(ic) desc, feature) as place,
        sum(case when abs(ic) >= 0.02 then 1 else 0 end) over () as passing from p)
      select feature, {r('ic', 'ic')}, case when passing < 3 then place <= 3 else abs(ic) >= 0.02 end as selected
      from k""",
    "feature_ic_recent": f"""{_FIC},
      n as (select *, row_number() over (partition by feature order by week desc) as rn from fic),
      m as (select feature, count(*) as n_obs, case when count(*) >= 4 then avg(ic) else 0 end as mean_ic
        from n where rn <= 8 group by 1 union all select 'unseen', 0, 0),
      k as (select *, row_number() over (order by mean_ic desc, feature) as place,
        sum(case when mean_ic >= 0 then 1 else 0 end) over () as passing from m)
      select feature, n_obs, {r('mean_ic', 'mean_ic')},
        case when passing < 2 then place <= 2 else mean_ic >= 0 end as selected from k""",
    "signal_decay": f"{_DECAY} select feature, horizon, {r('ic_mean', 'ic_mean')}, n_symbols from dec",
    "best_horizon": f"""{_DECAY} select horizon, {r('avg(abs(ic_mean))', 'mean_abs_ic')} from dec
      group by horizon order by avg(abs(ic_mean)) desc, horizon limit 1""",
    "ic_decay_warning": f"""{_MIC}, g as (select week, case when count(ic) over p >= 4 then avg(ic) over p end as v
        from mic window p as (order by week rows between 4 preceding and 1 preceding))
      select week, {r('v', 'recent_ic')}, abs(v) < 0.05 as decayed from g""",
    "ic_gate": f"""{_MIC}, g as (select week, case when count(ic) over p >= 4 then avg(ic) over p end as v
        from mic window p as (order by week rows between 4 preceding and 1 preceding))
      select week, {r('v', 'gate_ic')}, coalesce(v < -0.01, false) as gated from g""",
    "feature_ic_gate": f"""{_FIC}, n as (select feature, max_by(ic, week) as ic from fic group by 1)
      select {r('case when count(ic) >= 4 then avg(ic) end', 'mean_latest_ic')}, count(ic) as n_features,
        coalesce(case when count(ic) >= 4 then avg(ic) end < 0, false) as gated from n""",
}
