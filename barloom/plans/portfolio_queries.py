"""Portfolios, reports and feature-set updates, driven by the fixed linear score."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import ic, portfolio, reports, stability, walkforward
from ..operators.features import build_features
from ..operators.regime import regime_by_week
from ..operators.resample import week_grid
from ..operators.targets import forward_returns
from ..operators.universe import market_proxy
from ..operators.walkrun import LineLearner, RunData, RunPlan, walk_forward_run, weekly_of
from ..operators.weekly import snapshots, weekly_returns
from ..session import shared_folder, stage
from ..sources.ledger import Ledger
from ..sources.fixtures import DAILY_SPEC, daily_bars, hourly_bars, table
from .research_queries import MIN_VOL_OBS, _REGIME
from .sql import BARS_D, BARS_H, r, spearman_cte
from .weekly_queries import (
    FEAT_D, FEATS, LASTK, WEEKLY_RET, daily_features, melt_sql, predictions,
)

RULES = portfolio.Rules(fee_adjusted=False, top_n=3)


def _daily(spark, sf):
    bars, feats = daily_features(spark, sf)
    return bars, stage(feats)


def _inputs(spark, sf, daily=None):
    bars, feats = daily or _daily(spark, sf)
    preds = stage(predictions(feats))
    rets = weekly_returns(bars)
    regimes = regime_by_week(market_proxy(bars, ("L5",)), DAILY_SPEC, MIN_VOL_OBS)
    rvol = snapshots(feats, ["rvol_1d"]).withColumnRenamed("rvol_1d", "rvol")
    return feats, preds, rets, regimes, rvol


def _trades(spark, sf, daily=None):
    feats, preds, rets, regimes, rvol = _inputs(spark, sf, daily)
    picks = stage(portfolio.pick(preds, regimes, RULES))
    return picks, portfolio.trades(picks, rets, rvol), (preds, rets, regimes)


def _weekly(spark, sf, daily=None):
    picks, trades, (preds, rets, regimes) = _trades(spark, sf, daily)
    trades = stage(trades)
    weeks = preds.select("week").distinct()
    n_symbols = preds.groupBy("week").agg(F.count(F.lit(1)).alias("n_symbols"))
    weekly = portfolio.weekly_metrics(
        weeks, portfolio.week_results(trades), ic.model_ic(preds, rets), portfolio.turnover(picks),
        regimes, n_symbols)
    return stage(weekly), trades


WALK = walkforward.Schedule(train_weeks=104, retrain_every=26, embargo_minutes=14_400, gate_threshold=-0.05)


def _walk_data(spark, sf):
    bars, feats = daily_features(spark, sf)
    feats = stage(forward_returns(feats, {"future_ret": 5}))
    regimes = regime_by_week(market_proxy(bars, ("L5",)), DAILY_SPEC, MIN_VOL_OBS)
    rvol = snapshots(feats, ["rvol_1d"]).withColumnRenamed("rvol_1d", "rvol")
    return RunData(feats, "future_ret", weekly_returns(bars), regimes, rvol, ic.weekly_feature_ic(feats, bars, FEATS))


def _walk_preds(data):
    return walkforward.walk_forward_predictions(
        data.feats, ["rev_1d"], "future_ret", walkforward.least_squares("future_ret", "rev_1d"), WALK)


def _walk(spark, sf, **changes):
    data = _walk_data(spark, sf)
    return walkforward.gated_run(_walk_preds(data), data.rets, data.regimes, data.rvol, RULES, replace(WALK, **changes), data.history)


def walk_forward_predictions(spark, sf):
    preds = _walk_preds(_walk_data(spark, sf))
    return preds.select("week", "symbol", r6("pred", 8).alias("pred"))


def walk_forward_weekly(spark, sf):
    _, weekly = _walk(spark, sf)
    return weekly.select("week", "n_symbols", "n_trades", "regime", *[r6(c).alias(c) for c in (
        "week_ret", "long_ret", "short_ret", "ic", "turnover_pct", "cum_ret", "drawdown", "max_drawdown")])


def walk_forward_regimes(spark, sf):
    """Regimes of a gated run: its marker weeks are left out."""
    _, weekly = _walk(spark, sf)
    return reports.regime_breakdown(weekly).select(
        "regime", "n_weeks", *[r6(c).alias(c) for c in ("mean_ret", "total_ret", "mean_ic", "win_rate_pct")])


def walk_forward_inverted(spark, sf):
    """Gate at its default, so that weeks after poor ones trade against their predictions."""
    _, weekly = _walk(spark, sf, gate_threshold=-1.0, invert=True)
    return weekly.select("week", "n_trades", "regime", *[r6(c).alias(c) for c in ("week_ret", "ic", "cum_ret")])


def walk_forward_gated_inverted(spark, sf):
    """Gate and inversion at once, each with its threshold."""
    _, weekly = _walk(spark, sf, invert=True)
    return weekly.select("week", "n_symbols", "n_trades", "regime", *[r6(c).alias(c) for c in ("week_ret", "ic", "turnover_pct", "cum_ret")])


def walk_forward_forced(spark, sf):
    """Every week against its predictions; the features gate at zero."""
    _, weekly = _walk(spark, sf, gate_threshold=0.0, force_invert=True)
    return weekly.select("week", "n_symbols", "n_trades", "regime", *[r6(c).alias(c) for c in ("week_ret", "ic", "turnover_pct", "cum_ret")])


RUN = RunPlan(active=("ret_1h", "rev_1d"), core=("rev_1d",), candidates=("rvol_1d", "vol_ratio"),
              schedule=replace(WALK, retrain_every=52, invert=True), rules=RULES, max_turnover=1, ic_threshold=0.02, min_features=2)


def _resumed(spark, sf):
    """A run that is killed after its third block, in the middle of the fourth, and goes on."""
    data, ledger = _walk_data(spark, sf), Ledger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    done = walk_forward_run(data, RUN, LineLearner(), ledger, "run", stop_after=3)
    torn = ledger.attempt("run", done)  # what a lost driver leaves: tables without a commit
    seen = ledger.read("run", "weekly")
    if seen is not None:  # no block has traded yet where no model was adopted
        torn.write("weekly", seen.drop("block"))
    walk_forward_run(data, RUN, LineLearner(), ledger, "run")
    return ledger


def _read(ledger, table, schema):
    """Rows of a table of the run; none where no block wrote it."""
    rows = ledger.read("run", table)
    return ledger.spark.createDataFrame([], schema) if rows is None else rows


def walk_forward_run_weekly(spark, sf):
    """Weekly metrics of a resumed run: updates of the feature set, pre-filter, rival models, gate, kill switch."""
    weekly = weekly_of(_resumed(spark, sf), "run")
    if weekly is None:
        weekly = spark.createDataFrame([], "week timestamp_ntz, n_symbols long, n_trades long, regime string, block int, "
                                           "week_ret double, ic double, turnover_pct double, cum_ret double, drawdown double")
    return weekly.select(
        "week", "n_symbols", "n_trades", "regime", "block", *[r6(c).alias(c) for c in ("week_ret", "ic", "turnover_pct", "cum_ret", "drawdown")])


def walk_forward_run_features(spark, sf):
    """What each retrain of a resumed run did to the feature set, and what its pre-filter kept."""
    ledger = _resumed(spark, sf)
    kept = _read(ledger, "training", "block int, feature string, ic double, selected boolean").select("block", "feature", r6("ic").alias("ic"), "selected")
    status = _read(ledger, "features", "block int, feature string, status string")
    return status.select("block", "feature", "status").join(kept, ["block", "feature"], "left")


def portfolio_picks(spark, sf):
    _, preds, _, regimes, _ = _inputs(spark, sf)
    return portfolio.pick(preds, regimes, RULES).select(
        "week", "symbol", r6("pred", 8).alias("pred"), "regime", "base_scale", "side")


def portfolio_picks_fee_adjusted(spark, sf):
    _, preds, _, regimes, _ = _inputs(spark, sf)
    return portfolio.pick_fee_adjusted(preds, regimes, portfolio.Rules(top_n=3)).select(
        "week", "symbol", r6("pred", 8).alias("pred"), "regime", "base_scale", "side")


def portfolio_quantile(spark, sf):
    _, preds, _, _, _ = _inputs(spark, sf)
    return portfolio.pick_quantile(preds).select("week", "symbol", r6("pred", 8).alias("pred"), "side")


_TRADE = ["week", "symbol", "side", "regime", "held"]


def portfolio_trades(spark, sf):
    _, trades, _ = _trades(spark, sf)
    return trades.select(*_TRADE, *[r6(c).alias(c) for c in ("ret", "scale", "pnl")])


def confidence_trades(spark, sf):
    feats, preds, rets, _, rvol = _inputs(spark, sf)
    conf = rvol.select("week", "symbol", (F.col("rvol") * 1.3).alias("confidence"))
    out = portfolio.confidence_trades(portfolio.pick_quantile(preds), rets, conf, 0.5, 0.8)
    return out.select("week", "symbol", "side", "held", *[r6(c).alias(c) for c in ("size", "pnl", "unit_ret")])


def week_results(spark, sf):
    _, trades, _ = _trades(spark, sf)
    return portfolio.week_results(trades).select(
        "week", "n_trades", *[r6(c).alias(c) for c in ("week_ret", "long_ret", "short_ret")])


def turnover(spark, sf):
    picks, _, _ = _trades(spark, sf)
    return portfolio.turnover(picks).select("week", r6("turnover_pct").alias("turnover_pct"))


def weekly_metrics(spark, sf):
    weekly, _ = _weekly(spark, sf)
    return weekly.select("week", "n_symbols", "n_trades", "regime", "on_track", *[r6(c).alias(c) for c in (
        "week_ret", "long_ret", "short_ret", "ic", "turnover_pct", "cum_ret", "drawdown", "max_drawdown")])


def performance_report(spark, sf):
    weekly, _ = _weekly(spark, sf)
    cols = ["total_return", "sharpe", "max_drawdown", "ic_mean", "icir", "ic_positive_pct",
            "positive_weeks_pct", "best_week", "worst_week", "avg_turnover_pct", "long_sum", "short_sum",
            "annualised"]
    return reports.performance(weekly).select("n_weeks", *[r6(c).alias(c) for c in cols])


def tail_risk(spark, sf):
    weekly, _ = _weekly(spark, sf)
    return reports.tail_risk(weekly).select(r6("var").alias("var"), r6("cvar").alias("cvar"))


def tail_risk_by_symbol(spark, sf):
    rets = weekly_returns(daily_bars(spark, sf))
    return reports.tail_risk(rets, 0.95, "ret", ["symbol"]).select(
        "symbol", r6("var").alias("var"), r6("cvar").alias("cvar"))


def liquidity_stress(spark, sf):
    weekly, _ = _weekly(spark, sf)
    return reports.liquidity_stress(weekly).select("n_weeks", r6("stress_sharpe").alias("stress_sharpe"))


def regime_breakdown(spark, sf):
    weekly, _ = _weekly(spark, sf)
    return reports.regime_breakdown(weekly).select("regime", "n_weeks", *[r6(c).alias(c) for c in (
        "mean_ret", "total_ret", "std_ret", "mean_ic", "long_sum", "short_sum", "win_rate_pct")])


def side_summary(spark, sf):
    _, trades, _ = _trades(spark, sf)
    return reports.side_summary(trades).select(
        "side", "n_trades", r6("mean_pnl").alias("mean_pnl"), r6("win_rate_pct").alias("win_rate_pct"))


def symbol_concentration(spark, sf):
    _, trades, _ = _trades(spark, sf)
    return reports.symbol_concentration(trades).select(
        "total_trades", r6("avg_per_symbol").alias("avg_per_symbol"), "max_single_symbol", "unique_symbols")


def top_traded_symbols(spark, sf):
    picks, _, _ = _trades(spark, sf)
    return reports.top_symbols(picks, 10)


def what_if(spark, sf):
    weekly, _ = _weekly(spark, sf)
    return reports.what_if(weekly).select(*[r6(c).alias(c) for c in (
        "actual", "bull_only", "shorts_only", "skip_bear", "positive_ic_only")])


def win_rates(spark, sf):
    _, trades, _ = _trades(spark, sf)
    return reports.win_rates(trades).select(
        "week", r6("win_rate_pct").alias("win_rate_pct"), r6("profit_factor").alias("profit_factor"))


def rolling_sharpe(spark, sf):
    weekly, _ = _weekly(spark, sf)
    return reports.rolling_sharpe(weekly).select("week", r6("rolling_sharpe", 5).alias("rolling_sharpe"))


def anomaly_flags(spark, sf):
    weekly, trades = _weekly(spark, sf)
    return reports.anomaly_flags(weekly, trades).select(
        F.array_join("flags", ",").alias("flags"), F.col("n_flags"))


def kill_criteria(spark, sf):
    weekly, _ = _weekly(spark, sf)
    return reports.kill_criteria(weekly, 0.764, 0.005).select(
        r6("ic_mean").alias("ic_mean"), r6("ic_positive_pct").alias("ic_positive_pct"),
        "n_positive_regimes", "ic_gate", "stability_gate", "regime_gate", "baseline_gate", "all_pass")


def kill_switch(spark, sf):
    weekly, _ = _weekly(spark, sf)
    return portfolio.kill_switch(weekly).select("week", r6("week_ret").alias("week_ret"), "paused")


def pause_states(spark, sf):
    """Hysteresis pause of each symbol's price as an equity curve."""
    return portfolio.pause_state(hourly_bars(spark, sf), -0.6, -0.3, "ts", "close", ["symbol"]).select(
        "symbol", "ts", r6("drawdown").alias("drawdown"), "paused")


def capped_weights(spark, sf):
    """Order value per customer as portfolio weights per nation."""
    orders, cust = table(spark, sf, "orders"), table(spark, sf, "customer")
    spend = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spend"))
    w = spend.join(cust, spend.o_custkey == cust.c_custkey).select(
        F.col("c_nationkey").alias("portfolio"), F.col("o_custkey").alias("holding"), "spend")
    total = w.groupBy("portfolio").agg(F.sum("spend").alias("total"))
    w = w.join(total, "portfolio").withColumn("weight", F.col("spend") / F.col("total"))
    return portfolio.cap_weights(w.select("portfolio", "holding", "weight")).select(
        "portfolio", "holding", r6("weight").alias("weight"))


def _book(spark, sf):
    """Open positions from suppliers: one per symbol, alternating sides, entered at a past close."""
    bars = hourly_bars(spark, sf)
    entry = bars.where(F.col("ts") <= F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))).groupBy("symbol").agg(
        F.max_by("close", "ts").alias("entry_price"))
    n = F.substring("symbol", 2, 4).cast("int")
    pos = entry.select("symbol", "entry_price", F.when(n % 2 == 0, "LONG").otherwise("SHORT").alias("side"),
                       (1000.0 + 100.0 * n).alias("size_usd"), F.lit(0.5).alias("scale"))
    prices = bars.where(F.substring("symbol", 2, 4).cast("int") != 3).groupBy("symbol").agg(
        F.max_by("close", "ts").alias("price"))
    return pos, prices


def mark_to_market(spark, sf):
    pos, prices = _book(spark, sf)
    return portfolio.mark_to_market(pos, prices).select("symbol", "side", r6("unrealised").alias("unrealised"))


def close_positions(spark, sf):
    pos, prices = _book(spark, sf)
    return portfolio.close_positions(pos, prices, 10000.0).select("symbol", "side", *[r6(c).alias(c) for c in (
        "exit_price", "gross_pnl", "fees_slippage", "net_pnl", "equity_after")])


def open_positions(spark, sf):
    pos, prices = _book(spark, sf)
    return portfolio.open_positions(pos.select("symbol", "side", "scale"), prices, 10000.0).select(
        "symbol", "side", *[r6(c).alias(c) for c in ("entry_price", "size_usd", "fees_slippage", "equity_after")])


def falsification(spark, sf):
    bars = daily_bars(spark, sf)
    feats = build_features(bars, DAILY_SPEC, ["ret_1w", "ret_3d", "vol_regime"])
    snap = snapshots(feats, ["ret_1w", "ret_3d", "vol_regime"])
    return reports.baselines(snap, weekly_returns(bars, None)).select(
        "baseline", *[r6(c).alias(c) for c in ("mean_ic", "std_ic", "icir", "pct_positive")], "n_weeks", "best")


def _history(spark, sf, daily=None):
    bars, feats = daily or daily_features(spark, sf)
    hist = ic.weekly_feature_ic(feats, bars, FEATS).select("week", "feature", "ic")
    regimes = regime_by_week(market_proxy(bars, ("L5",)), DAILY_SPEC, MIN_VOL_OBS)
    return hist.join(regimes, "week")


def feature_ic_stats(spark, sf):
    return reports.feature_ic_stats(_history(spark, sf)).select(
        "feature", r6("mean_ic").alias("mean_ic"), r6("std_ic").alias("std_ic"), "n_obs",
        r6("positive_ratio").alias("positive_ratio"))


def feature_ic_assessment(spark, sf):
    return reports.ic_assessment(_history(spark, sf)).select(
        "feature", r6("mean_ic").alias("mean_ic"), "assessment", "consistent", "noisy")


def feature_set_update(spark, sf):
    return stability.propose_update(
        _history(spark, sf), ["rvol_1d", "ret_1h"], ["rvol_1d"], ["rev_1d", "vol_ratio"], 4, 1)


def feature_set_overlap(spark, sf):
    """Sets: per quarter, the features with a positive mean IC."""
    hist = _history(spark, sf).withColumn("step", F.date_trunc("quarter", "week").cast("date").cast("string"))
    sets = hist.groupBy("step", "feature").agg(F.avg("ic").alias("m")).where(F.col("m") > 0)
    return stability.jaccard_overlap(sets).select(r6("jaccard").alias("jaccard"))


def retrain_degradation(spark, sf):
    """In-sample IC = quarter mean, out-of-sample IC = mean of the quarter after."""
    from pyspark.sql import Window
    hist = _history(spark, sf).groupBy(F.date_trunc("quarter", "week").alias("q"), "feature").agg(
        F.avg("ic").alias("ic_in"))
    nxt = F.lead("ic_in").over(Window.partitionBy("feature").orderBy("q"))
    runs = hist.withColumn("ic_out", nxt).where(F.col("ic_out").isNotNull())
    return reports.retrain_degradation(runs).select("n_retrains", *[r6(c).alias(c) for c in (
        "avg_ic_in", "avg_ic_out", "avg_degradation_pct")])


def prediction_fit(spark, sf):
    _, preds, rets, _, rvol = _inputs(spark, sf)
    both = preds.join(rets, ["week", "symbol"]).join(rvol.select("week", "symbol", "rvol"), ["week", "symbol"])
    return reports.weighted_r2(both, "ret", "pred", "rvol").select(*[r6(c).alias(c) for c in (
        "weighted_r2", "r2", "sign_accuracy_pct")])


def regime_counts(spark, sf):
    regimes = regime_by_week(market_proxy(daily_bars(spark, sf), ("L5",)), DAILY_SPEC, MIN_VOL_OBS)
    return reports.value_counts(regimes, "regime")


def importance_ranks(spark, sf):
    hist = _history(spark, sf)
    imp = hist.groupBy(F.col("regime").alias("label"), "feature").agg(F.avg("ic").alias("importance"))
    return reports.importance_ranks(imp).select("label", "feature", r6("importance").alias("importance"), "rank")


def retrain_schedule(spark, sf):
    from ..operators.models import walk_forward_schedule
    return walk_forward_schedule(week_grid(daily_bars(spark, sf)), 4, 2)


def full_report_json(spark, sf):
    daily = _daily(spark, sf)
    weekly, trades = _weekly(spark, sf, daily)
    return reports.nested_report(weekly, trades, stage(_history(spark, sf, daily))).select(
        F.to_json(F.struct("*")).alias("report"))


QUERIES = {
    "portfolio_picks": portfolio_picks,
    "portfolio_picks_fee_adjusted": portfolio_picks_fee_adjusted,
    "portfolio_quantile": portfolio_quantile,
    "portfolio_trades": portfolio_trades,
    "portfolio_confidence_trades": confidence_trades,
    "portfolio_week_results": week_results,
    "portfolio_turnover": turnover,
    "portfolio_weekly_metrics": weekly_metrics,
    "performance_report": performance_report,
    "tail_risk": tail_risk,
    "tail_risk_by_symbol": tail_risk_by_symbol,
    "liquidity_stress": liquidity_stress,
    "regime_breakdown": regime_breakdown,
    "side_summary": side_summary,
    "symbol_concentration": symbol_concentration,
    "top_traded_symbols": top_traded_symbols,
    "what_if_histories": what_if,
    "win_rates": win_rates,
    "rolling_sharpe": rolling_sharpe,
    "anomaly_flags": anomaly_flags,
    "kill_criteria": kill_criteria,
    "kill_switch": kill_switch,
    "walk_forward_predictions": walk_forward_predictions,
    "walk_forward_weekly": walk_forward_weekly,
    "walk_forward_regimes": walk_forward_regimes,
    "walk_forward_inverted": walk_forward_inverted,
    "walk_forward_gated_inverted": walk_forward_gated_inverted,
    "walk_forward_forced": walk_forward_forced,
    "walk_forward_run_weekly": walk_forward_run_weekly,
    "walk_forward_run_features": walk_forward_run_features,
    "pause_states": pause_states,
    "capped_weights": capped_weights,
    "mark_to_market": mark_to_market,
    "close_positions": close_positions,
    "open_positions": open_positions,
    "falsification": falsification,
    "feature_ic_stats": feature_ic_stats,
    "feature_ic_assessment": feature_ic_assessment,
    "feature_set_update": feature_set_update,
    "feature_set_overlap": feature_set_overlap,
    "retrain_degradation": retrain_degradation,
    "prediction_fit": prediction_fit,
    "regime_counts": regime_counts,
    "importance_ranks": importance_ranks,
    "retrain_schedule": retrain_schedule,
    "full_report_json": full_report_json,
}

# --- check SQL -------------------------------------------------------------------------------

# The regime CTEs become a derived table beside the panel CTEs.
_REG = "reg as (" + _REGIME.replace("with " + BARS_D + ",", "with", 1) + ")"
_PANEL = f"""with {FEAT_D}, {WEEKLY_RET}, {LASTK}, {_REG}"""
_SIDES = f"""{_PANEL},
 el as (select p.*, coalesce(regime, 'LOW_VOL_GRIND') as regime, least(3, count(*) over (partition by week) // 2) as n,
   count(*) over (partition by week) as total from preds p left join reg using (week)),
 e2 as (select *, regime in ('BULL_TREND', 'LOW_VOL_GRIND') and pred > 0 as cl,
   regime in ('BEAR_TREND', 'HIGH_VOL_LATERAL', 'LOW_VOL_GRIND') as cs,
   case when regime in ('BULL_TREND', 'HIGH_VOL_LATERAL') then 0.5::double else 1.0::double end as base_scale
   from el where total >= 5),
 e3 as (select *, row_number() over (partition by week, cl order by pred desc, symbol) as rb,
   row_number() over (partition by week order by pred, symbol desc) as rw from e2),
 pk as (select week, symbol, pred, regime, base_scale, 'BUY' as side from e3 where cl and rb <= n
   union all select week, symbol, pred, regime, base_scale, 'SELL' from e3 where cs and rw <= n)"""
_HELD = """wb as (select week, lag(week) over (order by week) as before from (select distinct week from {src})),
 hd as (select a.*, b.week is not null as held from {src} a join wb on wb.week = a.week left join {src} b
   on b.week = wb.before and b.symbol = a.symbol and b.side = a.side)"""
_TRADES = f"""{_SIDES}, {_HELD.format(src='pk')},
 t0 as (select hd.*, coalesce(wret.ret, 0) as ret, snap.rvol_1d as rvol from hd
   left join wret using (week, symbol) left join snap using (week, symbol)),
 t1 as (select *, case when side = 'BUY' then least(case when rvol is not null
    then base_scale / greatest(rvol, 0.01) else base_scale end, 1.0) else base_scale end as scale from t0),
 tr as (select *, greatest((case when side = 'BUY' then ret else -ret end
    - case when held then 0 else 0.002 end) * scale, -1) as pnl from t1),
 wr as (select week, count(*) as n_trades, avg(pnl) as week_ret, coalesce(avg(case when side = 'BUY' then pnl end), 0) as long_ret,
   coalesce(avg(case when side = 'SELL' then pnl end), 0) as short_ret,
   avg(case when held then 0.0 else 1.0 end) * 100 as turnover_pct from tr group by 1)"""
_WEEKLY = f"""{_TRADES}, jj as (select week, symbol, pred, ret from preds join wret using (symbol, week)),
 {spearman_cte('mic', 'jj', 'pred', 'ret', 'week', 10)},
 wm0 as (select w.week, w.n_symbols, coalesce(n_trades, 0) as n_trades, coalesce(week_ret, 0) as week_ret,
   coalesce(long_ret, 0) as long_ret, coalesce(short_ret, 0) as short_ret, coalesce(ic, 0) as ic,
   coalesce(turnover_pct, 100) as turnover_pct, coalesce(regime, 'LOW_VOL_GRIND') as regime
   from (select week, count(*) as n_symbols from preds group by 1) w left join wr using (week)
   left join mic using (week) left join reg using (week)),
 wm1 as (select *, product(1 + week_ret) over (order by week rows unbounded preceding) as cum from wm0),
 wm2 as (select *, cum / max(cum) over (order by week rows unbounded preceding) - 1 as drawdown from wm1),
 wm as materialized (select *, cum - 1 as cum_ret, min(drawdown) over (order by week rows unbounded preceding) as max_drawdown from wm2)"""
_FITTED = f"""wks as (select week, row_number() over (order by week) - 1 as i from (select distinct week from lastk where rev_1d is not null)),
 tg as (select *, ln(lead(close, 5) over (partition by symbol order by ts) / close) as y from feat_d),
 fits as (select rw, regr_slope(y, rev_1d) as b, regr_intercept(y, rev_1d) as a from
   (select week as rw from wks where i % 26 = 0) join tg on ts >= rw - interval 728 day and ts < rw - interval 10 day
   where y is not null and rev_1d is not null group by 1 having count(*) >= 100),
 fit as (select *, lead(rw) over (order by rw) as nx from fits),
 preds as (select symbol, week, avg(a + b * rev_1d) as pred from lastk join fit on week >= rw and (nx is null or week < nx)
   where rev_1d is not null group by 1, 2)"""


def _decided(gate: float, invert: float | None, force: bool = False) -> str:
    """Gate and inversion over ``preds``, week by week: the state is the live ICs of the last four weeks, null
    where gated. ``po`` are the predictions as traded."""
    full = "len(live) = 4 and len(list_filter(live, lambda x: x is null)) = 0"
    mean = "(live[1] + live[2] + live[3] + live[4]) / 4"
    flip = "true" if force else "false" if invert is None else f"({full} and {mean} < {invert})"
    shut = f"((n_features >= 4 and feature_ic < {gate}) or ({full} and {mean} < {gate}))"
    return f"""jg as (select week, symbol, pred, ret from preds join wret using (symbol, week)),
 {spearman_cte('gic', 'jg', 'pred', 'ret', 'week', 2)},
 jf as (select snap.*, wret.ret from snap join wret using (symbol, week)),
 lf as ({melt_sql('jf', 'week, symbol, ret', FEATS)}),
 {spearman_cte('ffi', 'lf', 'value', 'ret', 'week, feature', 10)},
 fl as (select week, feature, last_value(ic ignore nulls) over (partition by feature order by week rows between unbounded preceding
   and 1 preceding) as prev from (select week from ffi union select week from preds) cross join (select distinct feature from ffi)
   left join (select week, feature, ic from ffi) using (week, feature)),
 fw as (select week, count(prev) as n_features, coalesce(avg(prev), 0) as feature_ic from fl group by 1),
 g1 as materialized (select week, case when n_obs >= greatest(5, least(10, n // 2)) then ic else 0 end as ic, coalesce(n_features, 0) as n_features,
   coalesce(feature_ic, 0) as feature_ic, row_number() over (order by week) as i
   from (select week, count(*) as n from preds group by 1) left join gic using (week) left join fw using (week) where n >= 5),
 gt(i, week, gated, flipped, ic, live) as (select 0::bigint, null::timestamp, false, false, 0.0::double, []::double[]
   union all select i, week, gated, flipped, case when gated then feature_ic when flipped then -ic else ic end,
     list_append(live, case when gated then null when flipped then -round(ic, 5) else round(ic, 5) end)[-4:] from (
     select *, not gated and {flip} as flipped from (
       select g1.*, gt.live, {shut} as gated from gt join g1 on g1.i = gt.i + 1))),
 gd as materialized (select week, gated, flipped, ic from gt where i > 0),
 po as (select symbol, week, case when flipped then -pred else pred end as pred from preds join gd using (week) where not gated)"""


def _walked(fitted: str, decided: str) -> str:
    """_WEEKLY with other predictions, and the marker rows of gated weeks."""
    text = _WEEKLY.replace(LASTK, LASTK[:LASTK.index("preds as (")] + fitted + ", " + decided).replace("with ", "with recursive ", 1)
    text = text.replace("from preds p left join reg", "from po p left join reg")
    text = text.replace("w.n_symbols, coalesce(n_trades", "case when gated then 0 else w.n_symbols end as n_symbols, coalesce(n_trades")
    text = text.replace("coalesce(ic, 0) as ic,\n   coalesce(turnover_pct, 100)", "gd.ic as ic,\n   case when gated then 0 else coalesce(turnover_pct, 100) end")
    text = text.replace("coalesce(regime, 'LOW_VOL_GRIND') as regime\n   from (select week, count(*)",
                        "case when gated then 'IC_GATED' else coalesce(regime, 'LOW_VOL_GRIND') end as regime\n   from (select week, count(*)")
    return text.replace("group by 1) w left join wr using (week)\n   left join mic using (week)", "group by 1) w join gd using (week) left join wr using (week)\n  ")


_WALKED = _walked(_FITTED, _decided(-0.05, None))
_INVERTED = _walked(_FITTED, _decided(-1.0, 0.0))
_GATED_INVERTED = _walked(_FITTED, _decided(-0.05, 0.0))
_FORCED = _walked(_FITTED, _decided(0.0, None, True))
_LIVE_4 = "len(live) = 4 and len(list_filter(live, lambda x: x is null)) = 0"
_LIVE_MEAN = "(live[1] + live[2] + live[3] + live[4]) / 4"
# A whole run in one statement: sets of features and gates are recursions over blocks and weeks.
_RUN = f"""{_PANEL[:_PANEL.index("preds as (")].replace('with ', 'with recursive ', 1)} {_REG},
 fine as (select * from lastk where ret_1h is not null and rev_1d is not null and rvol_1d is not null and vol_ratio is not null),
 wks as (select week, row_number() over (order by week) - 1 as i from (select distinct week from fine)),
 blk as (select i // 52 as b, min(week) as rw from wks group by 1),
 jf as (select snap.*, wret.ret from snap join wret using (symbol, week)),
 lf as ({melt_sql('jf', 'week, symbol, ret', FEATS)}),
 {spearman_cte('ffi', 'lf', 'value', 'ret', 'week, feature', 10)},
 hs as (select week, feature, ic from ffi join wks using (week) where i % 2 = 0),
 pool as (select unnest(['rev_1d', 'ret_1h', 'rvol_1d', 'vol_ratio']) as feature, unnest([0, 1, 2, 3]) as place),
 st as materialized (select b, feature, place, count(ic) as seen, count(*) filter (where ic < 0) as neg, count(*) filter (where ic > 0) as pos,
   coalesce(avg(ic), 0) as m from (select b, feature, place, ic, row_number() over (partition by b, feature order by week desc nulls last) as rn
     from (select b, rw, feature, place from blk, pool) left join (select hs.* from hs join reg using (week)) h using (feature)
     where b > 0 and (h.week is null or h.week < rw)) where rn <= 4 group by all),
 act(b, active, said) as (select 0::bigint, ['rev_1d', 'ret_1h'], []::struct(feature varchar, status varchar)[]
   union all select b, list(feature) filter (where status in ('CORE', 'ADDED', 'KEPT')), list(struct_pack(feature := feature, status := status)) from (
     select b, feature, case when feature = 'rev_1d' then 'CORE' when ad and row_number() over (partition by b order by ad desc, m desc, place)
        <= 1 - least(1, sum(case when rm then 1 else 0 end) over (partition by b)) then 'ADDED'
       when rm and row_number() over (partition by b order by rm desc, place) <= 1 then 'REMOVED' when isin then 'KEPT' else 'OUT' end as status
     from (select *, feature in ('rvol_1d', 'vol_ratio') and (not isin or rm) and seen >= 2 and pos >= 2 as ad
       from (select st.*, list_contains(active, feature) as isin, list_contains(active, feature) and feature <> 'rev_1d' and seen >= 3 and neg >= 3 as rm
         from act join st on st.b = act.b + 1 where feature <> 'ret_1h' or list_contains(active, feature)))) group by b),
 tg as (select *, ln(lead(close, 5) over (partition by symbol order by ts) / close) as y from feat_d),
 tr0 as (select b, symbol, ts, ret_1h, rev_1d, rvol_1d, vol_ratio, y from blk join tg on ts >= rw - interval 728 day and ts < rw - interval 10 day
   where y is not null and ret_1h is not null and rev_1d is not null and rvol_1d is not null and vol_ratio is not null),
 tr as materialized (select *, ts > max(ts) over (partition by b) - interval 182 day as late from tr0 qualify count(*) over (partition by b) >= 100),
 lt as materialized ({melt_sql('tr', 'b, symbol, ts, y, late', FEATS)}),
 {spearman_cte('pic', 'lt', 'value', 'y', 'b, feature', 50)},
 sel as materialized (select b, feature, ic, case when count(*) filter (where abs(ic) >= 0.02) over (partition by b) < 2
    then row_number() over (partition by b order by abs(ic) desc, feature) <= 2 else abs(ic) >= 0.02 end as kept
   from pic join act using (b) where list_contains(active, feature)),
 ch as materialized (select *, row_number() over (partition by b order by abs(ic) desc, feature) = 1 as top, count(*) over (partition by b) as n from sel where kept),
 ln as materialized (select b, feature, top, n, regr_intercept(y, value) as a, regr_slope(y, value) as s,
   regr_intercept(y, value) filter (where not late) as ea, regr_slope(y, value) filter (where not late) as es
   from lt join ch using (b, feature) group by all),
 cv as (select b, symbol, ts, y, sum(case when top then ea + es * value end) as p1, avg(ea + es * value) as p2
   from lt join ln using (b, feature) where late group by all),
 {spearman_cte('ca', 'cv', 'p1', 'y', 'b', 10)},
 {spearman_cte('cb', 'cv', 'p2', 'y', 'b', 10)},
 won as (select b, cb.ic > ca.ic + 0.005 as everyone, case when cb.ic > ca.ic + 0.005 then cb.ic else ca.ic end as ic from ca join cb using (b)),
 wl as (select b, feature, case when everyone then a / n else a end as a, case when everyone then s / n else s end as s
   from ln join won using (b) where won.ic > 0 and (everyone or top)),
 mb as (select blk.b, max(wl.b) as mb from blk join wl on wl.b <= blk.b group by 1),
 fx as ({melt_sql('fine', 'symbol, week, ts', FEATS)}),
 preds as materialized (select symbol, week, avg(p) as pred from (select symbol, week, ts, sum(a + s * value) as p from fx join wks using (week)
   join mb on mb.b = wks.i // 52 join wl on wl.b = mb.mb and wl.feature = fx.feature group by 1, 2, 3) group by 1, 2),
 jg as (select week, symbol, pred, ret from preds join wret using (symbol, week)),
 {spearman_cte('gic', 'jg', 'pred', 'ret', 'week', 2)},
 fl as (select week, feature, last_value(ic ignore nulls) over (partition by feature order by week rows between unbounded preceding
   and 1 preceding) as prev from (select week from hs union select week from preds) cross join (select distinct feature from hs)
   left join (select week, feature, ic from hs) using (week, feature)),
 fw as (select week, count(prev) as n_features, coalesce(avg(prev), 0) as feature_ic from fl group by 1),
 el as (select p.*, coalesce(regime, 'LOW_VOL_GRIND') as regime, least(3, count(*) over (partition by flip, week) // 2) as n,
   count(*) over (partition by flip, week) as total from (select symbol, week, case when flip then -pred else pred end as pred, flip
     from preds, (select unnest([false, true]) as flip)) p left join reg using (week)),
 e2 as (select *, regime in ('BULL_TREND', 'LOW_VOL_GRIND') and pred > 0 as cl,
   regime in ('BEAR_TREND', 'HIGH_VOL_LATERAL', 'LOW_VOL_GRIND') as cs,
   case when regime in ('BULL_TREND', 'HIGH_VOL_LATERAL') then 0.5::double else 1.0::double end as base_scale from el where total >= 5),
 e3 as (select *, row_number() over (partition by flip, week, cl order by pred desc, symbol) as rb,
   row_number() over (partition by flip, week order by pred, symbol desc) as rw from e2),
 pk as (select flip, week, symbol, base_scale, 'BUY' as side from e3 where cl and rb <= n
   union all select flip, week, symbol, base_scale, 'SELL' from e3 where cs and rw <= n),
 it as (select flip, week, list(struct_pack(name := concat(symbol, side), r := case when side = 'BUY' then coalesce(ret, 0) else -coalesce(ret, 0) end,
    scale := case when side = 'BUY' then least(case when rvol_1d is not null then base_scale / greatest(rvol_1d, 0.01) else base_scale end, 1.0)
      else base_scale end)) as items
   from pk left join wret using (week, symbol) left join snap using (week, symbol) group by 1, 2),
 g1 as materialized (select week, n, case when n_obs >= greatest(5, least(10, n // 2)) then gic.ic else 0 end as ic, coalesce(n_features, 0) as n_features,
   coalesce(feature_ic, 0) as feature_ic, row_number() over (order by week) as i, coalesce(regime, 'LOW_VOL_GRIND') as regime, x.items as plain, y.items as turned
   from (select week, count(*) as n from preds group by 1) left join gic using (week) left join fw using (week) left join reg using (week)
   left join (select * from it where not flip) x using (week) left join (select * from it where flip) y using (week) where n >= 5),
 k(i, week, n_symbols, n_trades, regime, week_ret, ic, turnover, live, book, cum, peak, lft) as (
   select 0::bigint, null::timestamp, 0::bigint, 0::bigint, '', 0.0::double, 0.0::double, 0.0::double, []::double[], []::varchar[], 1.0::double, 0.0::double, 0
   union all
   select i, week, case when shut then 0 else n end, coalesce(len(items), 0), case when l0 > 0 then 'KILL_SWITCH' when gated then 'IC_GATED' else regime end,
     ret, live_ic, case when shut then 0 when items is null then 100 else list_avg(list_transform(items, lambda x: case when list_contains(book, x.name) then 0.0 else 100.0 end)) end,
     list_append(live, case when gated then null else round(live_ic, 5) end)[-4:],
     case when items is null then book else list_transform(items, lambda x: x.name) end,
     cum * (1 + ret), case when l0 = 1 then cum else greatest(peak, cum * (1 + ret)) end, greatest(l0 - 1, 0)
   from (select *, coalesce(list_avg(list_transform(items, lambda x: greatest((x.r - case when list_contains(book, x.name) then 0 else 0.002 end) * x.scale, -1))), 0) as ret
     from (select *, l0 > 0 or gated as shut, case when l0 > 0 then 0 when gated then feature_ic when flipped then -ic else ic end as live_ic,
         case when l0 > 0 or gated then null when flipped then turned else plain end as items
       from (select *, l0 = 0 and not gated and {_LIVE_4} and {_LIVE_MEAN} < 0 as flipped
         from (select *, l0 = 0 and ((n_features >= 4 and feature_ic < -0.05) or ({_LIVE_4} and {_LIVE_MEAN} < -0.05)) as gated
           from (select g1.*, k.live, k.book, k.cum, k.peak, case when k.lft = 0 and k.peak > 0 and k.cum / k.peak - 1 < -0.2 then 4 else k.lft end as l0
             from k join g1 on g1.i = k.i + 1)))))),
 wm as (select *, cum - 1 as cum_ret, cum / max(cum) over (order by i rows unbounded preceding) - 1 as drawdown from k where i > 0)"""
_HIST = f"""with {FEAT_D}, {WEEKLY_RET}, {LASTK}, {_REG},
 j as (select snap.*, wret.ret from snap join wret using (symbol, week)),
 l as ({melt_sql('j', 'week, symbol, ret', FEATS)}),
 {spearman_cte('fic', 'l', 'value', 'ret', 'week, feature', 10)},
 hs as (select week, feature, ic, regime from fic join reg using (week))"""
_BOOK = f"""with {BARS_H}, pos as (select symbol, max_by(close, ts) as entry_price,
   case when substr(symbol, 2)::int % 2 = 0 then 'LONG' else 'SHORT' end as side,
   1000.0::double + 100.0::double * substr(symbol, 2)::int as size_usd, 0.5::double as scale from bars_h
   where ts <= timestamp '2024-01-15' group by 1),
 pr as (select symbol, max_by(close, ts) as price from bars_h where symbol <> 'S3' group by 1),
 bk as (select *, coalesce(price, entry_price) as px from pos left join pr using (symbol)),
 cl as (select *, size_usd * case when side = 'LONG' then px / entry_price - 1 else 1 - px / entry_price end as gross,
   size_usd * 0.0015 as cost from bk)"""


def _cols(*names: str) -> str:
    return ", ".join(r(n, n) for n in names)


_SQUARE_ROOT_52 = "sqrt(52.0)"

ORACLES = {
    "portfolio_picks": f"{_SIDES} select week, symbol, {r('pred', 'pred', 8)}, regime, base_scale, side from pk",
    "portfolio_quantile": f"""{_PANEL}, q as (select *, count(*) over (partition by week) as n,
      (rank() over (partition by week order by pred) + (count(*) over (partition by week, pred) - 1) / 2.0) as rk from preds),
      z as (select *, least(greatest(0.15, 1.5 / n), 0.35) as q, rk / n as pct from q)
      select week, symbol, {r('pred', 'pred', 8)}, 'BUY' as side from z where pct >= 1 - q
      union all select week, symbol, {r('pred', 'pred', 8)}, 'SELL' from z where pct <= q""",
    "portfolio_trades": f"{_TRADES} select week, symbol, side, regime, held, {_cols('ret', 'scale', 'pnl')} from tr",
    "portfolio_confidence_trades": f"""{_PANEL}, q as (select *, count(*) over (partition by week) as n,
      (rank() over (partition by week order by pred) + (count(*) over (partition by week, pred) - 1) / 2.0) as rk from preds),
      z as (select *, least(greatest(0.15, 1.5 / n), 0.35) as q, rk / n as pct from q),
      pk as (select week, symbol, pred, 'BUY' as side from z where pct >= 1 - q
        union all select week, symbol, pred, 'SELL' from z where pct <= q), {_HELD.format(src='pk')},
      t0 as (select hd.*, coalesce(wret.ret, 0) as ret, least(greatest(coalesce(snap.rvol_1d * 1.3, 1.0), 0), 1) as m from hd
        left join wret using (week, symbol) left join snap using (week, symbol)),
      t1 as (select *, m * 0.8 as size, case when side = 'BUY' then ret else -ret end - case when held then 0 else 0.002 end as u
        from t0 where m >= 0.5)
      select week, symbol, side, held, {r('size', 'size')}, {r('u * size', 'pnl')}, {r('case when size > 0 then u else 0 end', 'unit_ret')} from t1""",
    "portfolio_week_results": f"{_TRADES} select week, n_trades, {_cols('week_ret', 'long_ret', 'short_ret')} from wr",
    "portfolio_turnover": f"{_TRADES} select week, {_cols('turnover_pct')} from wr",
    "portfolio_weekly_metrics": f"""{_WEEKLY} select week, n_symbols, n_trades, regime,
      week_ret >= pow(1.1::double, 1.0::double / 52) - 1 as on_track, {_cols('week_ret', 'long_ret', 'short_ret', 'ic', 'turnover_pct',
      'cum_ret', 'drawdown', 'max_drawdown')} from wm""",
    "walk_forward_predictions": f"""{_WALKED} select week, symbol, {r('pred', 'pred', 8)} from preds""",
    "walk_forward_weekly": f"""{_WALKED} select week, n_symbols, n_trades, regime, {_cols('week_ret', 'long_ret', 'short_ret', 'ic',
      'turnover_pct', 'cum_ret', 'drawdown', 'max_drawdown')} from wm""",
    "walk_forward_regimes": f"""{_WALKED} select regime, count(*) as n_weeks, {r('avg(week_ret)', 'mean_ret')}, {r('sum(week_ret)', 'total_ret')},
      {r('avg(ic)', 'mean_ic')}, {r('avg(case when week_ret > 0 then 1.0 else 0.0 end) * 100', 'win_rate_pct')}
      from wm where regime <> 'IC_GATED' group by 1""",
    "walk_forward_inverted": f"""{_INVERTED} select week, n_trades, regime, {_cols('week_ret', 'ic', 'cum_ret')} from wm""",
    "walk_forward_gated_inverted": f"""{_GATED_INVERTED} select week, n_symbols, n_trades, regime, {_cols('week_ret', 'ic', 'turnover_pct', 'cum_ret')} from wm""",
    "walk_forward_forced": f"""{_FORCED} select week, n_symbols, n_trades, regime, {_cols('week_ret', 'ic', 'turnover_pct', 'cum_ret')} from wm""",
    "walk_forward_run_weekly": f"""{_RUN} select week, n_symbols, n_trades, wm.regime, cast(wks.i // 52 as integer) as block, {_cols('week_ret', 'ic')},
      {r('turnover', 'turnover_pct')}, {_cols('cum_ret', 'drawdown')} from wm join wks using (week)""",
    "walk_forward_run_features": f"""{_RUN} select cast(b as integer) as block, feature, status, {r('ic', 'ic')}, kept as selected
      from (select b, said.feature, said.status from (select b, unnest(said) as said from act)) left join sel using (b, feature)""",
    "performance_report": f"""{_WEEKLY} select count(*) as n_weeks, {r('product(1 + week_ret) - 1', 'total_return')},
      {r(f'avg(week_ret) / stddev_pop(week_ret) * {_SQUARE_ROOT_52}', 'sharpe')}, {r('min(drawdown)', 'max_drawdown')},
      {r('avg(ic)', 'ic_mean')}, {r('avg(ic) / (stddev_samp(ic) + 1e-8)', 'icir')},
      {r('avg(case when ic > 0 then 1.0 else 0.0 end) * 100', 'ic_positive_pct')},
      {r('avg(case when week_ret > 0 then 1.0 else 0.0 end) * 100', 'positive_weeks_pct')},
      {r('max(week_ret)', 'best_week')}, {r('min(week_ret)', 'worst_week')}, {r('avg(turnover_pct)', 'avg_turnover_pct')},
      {r('sum(long_ret)', 'long_sum')}, {r('sum(short_ret)', 'short_sum')},
      {r('pow(product(1 + week_ret), 52.0 / count(*)) - 1', 'annualised')} from wm""",
    "tail_risk": f"""{_WEEKLY}, v as (select quantile_cont(week_ret, 0.05) as v from wm)
      select {r('any_value(v)', 'var')}, {r('avg(case when week_ret <= v then week_ret end)', 'cvar')} from wm, v""",
    "tail_risk_by_symbol": f"""with {BARS_D}, {WEEKLY_RET}, v as (select symbol, quantile_cont(ret, 0.05) as v from wret group by 1)
      select symbol, {r('any_value(v)', 'var')}, {r('avg(case when ret <= v then ret end)', 'cvar')} from wret join v using (symbol) group by 1""",
    "liquidity_stress": f"""{_WEEKLY}, s as (select * from wm where n_symbols <= (select quantile_cont(n_symbols, 0.2) from wm))
      select count(*) as n_weeks, {r(f'coalesce(avg(week_ret) / nullif(stddev_pop(week_ret), 0) * {_SQUARE_ROOT_52}, 0)', 'stress_sharpe')} from s""",
    "regime_breakdown": f"""{_WEEKLY} select regime, count(*) as n_weeks, {r('avg(week_ret)', 'mean_ret')}, {r('sum(week_ret)', 'total_ret')},
      {r('stddev_pop(week_ret)', 'std_ret')}, {r('avg(ic)', 'mean_ic')}, {r('sum(long_ret)', 'long_sum')}, {r('sum(short_ret)', 'short_sum')},
      {r('avg(case when week_ret > 0 then 1.0 else 0.0 end) * 100', 'win_rate_pct')} from wm group by 1""",
    "side_summary": f"""{_TRADES} select side, count(*) as n_trades, {r('avg(pnl)', 'mean_pnl')},
      {r('avg(case when pnl > 0 then 1.0 else 0.0 end) * 100', 'win_rate_pct')} from tr group by 1""",
    "symbol_concentration": f"""{_TRADES}, c as (select symbol, count(*) as n from tr group by 1)
      select sum(n)::bigint as total_trades, {r('avg(n)', 'avg_per_symbol')}, max(n) as max_single_symbol, count(*) as unique_symbols from c""",
    "top_traded_symbols": f"{_SIDES} select symbol, count(*) as n from pk group by 1 order by n desc, symbol limit 10",
    "what_if_histories": f"""{_WEEKLY} select {r('product(1 + week_ret) - 1', 'actual')},
      {r("product(1 + case when regime = 'BULL_TREND' then week_ret else 0 end) - 1", 'bull_only')},
      {r('product(1 + short_ret) - 1', 'shorts_only')},
      {r("product(1 + case when regime <> 'BEAR_TREND' then week_ret else 0 end) - 1", 'skip_bear')},
      {r('product(1 + case when ic > 0 then week_ret else 0 end) - 1', 'positive_ic_only')} from wm""",
    "win_rates": f"""{_TRADES} select week, {r('avg(case when pnl > 0 then 1.0 else 0.0 end) * 100', 'win_rate_pct')},
      {r('sum(case when pnl > 0 then pnl else 0 end) / nullif(sum(case when pnl < 0 then -pnl else 0 end), 0)', 'profit_factor')} from tr group by 1""",
    "rolling_sharpe": f"""{_WEEKLY}, z as (select week, avg(week_ret) over p as m, stddev_pop(week_ret) over p as s from wm
      window p as (order by week rows between 3 preceding and current row))
      select week, {r(f'coalesce(m / nullif(s, 0) * {_SQUARE_ROOT_52}, 0)', 'rolling_sharpe', 5)} from z""",
    "anomaly_flags": f"""{_WEEKLY}, a as (select min(drawdown) as dd, avg(week_ret) / stddev_pop(week_ret) * {_SQUARE_ROOT_52} as sh,
        max(abs(week_ret)) as wk from wm), b as (select max(scale) as sc, min(pnl) as lo from tr),
      f as (select unnest([case when dd < -0.2 then 'DRAWDOWN' end, case when sh > 10 then 'SHARPE' end,
        case when wk > 1 then 'WEEK_RETURN' end, case when sc > 5 then 'POSITION_SCALE' end,
        case when lo <= -1 then 'TRADE_WIPEOUT' end]) as flag, unnest([1, 2, 3, 4, 5]) as k from a, b)
      select coalesce(string_agg(flag, ',' order by k), '') as flags, count(flag)::int as n_flags from f where flag is not null""",
    "kill_criteria": f"""{_WEEKLY}, a as (select avg(ic) as m, avg(case when ic > 0 then 1.0 else 0.0 end) * 100 as p from wm),
      g as (select count(*) as n from (select regime from wm group by 1 having avg(week_ret) > 0))
      select {r('m', 'ic_mean')}, {r('p', 'ic_positive_pct')}, n as n_positive_regimes, m > 0 and p > 50 as ic_gate,
        true as stability_gate, n >= 2 as regime_gate, m > 0.005 as baseline_gate,
        m > 0 and p > 50 and n >= 2 and m > 0.005 as all_pass from a, g""",
    "kill_switch": f"""{_WEEKLY.replace('with bars_d', 'with recursive bars_d', 1)},
      o as materialized (select *, row_number() over (order by week) as i from wm),
      k(i, week, ret, cum, peak, lft, paused) as (
        select 0::bigint, null::timestamp, 0.0::double, 1.0::double, 0.0::double, 0, false
        union all
        select i, week, ret, cum, case when paused and lft = 0 then cum else greatest(peak, cum) end, lft, paused from (
          select i, week, peak, case when l0 > 0 then 0 else week_ret end as ret,
            cum * (1 + case when l0 > 0 then 0 else week_ret end) as cum,
            case when l0 > 0 then l0 - 1 else 0 end as lft, l0 > 0 as paused from (
            select o.i, o.week, o.week_ret, k.cum, k.peak,
              case when k.lft = 0 and k.peak > 0 and k.cum / k.peak - 1 < -0.2 then 4 else k.lft end as l0
            from k join o on o.i = k.i + 1)))
      select week, {r('ret', 'week_ret')}, paused from k where i > 0""",
    "pause_states": f"""with {BARS_H}, a as (select *, coalesce(max(close) over (partition by symbol order by ts
        rows between unbounded preceding and 1 preceding), close) as peak from bars_h),
      b as (select *, close / peak - 1 as dd from a),
      c as (select *, case when dd <= -0.6 then true when dd >= -0.3 then false end as mark from b)
      select symbol, ts, {r('dd', 'drawdown')}, coalesce(last_value(mark ignore nulls) over
        (partition by symbol order by ts rows unbounded preceding), false) as paused from c""",
    "capped_weights": f"""with s as (select c_nationkey as portfolio, o_custkey as holding, sum(o_totalprice) as spend
        from orders join customer on o_custkey = c_custkey group by 1, 2),
      w as (select *, least(greatest(spend / sum(spend) over (partition by portfolio), 0), 0.2) as w from s)
      select portfolio, holding, {r('w / sum(w) over (partition by portfolio)', 'weight')} from w""",
    "mark_to_market": f"{_BOOK} select symbol, side, {r('case when price is null then 0 else gross end', 'unrealised')} from cl",
    "close_positions": f"""{_BOOK} select symbol, side, {r('px', 'exit_price')}, {r('gross', 'gross_pnl')}, {r('cost', 'fees_slippage')},
      {r('gross - cost', 'net_pnl')}, {r('10000 + sum(gross - cost) over (order by symbol rows unbounded preceding)', 'equity_after')} from cl""",
    "open_positions": f"""{_BOOK}, o as (select symbol, side, price, scale / greatest((select sum(scale) from pos), 1) as sh from pos join pr using (symbol)),
      e as (select *, 10000 * product(1 - sh * 0.0015) over (order by symbol rows unbounded preceding) as after from o)
      select symbol, side, {r('price', 'entry_price')}, {r('after / (1 - sh * 0.0015) * sh', 'size_usd')},
        {r('after / (1 - sh * 0.0015) * sh * 0.0015', 'fees_slippage')}, {r('after', 'equity_after')} from e""",
    "falsification": f"""with {FEAT_D}, {LASTK},
      wraw as (select symbol, date_trunc('week', ts)::timestamp as week, ln(max_by(close, ts) / min_by(close, ts)) as ret
        from bars_d group by 1, 2 having count(*) >= 2 and min_by(close, ts) > 0 and max_by(close, ts) > 0),
      d2 as materialized (select symbol, ts, pos, sd from d1),
      rk as (select a.symbol, a.ts, case when count(b.sd) >= 20 and max(a.sd) is not null then
          (count(case when b.sd < a.sd then 1 end) + (count(case when b.sd = a.sd then 1 end) + 1) / 2.0) / count(b.sd) end as v
        from d2 a join d2 b on a.symbol = b.symbol and b.pos between a.pos - 99 and a.pos group by 1, 2),
      vr as (select symbol, ts, lag(v) over (partition by symbol order by ts) as vol_regime from rk),
      s0 as (select snap.symbol, snap.week, coalesce(ret_1w, 0) as momentum_1w, coalesce(ret_3d, 0) as momentum_3d,
        coalesce(-vol_regime, 0) as low_volatility, coalesce((select avg(v) from (select unnest([ret_1w, ret_3d, vol_regime]) as v)), 0) as composite, ret,
        cast(concat('0x', substr(md5(concat('42|', snap.symbol, '|', strftime(snap.week, '%Y-%m-%d'))), 1, 8)) as bigint) / 4294967296.0 as random
        from snap join vr on snap.symbol = vr.symbol and snap.as_of = vr.ts join wraw on wraw.symbol = snap.symbol and wraw.week = snap.week),
      l as ({melt_sql('s0', 'week, symbol, ret', ['momentum_1w', 'momentum_3d', 'low_volatility', 'composite', 'random'])}),
      rr as (select week, feature, rank() over (partition by week, feature order by value) + (count(*) over (partition by week, feature, value) - 1) / 2.0 as x,
        rank() over (partition by week, feature order by ret) + (count(*) over (partition by week, feature, ret) - 1) / 2.0 as y from l),
      c as (select week, feature, corr(x, y) as ic from rr group by 1, 2
        having count(*) >= 10 and stddev_pop(x) > 0 and stddev_pop(y) > 0)
      select feature as baseline, {r('avg(ic)', 'mean_ic')}, {r('stddev_pop(ic)', 'std_ic')},
        {r('case when stddev_pop(ic) > 1e-8 then avg(ic) / stddev_pop(ic) else 0 end', 'icir')},
        {r('avg(case when ic > 1e-12 then 1.0 else 0.0 end) * 100', 'pct_positive')}, count(*) as n_weeks,
        row_number() over (order by avg(ic) desc, feature) = 1 as best from c group by 1""",
    "feature_ic_stats": f"""{_HIST} select feature, {r('avg(ic)', 'mean_ic')}, {r('stddev_pop(ic)', 'std_ic')}, count(*) as n_obs,
      {r('avg(case when ic > 0 then 1.0 else 0.0 end)', 'positive_ratio')} from hs group by 1""",
    "feature_ic_assessment": f"""{_HIST}, s as (select feature, count(*) as n, avg(ic) as m, avg(case when ic > 0 then 1.0 else 0.0 end) as p
        from hs group by 1)
      select feature, {r('m', 'mean_ic')}, case when m > 0.05 and p >= 0.7 then 'STRONG_POSITIVE'
        when m > 0 and p >= 0.5 then 'MODERATE_POSITIVE' when m > 0 then 'WEAK_POSITIVE' else 'NEGATIVE/NOISY' end as assessment,
        m > 0 and p >= 0.7 as consistent, p < 0.6 or n < 10 as noisy from s""",
    "feature_set_update": f"""{_HIST}, n as (select *, row_number() over (partition by feature order by week desc) as rn from hs),
      s as (select feature, count(*) as seen, count(*) filter (where ic < 0) as neg, count(*) filter (where ic > 0) as pos, avg(ic) as m
        from n where rn <= 4 group by 1),
      a as (select *, feature = 'ret_1h' and seen >= 3 and neg >= 3 as rm,
        feature in ('rev_1d', 'vol_ratio') and seen >= 2 and pos >= 2 as ad from s),
      k as (select *, row_number() over (order by ad desc, m desc, feature) as ar,
        sum(case when rm then 1 else 0 end) over () as nrm from a),
      z as (select feature, case when feature = 'rvol_1d' then 'CORE' when ad and ar <= 1 - nrm then 'ADDED' when rm then 'REMOVED'
        when feature = 'ret_1h' then 'KEPT' else 'OUT' end as status from k)
      select feature, status, status in ('CORE', 'ADDED', 'KEPT') as in_set from z""",
    "feature_set_overlap": f"""{_HIST}, s as (select date_trunc('quarter', week) as step, feature from hs group by 1, 2 having avg(ic) > 0),
      p as (select step, list(feature) as s from s group by 1), g as (select s, lag(s) over (order by step) as q from p)
      select {r('coalesce(avg(len(list_intersect(s, q))::double / len(list_distinct(list_concat(s, q)))), 1)', 'jaccard')} from g where q is not null""",
    "retrain_degradation": f"""{_HIST}, q as (select date_trunc('quarter', week) as q, feature, avg(ic) as i from hs group by 1, 2),
      n as (select *, lead(i) over (partition by feature order by q) as o from q)
      select count(*) as n_retrains, {r('avg(i)', 'avg_ic_in')}, {r('avg(o)', 'avg_ic_out')},
        {r('avg(case when i <> 0 then (i - o) / abs(i) end) * 100', 'avg_degradation_pct')} from n where o is not null""",
    "prediction_fit": f"""{_PANEL}, b as (select pred, ret, rvol_1d as w from preds join wret using (week, symbol) join snap using (week, symbol))
      select {r('1 - sum(w * pow(ret - pred, 2)) / sum(w * ret * ret)', 'weighted_r2')},
        {r('1 - sum(pow(ret - pred, 2)) / (var_pop(ret) * count(*))', 'r2')},
        {r('avg(case when (ret > 0) = (pred > 0) then 1.0 else 0.0 end) * 100', 'sign_accuracy_pct')} from b""",
    "regime_counts": f"with {BARS_D}, {_REG} select regime, count(*) as n from reg group by 1",
    "importance_ranks": f"""{_HIST}, i as (select regime as label, feature, avg(ic) as v from hs group by 1, 2)
      select label, feature, {r('v', 'importance')}, row_number() over (partition by label order by abs(v) desc, feature) as rank from i""",
}
from .weekly_queries import ORACLES as _WEEKLY_ORACLES  # noqa: E402

ORACLES["retrain_schedule"] = f"""select week, week_start, week_end, week % 4 = 0 as retrain,
  week > 1 and week % 2 = 0 as measure_ic from ({_WEEKLY_ORACLES['week_grid']})"""
