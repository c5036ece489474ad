"""Performance reports over weekly metrics, trades and importances (small tables, one pass each)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import average_rank, plain_corr, quantiles
from ..functions.scalars import ratio
from .portfolio import with_drawdown
from .regime import BEAR, BULL, IC_GATED, KILL_SWITCH

WEEKS_PER_YEAR = 52
MARKERS = (KILL_SWITCH, IC_GATED)


def sharpe(ret: str | Column) -> Column:
    """Mean over population deviation, annualised; 0 for a flat series."""
    return F.coalesce(ratio(F.avg(ret), F.stddev_pop(ret)) * WEEKS_PER_YEAR ** 0.5, F.lit(0.0))


def share(cond: Column) -> Column:
    return F.avg(cond.cast("double")) * 100


def compounded(ret: str | Column) -> Column:
    r = F.col(ret) if isinstance(ret, str) else ret
    return F.coalesce(F.product(1 + r), F.lit(1.0)) - 1


def performance(weekly: DataFrame) -> DataFrame:
    """One row: total and annualised return, Sharpe, drawdown, IC, turnover, side sums.

    ``weekly`` needs week, week_ret, long_ret, short_ret, ic, turnover_pct, regime.
    """
    live = ~F.col("regime").isin(KILL_SWITCH)
    one = with_drawdown(weekly).agg(
        F.count(F.lit(1)).alias("n_weeks"), compounded("week_ret").alias("total_return"),
        sharpe("week_ret").alias("sharpe"), F.min("drawdown").alias("max_drawdown"),
        F.avg("ic").alias("ic_mean"), (F.avg("ic") / (F.stddev_samp("ic") + 1e-8)).alias("icir"),
        share(F.col("ic") > 0).alias("ic_positive_pct"), share(F.col("week_ret") > 0).alias("positive_weeks_pct"),
        F.max("week_ret").alias("best_week"), F.min("week_ret").alias("worst_week"),
        F.avg("turnover_pct").alias("avg_turnover_pct"),
        F.sum(F.when(live, F.col("long_ret"))).alias("long_sum"),
        F.sum(F.when(live, F.col("short_ret"))).alias("short_sum"))
    return one.withColumn("annualised", annualised("total_return", "n_weeks"))


def annualised(total: str, n_weeks: str) -> Column:
    return F.pow(1 + F.col(total), WEEKS_PER_YEAR / F.greatest(F.col(n_weeks), F.lit(1))) - 1


def tail_risk(weekly: DataFrame, confidence: float = 0.95, ret: str = "week_ret",
              by: Sequence[str] = ()) -> DataFrame:
    """Historical VaR (interpolated percentile) and CVaR (mean at or below it), per ``by``."""
    cut = quantiles(weekly, ret, [1 - confidence], by).select(*by, F.col("q")[0].alias("var"))
    joined = weekly.join(cut, list(by)) if by else weekly.withColumn("var", cut.select("var").scalar())
    return joined.groupBy(*by).agg(
        F.first("var").alias("var"), F.avg(F.when(F.col(ret) <= F.col("var"), F.col(ret))).alias("cvar"))


def liquidity_stress(weekly: DataFrame, quantile: float = 0.2) -> DataFrame:
    """Sharpe over the weeks with the fewest symbols."""
    cut = quantiles(weekly, "n_symbols", [quantile]).select(F.col("q")[0]).scalar()
    return weekly.where(F.col("n_symbols") <= cut).agg(
        F.count(F.lit(1)).alias("n_weeks"), sharpe("week_ret").alias("stress_sharpe"))


def regime_breakdown(weekly: DataFrame) -> DataFrame:
    """Per regime: weeks, returns, IC, side sums and win rate; marker weeks left out."""
    live = weekly.where(~F.col("regime").isin(*MARKERS))
    return live.groupBy("regime").agg(
        F.count(F.lit(1)).alias("n_weeks"), F.avg("week_ret").alias("mean_ret"),
        F.sum("week_ret").alias("total_ret"), F.stddev_pop("week_ret").alias("std_ret"),
        F.avg("ic").alias("mean_ic"), F.sum("long_ret").alias("long_sum"),
        F.sum("short_ret").alias("short_sum"), share(F.col("week_ret") > 0).alias("win_rate_pct"))


def side_summary(trades: DataFrame) -> DataFrame:
    """Per side: trades, mean PnL and win rate."""
    return trades.groupBy("side").agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg("pnl").alias("mean_pnl"),
        share(F.col("pnl") > 0).alias("win_rate_pct"))


def symbol_concentration(trades: DataFrame) -> DataFrame:
    counts = trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.sum("n").alias("total_trades"), F.avg("n").alias("avg_per_symbol"),
        F.max("n").alias("max_single_symbol"), F.count(F.lit(1)).alias("unique_symbols"))


def top_symbols(trades: DataFrame, k: int = 10) -> DataFrame:
    return trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "symbol").limit(k)


def feature_ic_stats(history: DataFrame, k: int | None = 10) -> DataFrame:
    """Per feature: mean, deviation, count and positive share of its ICs; best mean first."""
    stats = history.groupBy("feature").agg(
        F.avg("ic").alias("mean_ic"), F.stddev_pop("ic").alias("std_ic"),
        F.count(F.lit(1)).alias("n_obs"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_ratio"))
    return stats.orderBy(F.desc("mean_ic"), "feature").limit(k) if k else stats


def ic_assessment(history: DataFrame) -> DataFrame:
    """Label each feature by its mean IC and the share of positive ICs; consistent and noisy flags."""
    mean, positive = F.col("mean_ic"), F.col("positive_ratio")
    label = (
        F.when((mean > 0.05) & (positive >= 0.7), "STRONG_POSITIVE")
        .when((mean > 0) & (positive >= 0.5), "MODERATE_POSITIVE")
        .when(mean > 0, "WEAK_POSITIVE").otherwise("NEGATIVE/NOISY")
    )
    return feature_ic_stats(history, None).withColumns({
        "assessment": label, "consistent": (mean > 0) & (positive >= 0.7),
        "noisy": (positive < 0.6) | (F.col("n_obs") < 10)})


def retrain_degradation(retrains: DataFrame) -> DataFrame:
    gap = F.when(F.col("ic_in") != 0, (F.col("ic_in") - F.col("ic_out")) / F.abs("ic_in"))
    return retrains.agg(
        F.count(F.lit(1)).alias("n_retrains"), F.avg("ic_in").alias("avg_ic_in"),
        F.avg("ic_out").alias("avg_ic_out"), (F.avg(gap) * 100).alias("avg_degradation_pct"))


def what_if(weekly: DataFrame) -> DataFrame:
    """One row of alternative histories, all compounded in one pass."""
    ret = F.col("week_ret")
    only = lambda cond, r=ret: compounded(F.when(cond, r).otherwise(0.0))
    return weekly.agg(
        compounded("week_ret").alias("actual"), only(F.col("regime") == BULL).alias("bull_only"),
        compounded("short_ret").alias("shorts_only"),
        only(F.col("regime") != BEAR).alias("skip_bear"), only(F.col("ic") > 0).alias("positive_ic_only"))


def anomaly_flags(weekly: DataFrame, trades: DataFrame) -> DataFrame:
    """One row: the list of implausible findings of a run."""
    run = with_drawdown(weekly).agg(
        F.max((F.col("regime") == KILL_SWITCH).cast("int")).alias("kill"),
        F.min("drawdown").alias("dd"), sharpe("week_ret").alias("sharpe"),
        F.max(F.abs("week_ret")).alias("week"))
    extreme = trades.agg(F.struct(F.max("scale").alias("scale"), F.min("pnl").alias("pnl"))).scalar()
    run = run.withColumn("_t", extreme)
    named = [
        ("KILL_SWITCH_HIT", F.col("kill") == 1), ("DRAWDOWN", F.col("dd") < -0.20),
        ("SHARPE", F.col("sharpe") > 10), ("WEEK_RETURN", F.col("week") > 1.0),
        ("POSITION_SCALE", F.col("_t.scale") > 5), ("TRADE_WIPEOUT", F.col("_t.pnl") <= -1.0)]
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named]))
    return run.select(flags.alias("flags"), F.size(flags).alias("n_flags"))


def overall_return(row: DataFrame, keys: Sequence[str], weekly: DataFrame | None = None) -> DataFrame:
    """First of the named values that is present; else what the weeks say.

    ``weekly`` (week, cum_return_pct, week_return_pct, either may be absent): the newest running
    return, or the weekly ones compounded.
    """
    have = [F.col(k).try_cast("double") for k in keys if k in row.columns]
    if weekly is not None and "cum_return_pct" in weekly.columns:
        cum = F.col("cum_return_pct").try_cast("double")
        have.append(weekly.agg(F.max_by(cum, F.when(cum.isNotNull(), F.col("week")))).scalar())
    if weekly is not None and "week_return_pct" in weekly.columns:
        ret = F.col("week_return_pct").try_cast("double")
        have.append(weekly.agg(F.when(F.count(ret) > 0, (F.product(1 + ret / 100) - 1) * 100)).scalar())
    return row.select(F.coalesce(*have, F.lit(None).cast("double")).alias("overall_return_pct"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def win_rates(trades: DataFrame) -> DataFrame:
    """(week, win_rate_pct, profit_factor): gains over losses, NULL without losses."""
    gain = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0))
    loss = F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(0.0))
    return trades.groupBy("week").agg(
        share(F.col("pnl") > 0).alias("win_rate_pct"), ratio(gain, loss).alias("profit_factor"))


def rolling_sharpe(weekly: DataFrame, weeks: int = 4) -> DataFrame:
    """Sharpe of the last ``weeks`` (fewer at the start), 0 where flat."""
    w = Window.orderBy("week").rowsBetween(-(weeks - 1), 0)
    value = ratio(F.avg("week_ret").over(w), F.stddev_pop("week_ret").over(w)) * WEEKS_PER_YEAR ** 0.5
    return weekly.select("week", F.coalesce(value, F.lit(0.0)).alias("rolling_sharpe"))


def kill_criteria(weekly: DataFrame, jaccard: float, best_baseline_ic: float | None) -> DataFrame:
    """One row with the four gates; the baseline gate is NULL when no baseline was run."""
    live = weekly.where(~F.col("regime").isin(*MARKERS))
    per_regime = live.groupBy("regime").agg(F.avg("week_ret").alias("m")).agg(
        F.count_if(F.col("m") > 0)).scalar()
    one = live.agg(F.avg("ic").alias("ic_mean"), share(F.col("ic") > 0).alias("ic_positive_pct")).withColumn(
        "n_positive_regimes", per_regime)
    beats = F.lit(None).cast("boolean") if best_baseline_ic is None else F.col("ic_mean") > best_baseline_ic
    out = one.withColumns({
        "ic_gate": (F.col("ic_mean") > 0) & (F.col("ic_positive_pct") > 50),
        "stability_gate": F.lit(jaccard > 0.5), "regime_gate": F.col("n_positive_regimes") >= 2,
        "baseline_gate": beats})
    return out.withColumn(
        "all_pass", F.col("ic_gate") & F.col("stability_gate") & F.col("regime_gate") & F.col("baseline_gate"))


def weighted_r2(df: DataFrame, y: str, pred: str, weight: str | None = None) -> DataFrame:
    """One row: weighted and plain R2, and sign accuracy."""
    w = F.col(weight) if weight else F.lit(1.0)
    err, sq = F.pow(F.col(y) - F.col(pred), F.lit(2.0)), F.pow(F.col(y), F.lit(2.0))
    same = (F.col(y) > 0) == (F.col(pred) > 0)
    return df.agg(
        (1 - ratio(F.sum(w * err), F.sum(w * sq))).alias("weighted_r2"),
        (1 - ratio(F.sum(err), F.var_pop(y) * F.count(y))).alias("r2"),
        share(same).alias("sign_accuracy_pct"))


def importance_ranks(importances: DataFrame, by: str = "label", value: str = "importance") -> DataFrame:
    """Rank features by absolute value inside each label."""
    w = Window.partitionBy(by).orderBy(F.desc(F.abs(value)), "feature")
    return importances.withColumn("rank", F.row_number().over(w).cast("long"))


def baselines(snap: DataFrame, rets: DataFrame, min_symbols: int = 10, seed: int = 42) -> DataFrame:
    """(baseline, mean_ic, std_ic, icir, pct_positive, n_weeks, best) of simple signals.

    Weeks without a defined IC are left out. ``rets`` should hold returns as they are, extreme ones
    included. The composite is the mean of the present ones among both momenta and the volatility.
    """
    from .matrix import hash_fraction, hash_text

    zero = lambda c: F.coalesce(c, F.lit(0.0))
    parts = ["ret_1w", "ret_3d", "vol_regime"]
    present = sum(F.col(c).isNotNull().cast("int") for c in parts)
    noise = hash_fraction(hash_text(seed, ["symbol", "_w"]))
    sig = snap.withColumn("_w", F.date_format("week", "yyyy-MM-dd")).select(
        "week", "symbol", zero("ret_1w").alias("momentum_1w"), zero("ret_3d").alias("momentum_3d"),
        zero(-F.col("vol_regime")).alias("low_volatility"),
        zero(ratio(sum(zero(c) for c in parts), present)).alias("composite"), noise.alias("random"))
    names = ["momentum_1w", "momentum_3d", "low_volatility", "composite", "random"]
    joined = sig.join(rets.select("week", "symbol", "ret"), ["week", "symbol"])
    long = joined.unpivot(["week", "symbol", "ret"], names, "baseline", "value")
    ranked = long.withColumns({"_x": average_rank("value", ["week", "baseline"]),
                               "_y": average_rank("ret", ["week", "baseline"])})
    ics = ranked.groupBy("week", "baseline").agg(
        F.count(F.lit(1)).alias("n"), plain_corr("_x", "_y").alias("ic")) \
        .where((F.col("n") >= min_symbols) & F.col("ic").isNotNull())
    spread = F.stddev_pop("ic")
    out = ics.groupBy("baseline").agg(
        F.avg("ic").alias("mean_ic"), spread.alias("std_ic"),
        F.when(spread > 1e-8, ratio(F.avg("ic"), spread)).otherwise(0.0).alias("icir"),
        share(F.col("ic") > 1e-12).alias("pct_positive"), F.count(F.lit(1)).alias("n_weeks"))
    first = F.row_number().over(Window.orderBy(F.desc("mean_ic"), "baseline"))  # five rows
    return out.withColumn("best", first == 1)


def nested_report(weekly: DataFrame, trades: DataFrame, history: DataFrame) -> DataFrame:
    """The whole report as one struct row: scalars, regime map, feature map, traded-symbol list."""
    def as_map(df: DataFrame, key: str) -> Column:
        others = [c for c in df.columns if c != key]
        entries = F.sort_array(F.collect_list(F.struct(F.col(key), F.struct(*others))))
        return df.agg(F.map_from_entries(entries)).scalar()

    top = top_symbols(trades)
    listed = top.agg(F.sort_array(F.collect_list(F.struct("n", "symbol")), asc=False)).scalar()
    return performance(weekly).withColumns({
        "regimes": as_map(regime_breakdown(weekly), "regime"),
        "features": as_map(feature_ic_stats(history), "feature"), "top_traded": listed})
