"""Weekly long/short portfolios: selection, sizing, PnL, turnover, kill switch and risk."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import average_rank
from ..functions.scalars import ratio
from .regime import BEAR, BULL, HIGH_VOL, KILL_SWITCH, LOW_VOL

ROUND_TRIP_FEE = 0.002
SLIPPAGE = 0.0005
MAX_SCALE = 1.0
MIN_RVOL = 0.01
MIN_PREDICTIONS = 5


@dataclass(frozen=True)
class Rules:
    """Sides and size per regime: regime -> (long, short, scale)."""

    top_n: int = 5
    leverage: float = 1.0
    fee: float = ROUND_TRIP_FEE
    fee_adjusted: bool = True
    skip_high_vol: bool = False
    min_long_pred: float = 0.0
    momentum_filter: bool = False
    min_predictions: int = MIN_PREDICTIONS

    def sides(self) -> dict[str, tuple[bool, bool, float]]:
        high = (False, not self.skip_high_vol, 0.5)
        return {BEAR: (False, True, 1.0), BULL: (True, False, 0.5), HIGH_VOL: high,
                LOW_VOL: (True, True, 1.0)}


def _by_regime(rules: Rules, part: int) -> Column:
    out = F.lit(rules.sides()[LOW_VOL][part])
    for name, row in rules.sides().items():
        out = F.when(F.col("regime") == name, F.lit(row[part])).otherwise(out)
    return out


def eligible(preds: DataFrame, regimes: DataFrame, rules: Rules,
             ret_1w: DataFrame | None = None) -> DataFrame:
    """Predictions with the week's regime, the number ``_n`` to pick per side, and side eligibility."""
    # One regime row per week.
    df = preds.join(regimes.select("week", "regime"), "week", "left").withColumn(
        "regime", F.coalesce("regime", F.lit(LOW_VOL)))
    counts = preds.groupBy("week").agg(F.count(F.lit(1)).alias("_total"))
    df = df.join(counts, "week").where(F.col("_total") >= rules.min_predictions)
    df = df.withColumn("_n", F.least(F.lit(rules.top_n), F.floor(F.col("_total") / 2)))
    can_long = _by_regime(rules, 0) & (F.col("pred") > rules.min_long_pred)
    if rules.momentum_filter and ret_1w is not None:
        df = df.join(ret_1w.select("week", "symbol", "ret_1w"), ["week", "symbol"], "left")
        falling = F.coalesce(F.col("ret_1w") < 0, F.lit(False)) & (F.col("regime") == LOW_VOL)
        can_long = can_long & ~falling
    return df.withColumns({
        "_can_long": can_long, "_can_short": _by_regime(rules, 1),
        "_base": _by_regime(rules, 2) * rules.leverage,
    })


def pick(preds: DataFrame, regimes: DataFrame, rules: Rules = Rules(),
         ret_1w: DataFrame | None = None) -> DataFrame:
    """(week, symbol, pred, regime, side, base_scale) by plain prediction, best and worst n."""
    df = eligible(preds, regimes, rules, ret_1w)
    best = Window.partitionBy("week", "_can_long").orderBy(F.desc("pred"), "symbol")
    worst = Window.partitionBy("week").orderBy("pred", F.desc("symbol"))
    df = df.withColumns({
        "_up": F.col("_can_long") & (F.row_number().over(best) <= F.col("_n")),
        "_down": F.col("_can_short") & (F.row_number().over(worst) <= F.col("_n")),
    })
    sides = F.array_compact(F.array(F.when(F.col("_up"), F.lit("BUY")), F.when(F.col("_down"), F.lit("SELL"))))
    return df.select("week", "symbol", "pred", "regime", F.col("_base").alias("base_scale"),
                     F.explode(sides).alias("side"))


def pick_fee_adjusted(preds: DataFrame, regimes: DataFrame, rules: Rules = Rules(),
                      ret_1w: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """As ``pick``, but a name not held last week ranks ``fee`` lower.

    What is held depends on last week's pick, so weeks are walked in order. A fee can only lift a
    name past others within one fee of the n-th place: all other rows are cut first, by windows, and
    the walk sees the few names per week that can be picked.
    """
    by = list(by)
    portfolio = by or ["_portfolio"]
    df = eligible(preds if by else preds.withColumn("_portfolio", F.lit(0)), regimes, rules, ret_1w)
    best = Window.partitionBy(*portfolio, "week", "_can_long").orderBy(F.desc("pred"), "symbol")
    worst = Window.partitionBy(*portfolio, "week").orderBy("pred", F.desc("symbol"))
    df = df.withColumns({"_rb": F.row_number().over(best), "_rw": F.row_number().over(worst)})
    nth_best = F.min(F.when(F.col("_rb") <= F.col("_n"), F.col("pred"))).over(
        Window.partitionBy(*portfolio, "week", "_can_long"))
    nth_worst = F.max(F.when(F.col("_rw") <= F.col("_n"), F.col("pred"))).over(
        Window.partitionBy(*portfolio, "week"))
    slack = rules.fee * (1 + 1e-9) + 1e-12
    df = df.withColumns({
        "_up": F.col("_can_long") & (F.col("pred") >= nth_best - slack),
        "_down": F.col("_can_short") & (F.col("pred") <= nth_worst + slack),
    }).where(F.col("_up") | F.col("_down"))
    fee = rules.fee

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        held: set[str] = set()
        out = []
        for week, rows in pdf.sort_values("week", kind="stable").groupby("week", sort=True):
            score = rows["pred"] - fee * (~rows["symbol"].isin(held))
            rows = rows.assign(_score=score)
            n = int(rows["_n"].iloc[0])
            longs = rows[rows["_up"]].sort_values(["_score", "symbol"], ascending=[False, True]).head(n)
            shorts = rows[rows["_down"]].sort_values(["_score", "symbol"], ascending=[True, False]).head(n)
            held = set(longs["symbol"]) | set(shorts["symbol"])
            out += [longs.assign(side="BUY"), shorts.assign(side="SELL")]
        return pd.concat(out)[columns]

    columns = [*portfolio, "week", "symbol", "pred", "regime", "base_scale", "side"]
    src = df.select(*portfolio, "week", "symbol", "pred", "regime", F.col("_base").alias("base_scale"),
                    "_n", "_up", "_down")
    schema = ", ".join(f"`{c}` {dict(src.dtypes).get(c, 'string')}" for c in columns)
    return src.groupBy(*portfolio).applyInPandas(walk, schema).drop("_portfolio")


def pick_quantile(preds: DataFrame, quantile: float = 0.15, cap: float = 0.35,
                  short_only: bool = False) -> DataFrame:
    """(week, symbol, pred, side): adaptive top and bottom share of the week's rank."""
    n = F.count(F.lit(1)).over(Window.partitionBy("week"))
    df = preds.withColumns({"_n": n, "_rank": average_rank("pred", ["week"])})
    q = F.least(F.greatest(F.lit(quantile), 1.5 / F.col("_n")), F.lit(cap))
    pct = F.col("_rank") / F.col("_n")
    up = F.lit(False) if short_only else pct >= 1 - q
    sides = F.array_compact(F.array(F.when(up, F.lit("BUY")), F.when(pct <= q, F.lit("SELL"))))
    return df.select("week", "symbol", "pred", F.explode(sides).alias("side"))


def with_held(picks: DataFrame) -> DataFrame:
    """Add ``held``: the same side held the symbol in the last traded week before.

    Weeks without a book are skipped over: the book before them is still held. The window runs over
    one row for each week.
    """
    weeks = picks.select("week").distinct().withColumn("_next", F.lead("week").over(Window.orderBy("week")))
    before = picks.join(weeks, "week").select(
        F.col("_next").alias("week"), "symbol", "side", F.lit(True).alias("held")) \
        .where(F.col("week").isNotNull()).distinct()
    return picks.join(before, ["week", "symbol", "side"], "left").withColumn(
        "held", F.coalesce("held", F.lit(False)))


def position_scale(base: Column, rvol: Column, side: Column, cap_shorts: bool = False) -> Column:
    """Longs shrink with volatility and are capped; shorts take the base size."""
    scaled = F.when(rvol.isNotNull(), base / F.greatest(rvol, F.lit(MIN_RVOL))).otherwise(base)
    long_size = F.least(scaled, F.lit(MAX_SCALE))
    short_size = F.least(base, F.lit(MAX_SCALE)) if cap_shorts else base
    return F.when(side == "BUY", long_size).otherwise(short_size)


def trades(picks: DataFrame, rets: DataFrame, rvol: DataFrame | None = None,
           fee: float = ROUND_TRIP_FEE, cap_shorts: bool = False) -> DataFrame:
    """Fee for new positions, volatility sizing, loss floored at -1; one row per position."""
    df = with_held(picks).join(rets.select("week", "symbol", "ret"), ["week", "symbol"], "left")
    df = df.withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    if rvol is not None:
        df = df.join(rvol.select("week", "symbol", "rvol"), ["week", "symbol"], "left")
    else:
        df = df.withColumn("rvol", F.lit(None).cast("double"))
    signed = F.when(F.col("side") == "BUY", F.col("ret")).otherwise(-F.col("ret"))
    cost = F.when(F.col("held"), 0.0).otherwise(fee)
    df = df.withColumn(
        "scale", position_scale(F.col("base_scale"), F.col("rvol"), F.col("side"), cap_shorts))
    pnl = F.greatest((signed - cost) * F.col("scale"), F.lit(-1.0))
    return df.select("week", "symbol", "side", "regime", "pred", "ret", "held", "scale", pnl.alias("pnl"))


def confidence_trades(picks: DataFrame, rets: DataFrame, conf: DataFrame | None = None,
                      min_confidence: float = 0.0, leverage: float = 1.0,
                      fee: float = ROUND_TRIP_FEE) -> DataFrame:
    """Positions sized by clipped confidence (1 when unknown); those below the minimum are left out."""
    df = with_held(picks).join(rets.select("week", "symbol", "ret"), ["week", "symbol"], "left")
    df = df.withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    if conf is not None:
        df = df.join(conf.select("week", "symbol", "confidence"), ["week", "symbol"], "left")
    else:
        df = df.withColumn("confidence", F.lit(None).cast("double"))
    meta = F.least(F.greatest(F.coalesce("confidence", F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    signed = F.when(F.col("side") == "BUY", F.col("ret")).otherwise(-F.col("ret"))
    unit = signed - F.when(F.col("held"), 0.0).otherwise(fee)
    df = df.withColumn("_meta", meta).where(F.col("_meta") >= min_confidence)
    size = F.col("_meta") * leverage
    return df.select(
        "week", "symbol", "side", "pred", "ret", "held", size.alias("size"),
        (unit * size).alias("pnl"), F.when(size > 0, unit).otherwise(0.0).alias("unit_ret"))


def week_results(trades_: DataFrame, value: str = "pnl") -> DataFrame:
    """(week, n_trades, week_ret, long_ret, short_ret): plain means over positions and per side."""
    side = lambda s: F.coalesce(F.avg(F.when(F.col("side") == s, F.col(value))), F.lit(0.0))
    return trades_.groupBy("week").agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg(value).alias("week_ret"),
        side("BUY").alias("long_ret"), side("SELL").alias("short_ret"))


def turnover(picks: DataFrame) -> DataFrame:
    """(week, turnover_pct): share of this week's names not held on that side the week before."""
    flagged = with_held(picks)
    return flagged.groupBy("week").agg(
        (F.avg((~F.col("held")).cast("double")) * 100).alias("turnover_pct"))


def weekly_metrics(weeks: DataFrame, results: DataFrame, ic: DataFrame, turn: DataFrame,
                   regimes: DataFrame, n_symbols: DataFrame, annual_target: float = 0.10) -> DataFrame:
    """One row per week with compounding, drawdown and annualisation; weeks without trades return 0.

    A week table has at most a few thousand rows, so the running windows are unpartitioned.
    """
    df = (
        weeks.join(results, "week", "left").join(ic.select("week", "ic"), "week", "left")
        .join(turn, "week", "left").join(regimes, "week", "left").join(n_symbols, "week", "left")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    df = df.select(
        "week", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"),
        F.coalesce("n_trades", F.lit(0)).alias("n_trades"), zero("week_ret").alias("week_ret"),
        zero("long_ret").alias("long_ret"), zero("short_ret").alias("short_ret"), zero("ic").alias("ic"),
        F.coalesce("turnover_pct", F.lit(100.0)).alias("turnover_pct"),
        F.coalesce("regime", F.lit(LOW_VOL)).alias("regime"))
    weekly_goal = (1 + annual_target) ** (1 / 52) - 1
    return with_drawdown(df).withColumns({
        "annualised": F.pow(1 + F.col("cum_ret"), 52.0 / F.row_number().over(Window.orderBy("week"))) - 1,
        "on_track": F.col("week_ret") >= weekly_goal,
    })


def with_drawdown(weekly: DataFrame, ret: str = "week_ret", order: str = "week",
                  by: Sequence[str] = ()) -> DataFrame:
    """Add ``cum_ret``, ``drawdown`` and ``max_drawdown``; the peak starts at the first value."""
    run = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = weekly.withColumn("_cum", F.product(1 + F.col(ret)).over(run))
    df = df.withColumn("drawdown", F.col("_cum") / F.max("_cum").over(run) - 1)
    return df.withColumn("max_drawdown", F.min("drawdown").over(run)).withColumn(
        "cum_ret", F.col("_cum") - 1).drop("_cum")


def kill_switch(weekly: DataFrame, kill: float = -0.20, pause_weeks: int = 4) -> DataFrame:
    """(week, week_ret, paused, regime): returns after the kill switch.

    A week whose drawdown so far is below ``kill`` starts a pause of ``pause_weeks`` zero weeks, then
    the drawdown is measured afresh. The state depends on the altered returns, so the week table (a
    few hundred rows) is folded once as an array.
    """
    packed = weekly.agg(F.sort_array(F.collect_list(F.struct("week", "week_ret"))).alias("_w"))
    zero = F.lit(0.0)
    start = F.struct(
        F.lit(1.0).alias("cum"), F.lit(0.0).cast("double").alias("peak"), F.lit(0).alias("left"),
        F.array().cast("array<struct<week:timestamp_ntz,week_ret:double,paused:boolean>>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        dd = F.when(acc["peak"] > 0, acc["cum"] / acc["peak"] - 1).otherwise(zero)
        trip = (acc["left"] == 0) & (dd < kill)
        left = F.when(trip, F.lit(pause_weeks)).otherwise(acc["left"])
        paused = left > 0
        ret = F.when(paused, zero).otherwise(row["week_ret"])
        cum = acc["cum"] * (1 + ret)
        left_after = F.when(paused, left - 1).otherwise(F.lit(0))
        # After a pause the drawdown is measured afresh, so the switch can release.
        released = paused & (left_after == 0)
        peak = F.when(released, cum).otherwise(F.greatest(acc["peak"], cum))
        return F.struct(
            cum.alias("cum"), peak.alias("peak"), left_after.cast("int").alias("left"),
            F.concat(acc["out"], F.array(F.struct(
                row["week"].alias("week"), ret.alias("week_ret"), paused.alias("paused")))).alias("out"))

    folded = packed.select(F.aggregate("_w", start, step, lambda acc: acc["out"]).alias("_o"))
    return folded.select(F.inline("_o")).withColumn(
        "regime", F.when(F.col("paused"), F.lit(KILL_SWITCH)))


def pause_state(equity: DataFrame, pause: float = -0.20, resume: float = -0.12,
                order: str = "ts", value: str = "equity", by: Sequence[str] = ()) -> DataFrame:
    """Add ``drawdown`` and ``paused`` with hysteresis.

    Between the two thresholds the state is that of the newest row beyond either of them, which is a
    running last(): no fold needed.
    """
    w = Window.partitionBy(*by).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    peak = F.coalesce(F.max(value).over(prior), F.col(value))
    df = equity.withColumn("drawdown", F.when(peak > 0, F.col(value) / peak - 1).otherwise(0.0))
    mark = F.when(F.col("drawdown") <= pause, True).when(F.col("drawdown") >= resume, False)
    return df.withColumn("_mark", mark).withColumn(
        "paused", F.coalesce(F.last("_mark", ignorenulls=True).over(run), F.lit(False))).drop("_mark")


def cap_weights(weights: DataFrame, max_weight: float = 0.2, min_weight: float = 0.0,
                by: str = "portfolio", weight: str = "weight") -> DataFrame:
    """Clip weights and rescale each portfolio to one."""
    clipped = weights.withColumn(
        weight, F.least(F.greatest(F.col(weight), F.lit(min_weight)), F.lit(max_weight)))
    total = F.sum(weight).over(Window.partitionBy(by))
    return clipped.withColumn(weight, ratio(F.col(weight), total))


# --- paper account -------------------------------------------------------------------------------

def _gross(size: Column, side: Column, entry: Column, mark: Column) -> Column:
    move = mark / entry - 1.0
    return size * F.when(side == "LONG", move).otherwise(-move)


def mark_to_market(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Unrealised PnL per open position; 0 where no usable price is known."""
    df = positions.join(prices, "symbol", "left")
    known = F.coalesce(F.col("price") > 0, F.lit(False))
    pnl = F.when(known, _gross(F.col("size_usd"), F.col("side"), F.col("entry_price"), F.col("price")))
    return df.withColumn("unrealised", F.coalesce(pnl, F.lit(0.0)))


def close_positions(positions: DataFrame, prices: DataFrame, equity: float,
                    fee: float = ROUND_TRIP_FEE, slippage: float = SLIPPAGE) -> DataFrame:
    """Closing trades with fees and the running equity; without a price, at entry."""
    df = positions.join(prices, "symbol", "left")
    known = F.coalesce(F.col("price") > 0, F.lit(False))
    df = df.withColumn("exit_price", F.when(known, F.col("price")).otherwise(F.col("entry_price")))
    gross = _gross(F.col("size_usd"), F.col("side"), F.col("entry_price"), F.col("exit_price"))
    cost = F.col("size_usd") * (fee / 2 + slippage)
    run = Window.orderBy("symbol").rowsBetween(Window.unboundedPreceding, 0)  # tens of positions
    return df.withColumns({"gross_pnl": gross, "fees_slippage": cost, "net_pnl": gross - cost}) \
        .withColumn("equity_after", F.lit(equity) + F.sum("net_pnl").over(run)) \
        .select("symbol", "side", "entry_price", "exit_price", "size_usd", "gross_pnl",
                "fees_slippage", "net_pnl", "equity_after")


def open_positions(picks: DataFrame, prices: DataFrame, equity: float,
                   fee: float = ROUND_TRIP_FEE, slippage: float = SLIPPAGE,
                   min_usd: float = 1.0) -> DataFrame:
    """Opening trades: equity split by scale over max(total scale, 1), each cost paid before the next.

    A pick's share is taken from what earlier picks' costs left, so equity is a running product.
    """
    everything = Window.partitionBy()
    cost_rate = fee / 2 + slippage
    total = F.sum("scale").over(everything)
    df = picks.withColumn("_total", total).where(F.col("_total") > 0)
    df = df.join(prices, "symbol").where(F.col("price") > 0)
    share = F.col("scale") / F.greatest(F.col("_total"), F.lit(1.0))
    df = df.withColumn("_share", share)
    run = Window.orderBy("symbol").rowsBetween(Window.unboundedPreceding, 0)
    left = F.product(1 - F.col("_share") * cost_rate).over(run) * equity
    before = left / (1 - F.col("_share") * cost_rate)
    df = df.withColumns({"equity_after": left, "size_usd": before * F.col("_share")})
    return df.where(F.col("size_usd") > min_usd).select(
        "symbol", "side", F.col("price").alias("entry_price"), "size_usd", "scale",
        (F.col("size_usd") * cost_rate).alias("fees_slippage"), "equity_after")
