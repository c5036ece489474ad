import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import portfolio, reports, stability

WEEKS = [dt.datetime(2024, 1, 1) + dt.timedelta(weeks=i) for i in range(30)]


def weekly_frame(spark, rets, ics=None, regimes=None):
    n = len(rets)
    rows = [(WEEKS[i], float(rets[i]), float(rets[i]), 0.0, float(ics[i] if ics else 0.01), 50.0, 10,
             (regimes or ["LOW_VOL_GRIND"] * n)[i]) for i in range(n)]
    return spark.createDataFrame(
        rows, "week timestamp_ntz, week_ret double, long_ret double, short_ret double, ic double, "
              "turnover_pct double, n_symbols int, regime string")


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    rows = [(w, f"s{i:02d}", float(rng.normal(0.001, 0.003))) for w in WEEKS for i in range(16)]
    regimes = ["LOW_VOL_GRIND", "BULL_TREND", "BEAR_TREND", "HIGH_VOL_LATERAL"]
    return (spark.createDataFrame(rows, "week timestamp_ntz, symbol string, pred double"),
            spark.createDataFrame([(w, regimes[i // 3 % 4]) for i, w in enumerate(WEEKS)],
                                  "week timestamp_ntz, regime string"), rows)


def test_fee_adjusted_walk_matches_brute_force(panel):
    preds, regimes, rows = panel
    regime = {r["week"]: r["regime"] for r in regimes.collect()}
    held, want = set(), set()
    for w in WEEKS:
        score = {s: p - (0 if s in held else 0.002) for ww, s, p in rows if ww == w}
        raw = {s: p for ww, s, p in rows if ww == w}
        n = min(3, len(score) // 2)
        order = sorted(score, key=lambda s: (-score[s], s))
        longs = [s for s in order if raw[s] > 0][:n] if regime[w] in ("LOW_VOL_GRIND", "BULL_TREND") else []
        shorts = order[-n:] if regime[w] != "BULL_TREND" else []
        held = set(longs) | set(shorts)
        want |= {(w, s, "BUY") for s in longs} | {(w, s, "SELL") for s in shorts}
    got = portfolio.pick_fee_adjusted(preds, regimes, portfolio.Rules(top_n=3)).collect()
    assert {(r["week"], r["symbol"], r["side"]) for r in got} == want and len(got) == len(want)


def test_trades_and_week_results(panel, spark):
    preds, regimes, rows = panel
    picks = portfolio.pick(preds, regimes, portfolio.Rules(top_n=3, fee_adjusted=False))
    rets = preds.select("week", "symbol", (F.col("pred") * 100 - 0.2).alias("ret"))
    tr = portfolio.trades(picks, rets)
    assert tr.agg(F.min("pnl")).first()[0] >= -1.0
    res = portfolio.week_results(tr).toPandas().set_index("week")
    mean = tr.groupBy("week").agg(F.avg("pnl").alias("m")).toPandas().set_index("week")["m"]
    np.testing.assert_allclose(res["week_ret"], mean.loc[res.index])


def test_performance_by_hand(spark):
    rets = [0.05, -0.1, 0.03, 0.0, 0.08]
    ics = [0.1, -0.05, 0.02, 0.0, 0.04]
    row = reports.performance(weekly_frame(spark, rets, ics)).first()
    cum = np.cumprod(1 + np.array(rets))
    assert row["total_return"] == pytest.approx(cum[-1] - 1)
    assert row["sharpe"] == pytest.approx(np.mean(rets) / np.std(rets) * math.sqrt(52))
    assert row["max_drawdown"] == pytest.approx((cum / np.maximum.accumulate(cum) - 1).min())
    assert row["icir"] == pytest.approx(np.mean(ics) / (np.std(ics, ddof=1) + 1e-8))
    assert row["annualised"] == pytest.approx(cum[-1] ** (52 / 5) - 1)


def test_kill_switch_pauses_and_releases(spark):
    rets = [0.0, -0.15, -0.1] + [0.1] * 8
    got = portfolio.kill_switch(weekly_frame(spark, rets)).orderBy("week").toPandas()
    assert got["paused"].tolist() == [False] * 3 + [True] * 4 + [False] * 4
    assert got["week_ret"].tolist()[3:7] == [0.0] * 4


def test_pause_state_hysteresis(spark):
    values = [100, 90, 79, 85, 87, 89, 100, 70, 95]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "ts int, equity double")
    got = portfolio.pause_state(df).orderBy("ts").toPandas()["paused"].tolist()
    peak, paused, want = 0.0, False, []
    for v in values:
        dd = v / peak - 1 if peak > 0 else 0.0
        peak = max(peak, v)
        if dd <= -0.20 and not paused:
            paused = True
        elif paused and dd >= -0.12:
            paused = False
        want.append(paused)
    assert got == want


def test_tail_risk_and_stress(spark):
    rets = list(np.random.default_rng(2).normal(0, 0.02, 30))
    row = reports.tail_risk(weekly_frame(spark, rets)).first()
    var = np.percentile(rets, 5)
    assert row["var"] == pytest.approx(var)
    assert row["cvar"] == pytest.approx(np.mean([r for r in rets if r <= var]))


def test_gates_report_missing_baseline(spark):
    weekly = weekly_frame(spark, [0.01] * 4, [0.1] * 4, ["BULL_TREND"] * 2 + ["BEAR_TREND"] * 2)
    row = reports.kill_criteria(weekly, 0.7, None).first()
    assert row["ic_gate"] and row["regime_gate"] and row["baseline_gate"] is None and row["all_pass"] is None


def test_feature_update_budget(spark):
    rows = [(w, f, ic, "LOW_VOL_GRIND") for w in range(4) for f, ic in
            (("a", -0.1), ("b", -0.2), ("c", 0.3), ("d", 0.2), ("core", -0.5))]
    hist = spark.createDataFrame(rows, "week int, feature string, ic double, regime string")
    got = {r["feature"]: r["status"] for r in stability.propose_update(
        hist, ["core", "a", "b"], ["core"], ["c", "d"], max_turnover=3).collect()}
    assert got == {"core": "CORE", "a": "REMOVED", "b": "REMOVED", "c": "ADDED", "d": "OUT"}
    sets = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c")], "step int, feature string")
    assert stability.jaccard_overlap(sets).first()[0] == pytest.approx(1 / 3)


def test_open_then_close_account(spark):
    prices = spark.createDataFrame([("x", 10.0), ("y", 20.0)], "symbol string, price double")
    picks = spark.createDataFrame([("x", "LONG", 1.0), ("y", "SHORT", 1.0), ("z", "LONG", 1.0)],
                                  "symbol string, side string, scale double")
    opened = portfolio.open_positions(picks, prices, 3000.0)
    equity, want = 3000.0, []
    for s in ("x", "y"):
        size = equity / 3
        equity -= size * 0.0015
        want.append((s, size, equity))
    got = [(r["symbol"], r["size_usd"], r["equity_after"]) for r in opened.orderBy("symbol").collect()]
    for g, w in zip(got, want):
        assert g[0] == w[0] and g[1:] == pytest.approx(w[1:])
    later = spark.createDataFrame([("x", 11.0)], "symbol string, price double")
    closed = {r["symbol"]: r["gross_pnl"] for r in portfolio.close_positions(opened, later, equity).collect()}
    assert closed["x"] == pytest.approx(want[0][1] * 0.1) and closed["y"] == 0.0


def test_what_if_and_flags(spark):
    weekly = weekly_frame(spark, [0.1, -0.3, 0.2], [0.1, -0.1, 0.1], ["BULL_TREND", "BEAR_TREND", "BULL_TREND"])
    row = reports.what_if(weekly).first()
    assert row["bull_only"] == pytest.approx(1.1 * 1.2 - 1) == row["skip_bear"]
    trades = spark.createDataFrame([(6.0, -1.0)], "scale double, pnl double")
    assert set(reports.anomaly_flags(weekly, trades).first()["flags"]) == {
        "DRAWDOWN", "POSITION_SCALE", "TRADE_WIPEOUT"}
