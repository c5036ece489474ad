import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import series
from barloom.operators.features import FEATURES, build_features
from barloom.operators.targets import forward_returns
from barloom.spec import BarSpec, is_five_minute, target_plan, timeframe_minutes

SPEC = BarSpec(4, 24, 15)
SOME = ["ret_1h", "rsi_14", "macd_hist", "adx_14", "atr_norm", "obv_change", "rvol_1d", "kurt_1d",
        "wq_alpha031", "vol_regime", "qrank_ret_1h", "hurst_exp", "fft_strength", "frac_diff_close",
        "stoch_d", "cci_14", "vwap_dev", "corr_btc_proxy"]


def frame(df):
    return df.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def whole(bars):
    return frame(build_features(bars, SPEC, SOME, ffd_threshold=1e-2))


def test_table_is_complete():
    assert len(FEATURES) == 72 and len(set(FEATURES)) == 72


def test_chunked_series_equal_whole_series(bars, whole):
    cut = frame(build_features(bars, SPEC, SOME, ffd_threshold=1e-2, chunk_rows=250, block_rows=350))
    assert len(cut) == len(whole)
    for name in SOME:
        a, b = whole[name].to_numpy(float), cut[name].to_numpy(float)
        assert (np.isnan(a) == np.isnan(b)).all(), name
        np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-9, equal_nan=True, err_msg=name)


def test_spreads_after_a_change_of_level(spark):
    """A series near 60,000 that collapses, trades around 1, then halts: each frame sees its own rows only."""
    rng = np.random.default_rng(9)
    close = np.concatenate([60_000 * np.exp(np.cumsum(rng.normal(0, 1e-3, 1500))), 1 + rng.normal(0, 1e-3, 300), np.full(200, 1.25)])
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=len(close), freq="h"), "close": close})
    for c in ("open", "high", "low"):
        pdf[c] = pdf["close"]
    pdf["volume"] = np.where(np.arange(len(close)) < 1500, 1e9, 3.0)
    bars = spark.createDataFrame(pdf[["symbol", "ts", "open", "high", "low", "close", "volume"]],
                                 "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    got = frame(build_features(bars, SPEC, ["bb_pos", "bb_width", "mean_rev_zscore_4h", "rvol_1d"]))

    def rolled(x, n, least, how):
        out = np.full(len(x), np.nan)
        for i in range(len(x)):
            w = x[max(0, i - n + 1):i + 1]
            w = w[~np.isnan(w)]
            if len(w) >= least and len(w) > 1:
                out[i] = 0.0 if how == "std" and np.ptp(w) == 0 else getattr(np, how)(w) if how == "mean" else np.std(w, ddof=1)
        return out

    mid, sd = rolled(close, 20, 10, "mean"), rolled(close, 20, 10, "std") * np.sqrt(19 / 20)
    flat = np.r_[[np.nan], sd[:-1]] == 0
    assert flat.sum() > 150 and np.isnan(got["bb_pos"].to_numpy(float)[flat]).all()
    width = np.r_[[np.nan], (4 * sd / mid)[:-1]]
    seen = slice(30, None)
    np.testing.assert_allclose(np.nan_to_num(got["bb_width"].to_numpy(float)[seen]), np.nan_to_num(width[seen]), rtol=1e-7, atol=1e-12)
    lr = np.r_[[np.nan], np.diff(np.log(close))]
    np.testing.assert_allclose(got["rvol_1d"].to_numpy(float)[seen], np.r_[[np.nan], rolled(lr, 24, 4, "std")[:-1]][seen], rtol=1e-7, atol=1e-13)


def test_against_pandas(bars, whole):
    raw = frame(bars)
    for sym, g in raw.groupby("symbol"):
        got = whole[whole["symbol"] == sym]
        c = g["close"].reset_index(drop=True)
        step = c.diff()
        gain = step.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()
        loss = (-step).clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()
        line = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
        lr = np.log(c).diff()
        want = {
            "rsi_14": 1 - 1 / (1 + gain / loss.replace(0, np.nan)),
            "macd_hist": (line - line.ewm(span=9, adjust=False).mean()) / c,
            "rvol_1d": lr.rolling(24, min_periods=4).std(),
            "kurt_1d": lr.rolling(24, min_periods=4).kurt(),
            "qrank_ret_1h": np.log(c / c.shift(4)).rolling(120, min_periods=24).rank(pct=True),
        }
        for name, value in want.items():
            np.testing.assert_allclose(
                got[name].to_numpy(float), value.shift(1).to_numpy(float), rtol=1e-8, atol=1e-10,
                equal_nan=True, err_msg=f"{sym} {name}")


def test_no_bar_sees_itself_or_the_future(spark, bars):
    names = [f for f in FEATURES if f != "wq_alpha031"]
    cut = F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))
    wild = bars.withColumns({c: F.when(F.col("ts") >= cut, F.col(c) * 3 + 1).otherwise(F.col(c))
                             for c in ("open", "high", "low", "close", "volume")})
    keep = F.col("ts") <= cut
    a = frame(build_features(bars, SPEC, names, keep=(), ffd_threshold=1e-2).where(keep))
    b = frame(build_features(wild, SPEC, names, keep=(), ffd_threshold=1e-2).where(keep))
    for name in names:
        np.testing.assert_allclose(a[name].to_numpy(float), b[name].to_numpy(float), rtol=1e-9,
                                   atol=1e-12, equal_nan=True, err_msg=name)


def test_targets_in_chunks(bars):
    a = frame(forward_returns(bars, {"r3": 3, "r40": 40}))
    b = frame(forward_returns(bars, {"r3": 3, "r40": 40}, chunk_rows=100))
    assert len(a) == len(b)
    for n in ("r3", "r40"):
        np.testing.assert_allclose(a[n].to_numpy(float), b[n].to_numpy(float), equal_nan=True)


def test_unknown_feature_is_refused(bars):
    with pytest.raises(ValueError):
        build_features(bars, SPEC, ["nope"])


def test_fractional_weights_and_kernels():
    w = series.fractional_weights(0.4, 1e-5)
    assert len(w) == 1458 and w[1] == pytest.approx(-0.4)
    x = np.arange(30.0)
    x[10] = np.nan
    out = series.fractional_difference(x, np.array([1.0, -1.0]))
    assert np.isnan(out[[0, 10, 11]]).all() and np.allclose(np.delete(out, [0, 10, 11]), 1.0)
    y = np.random.default_rng(1).normal(size=50).cumsum() + 100
    seg = y[20:30]
    dev = np.cumsum(seg - seg.mean())
    assert series.rescaled_range(y, 10)[30] == pytest.approx((dev.max() - dev.min()) / seg.std())


def test_bar_spec():
    assert BarSpec.from_timeframe("5min") == BarSpec(12, 288)
    four = BarSpec.from_timeframe("4h")
    assert (four.bars_per_hour, four.bars_per_day, four.four_hour_bars) == (1, 6, 1)
    assert BarSpec.from_timeframe("w-mon").bars_per_day == 1
    assert timeframe_minutes("45min") == 45 and timeframe_minutes("odd") == 5
    assert is_five_minute("5T") and not is_five_minute("1h")
    assert BarSpec().horizons["future_ret_15m"] == 3
    assert target_plan("1d", ["future_ret"])["column"] == "future_ret"


def test_bars_with_a_zero_low_are_missing_or_unbounded(spark):
    rows = [("a", f"2024-01-01 {i:02d}:00:00", 2.0, 3.0, 0.0 if i == 10 else 1.0, 2.0, 5.0) for i in range(24)]
    bars = spark.createDataFrame(rows, "symbol string, ts string, open double, high double, low double, close double, volume double") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    names = ["parkinson_vol", "garman_klass"]
    made = [{r.ts.hour: r for r in build_features(bars, BarSpec(1, 4, 1), names, unbounded_ranges=u).collect()} for u in (False, True)]
    for hour in range(5, 24):
        for name in names:
            plain, unbounded = (m[hour][name] for m in made)
            assert plain < 10 and unbounded == (float("inf") if 11 <= hour <= 14 else plain)
