import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import models, universe
from barloom.plans import catalog
from barloom.sources import bars as source
from barloom.sources import runs as store
from barloom.streaming import live


def test_symbol_files_and_broken_epochs(spark, tmp_path):
    ts = pd.date_range("2024-01-01", periods=60, freq="5min")
    ms = (ts - pd.Timestamp(0)) // pd.Timedelta("1ms")
    base = {c: np.arange(60.0) for c in ("Open", "High", "Low", "Close", "Volume")}
    pd.DataFrame({"Open_Time": ms, **base}).to_parquet(tmp_path / "AAAUSDT.parquet")
    pd.DataFrame({"Open_Time": np.arange(60), **base}).to_parquet(tmp_path / "OLDUSDT.parquet")
    got = source.read_symbol_files(spark, str(tmp_path))
    assert [r[0] for r in got.select("symbol").distinct().collect()] == ["AAAUSDT"]
    assert got.agg(F.min("ts")).first()[0] == ts[0].to_pydatetime()
    with pytest.raises(Exception):
        source.read_symbol_files(spark, str(tmp_path / "nowhere")).count()
    with pytest.raises(ValueError):
        source.symbol_metadata(got, ["vwap"])


def test_universe_rules(spark):
    df = spark.createDataFrame([(s,) for s in (" btcusdt", "USDCUSDT", "daiusdt", "FTTUSDT", "DAIX")], "symbol string")
    assert {r[0].strip() for r in universe.tradeable(df).collect()} == {"btcusdt", "DAIX"}


def test_feature_store_replaces_only_given_symbols(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("a", dt.datetime(2024, 1, 1), 1.0), ("b", dt.datetime(2024, 1, 1), 2.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double")
    source.write_features(df, path)
    source.write_features(df.where("symbol = 'a'").withColumn("x", F.lit(9.0)), path)
    assert {(r["symbol"], r["x"]) for r in source.read_features(spark, path).collect()} == {("a", 9.0), ("b", 2.0)}


def test_run_store(spark, tmp_path):
    db = store.RunStore(spark, str(tmp_path))
    assert db.list_runs().count() == 0
    db.start_run("r1", json.dumps({"top_n": 5}))
    db.start_run("r2")
    week = spark.createDataFrame([("r1", 2, 0.5), ("r1", 1, 0.1)], "run_id string, week long, ic double")
    db.insert("weekly_metrics", week)
    db.insert("feature_ic", spark.createDataFrame(
        [("r1", w, "f", 0.1) for w in range(1, 11)], "run_id string, week long, feature string, ic double"))
    db.insert("shap_values", spark.createDataFrame(
        [("r1", "base", "g", 0.2, 2), ("r1", "base", "f", 0.9, 1)],
        "run_id string, label string, feature string, mean_abs_shap double, rank long"))
    for value in (1.0, 2.0):
        db.insert("performance_summary", spark.createDataFrame(
            [("r1", value)], "run_id string, total_return_pct double"))
    db.finish_run("r1")
    assert [r["week"] for r in db.weekly_metrics("r1").collect()] == [1, 2]
    assert [r["feature"] for r in db.shap("r1", "base").collect()] == ["f", "g"]
    assert sorted(r["week"] for r in db.feature_ic("r1", 3).collect()) == [7, 8, 9, 10]
    listed = {r["run_id"]: (r["status"], r["total_return_pct"]) for r in db.list_runs().collect()}
    assert listed == {"r1": ("completed", 2.0), "r2": ("running", None)}
    left = store.pending_weeks(spark.range(1, 4).select(F.col("id").alias("week")), db.done_weeks("r1"))
    assert [r["week"] for r in left.collect()] == [3]


def test_result_files(spark, tmp_path):
    schema = "week long, ic double"
    assert store.read_result(spark, str(tmp_path / "none.csv"), schema).count() == 0
    df = spark.createDataFrame([(1, 0.5)], schema)
    store.write_csv(df, str(tmp_path / "w"))
    assert store.read_result(spark, str(tmp_path / "w"), schema).collect() == df.collect()
    store.write_json_report(df, str(tmp_path / "j"))
    assert store.read_result(spark, str(tmp_path / "j"), schema, "json").collect() == df.collect()
    for name in ("imp_week001.csv", "imp_week012.csv"):
        (tmp_path / name).write_text(f"feature,importance\n{name},1.0\n")
    rows = store.latest_file_rows(spark.read.option("header", True).csv(str(tmp_path / "imp_week*.csv")))
    assert [r["feature"] for r in rows.collect()] == ["imp_week012.csv"]


def test_fold_bounds():
    assert models.fold_bounds(100, 4, 5, False) == [(20, 25, 45), (40, 45, 65), (60, 65, 85)]
    for end, lo, hi in models.fold_bounds(1000, 5, 10):
        assert lo - end == 10 and hi <= 1000
    with pytest.raises(ValueError):
        models.fold_bounds(100, 5, 48)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(7)
    n = 1500
    x, noise = rng.normal(size=n), rng.normal(size=n)
    pdf = pd.DataFrame({"symbol": [f"s{i % 5}" for i in range(n)],
                        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) // 5, unit="h"),
                        "x": x, "noise": noise, "y": 0.5 * x + rng.normal(size=n)})
    return spark.createDataFrame(pdf, "symbol string, ts timestamp_ntz, x double, noise double, y double")


def test_models_find_a_planted_signal(planted):
    small = models.TreeParams(trees=8, rate=0.3, min_leaf=10)
    model, cv = models.train_trees(planted, ["x", "noise"], "y", small, 2, 10)
    assert cv["ic"] > 0.2 and models.adopt_retrain(cv)
    assert models.importances(model, ["x", "noise"]).first()["feature"] == "x"
    net, best = models.train_elastic_net(planted, ["x", "noise"], "y", (0.5,), (0.01,), 2, 10)
    assert best["ic"] > 0.2
    drops = models.permutation_importance(net, planted, ["x", "noise"], "y").collect()
    assert drops[0]["feature"] == "x" and drops[0]["drop"] > 0.2
    assert models.choose_model({"ic": 0.1}, {"ic": 0.104}) == "trees"
    assert models.choose_model({"ic": 0.1}, {"ic": 0.106}) == "elastic_net"


def test_kline_stream_drops_repeats_and_broken_rows(spark, tmp_path):
    rows = [{"symbol": "A", "open_time": 1704067200000 + 300000 * i, **{c: str(i + 1) for c in source.PRICE_COLUMNS}}
            for i in range(5)]
    rows += rows[:2] + [{**rows[0], "open_time": 1704070000000, "close": "n/a"}]
    folder = tmp_path / "feed"
    folder.mkdir()
    (folder / "one.json").write_text("\n".join(map(json.dumps, rows)))
    live.run_available(live.kline_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_rebalance_trigger():
    now = dt.datetime(2024, 1, 10)
    assert live.rebalance_due(None, now) and live.rebalance_due(dt.datetime(2024, 1, 3), now)
    assert not live.rebalance_due(dt.datetime(2024, 1, 4), now)
    assert live.rebalance_due(dt.datetime(2024, 1, 9), now, force=True)
    assert not live.rebalance_due(None, now, paused=True)


def test_every_check_has_its_query():
    assert set(catalog.oracles()) <= set(catalog.queries())
