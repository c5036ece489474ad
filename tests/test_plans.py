"""Shape of the plans that must not shuffle or compute twice."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.series import moving_rank
from barloom.operators import weekly
from barloom.operators.features import FEATURES, build_features
from barloom.operators.layout import FULL_TASK, series_shape, window_tasks
from barloom.spec import BarSpec

SPEC = BarSpec.from_timeframe("1h")


@pytest.fixture(scope="module")
def bars(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    rows = []
    for symbol in ("a", "b", "c"):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 500)))
        for i, c in enumerate(close):
            if symbol == "b" and 200 <= i < 420:
                continue  # a gap of whole weeks
            rows.append((symbol, pd.Timestamp("2024-01-03") + pd.Timedelta(hours=i), c, c * 1.01, c * 0.99, c, 5.0 + i % 7))
    frame = pd.DataFrame(rows, columns=["symbol", "ts", "open", "high", "low", "close", "volume"])
    path = str(tmp_path_factory.mktemp("bars") / "bars")
    spark.createDataFrame(frame).withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(path)
    return spark.read.parquet(path)


def nodes(df):
    """Names of all operators that run, those of subqueries too; what is reused counts once."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        found.append(kind)
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        for inner in (node.children(), node.subqueries()):
            todo += [inner.apply(i) for i in range(inner.size())]
    return found


def test_all_features_take_one_shuffle_and_one_scan(bars):
    found = nodes(build_features(bars, SPEC, FEATURES, ffd_threshold=1e-2))
    assert found.count("ShuffleExchangeExec") == 1 and found.count("FileSourceScanExec") == 1


def test_a_snapshot_computes_its_features_once(bars):
    feats = build_features(bars, SPEC, ["ret_1h", "rvol_1d"])
    snap = weekly.snapshots(feats, ["ret_1h", "rvol_1d"])
    snap.collect()
    found = nodes(snap)
    # The lead over weeks is the only further window.
    assert found.count("WindowExec") == nodes(feats).count("WindowExec") + 1
    assert found.count("FileSourceScanExec") == 1 and found.count("ReusedExchangeExec") == 1


def test_snapshots_fill_gaps_up_to_the_newest_week(bars):
    feats = build_features(bars, SPEC, ["ret_1h"])
    got = {(r.symbol, r.week): r.as_of for r in weekly.snapshots(feats, ["ret_1h"]).collect()}
    rows = bars.select("symbol", "ts").toPandas()
    last = rows.ts.max().normalize() - pd.Timedelta(days=rows.ts.max().dayofweek)
    wanted = {}
    for symbol, group in rows.groupby("symbol"):
        for week in pd.date_range("2024-01-08", last, freq="7D"):
            wanted[symbol, week.to_pydatetime()] = group.ts[group.ts < week].max().to_pydatetime()
    assert got == wanted


def test_sampled_times_are_every_nth(bars):
    times = sorted(r.ts for r in bars.select("ts").distinct().collect())
    got = sorted(r.ts for r in weekly.sampled_times(bars, 50).collect())
    assert got == times[::len(times) // 50]


def test_tasks_follow_rows():
    assert window_tasks(0, 8) == 1 and window_tasks(12_000, 8) == 3
    assert window_tasks(10_000_000, 8) == 32
    assert window_tasks(1_000 * FULL_TASK, 8) == 1_000


def test_shape_of_no_rows(bars):
    assert series_shape(bars.where("symbol = 'none'")) == (0, 0.0, 0)


@pytest.mark.parametrize("window,least", [(1, 1), (7, 3), (60, 10), (500, 2)])
def test_moving_rank_against_brute_force(window, least):
    rng = np.random.default_rng(window)
    x = np.round(rng.normal(size=300), 1)  # many ties
    x[rng.random(300) < 0.2] = np.nan
    x[5], x[9], x[10] = np.inf, 0.0, -0.0
    wanted = np.full(300, np.nan)
    for i in range(300):
        seen = x[max(0, i - window + 1):i + 1]
        seen = seen[~np.isnan(seen)]
        if len(seen) >= least and not np.isnan(x[i]):
            wanted[i] = ((seen < x[i]).sum() + ((seen == x[i]).sum() + 1) / 2) / len(seen)
    np.testing.assert_allclose(moving_rank(x, window, least), wanted)
    assert len(moving_rank(x[:0], window, least)) == 0 and np.isnan(moving_rank(np.full(4, np.nan), window, least)).all()


def test_daily_bars_aggregate_the_line_items_once(spark):
    from barloom.plans.portfolio_queries import _inputs
    from conftest import SF

    made = _inputs(spark, SF)
    assert not [f for df in made for f in df.inputFiles() if "lineitem" in f]
