"""Registered queries against their check SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

from barloom.plans import catalog

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from check_queries import compare  # noqa: E402

SF = "/root/testdata/sf0.001"
QUICK = ["features_returns", "features_pump_dump", "forward_targets", "resample_six_hours", "weekly_returns",
         "latest_prices", "enough_history", "pump_regime", "pause_states", "capped_weights", "close_positions",
         "latest_per_key", "source_klines", "stream_bars", "stream_online_averages"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, duck, name):
    said = compare(catalog.queries()[name](spark, SF), duck.sql(catalog.oracles()[name]))
    assert said.startswith("ok") or said.startswith("EMPTY"), said
