import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from barloom.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "tests", 4, spark__ui__enabled="false", spark__driver__memory="6g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def bars(spark):
    """Random walks of three symbols with gaps in time; one symbol holds most rows."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    frames = []
    for name, n in (("A", 900), ("B", 240), ("C", 150)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        open_ = close * np.exp(rng.normal(0, 0.003, n))
        frames.append(pd.DataFrame({
            "symbol": name,
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(rng.integers(1, 4, n)), unit="h"),
            "open": open_, "close": close, "volume": rng.integers(0, 50, n).astype(float),
            "high": np.maximum(open_, close) * 1.002, "low": np.minimum(open_, close) * 0.998,
        }))
    pdf = pd.concat(frames, ignore_index=True)
    schema = ("symbol string, ts timestamp_ntz, open double, close double, volume double, "
              "high double, low double")
    return spark.createDataFrame(pdf, schema).cache()
