"""Headline numbers of a published 77-week run, recomputed from its weekly returns and ICs."""

import datetime as dt

import pytest

from barloom.operators import reports

# Weekly returns in percent and weekly ICs of the run.
RETURNS_PCT = [
    5.8534, -0.8984, 2.4602, -0.9322, 2.334, -1.9168, 0.239, 5.2659, 27.2669, -0.7363, 6.2691,
    -0.8569, -5.9571, -7.1858, 3.1545, 2.224, 4.309, -4.571, 3.8089, -3.604, -2.9102, 2.8466,
    5.5551, -1.0188, -3.5257, 10.3302, -0.215, -2.5583, 8.792, -2.2527, 13.4869, 2.4952, 3.5836,
    0.1479, 12.4946, 6.5988, 4.5432, 12.001, -4.7275, -0.7949, 5.4248, 5.9452, -4.4677, 11.6074,
    0.9173, 2.2532, 8.4473, -0.662, 8.0555, 1.1831, 3.2332, 2.0377, 0.7798, 1.1767, -0.937, -1.6057,
    5.927, -7.4043, -2.5756, -2.2406, 13.3593, 5.2743, 15.8796, 5.9549, 2.3759, -2.234, 2.6562,
    6.0978, 5.1296, -1.5562, 5.0501, -0.5848, 10.0515, -3.2161, 5.9485, -1.2542, -3.5291,
]
ICS = [
    -0.0761, 0.02117, 0.10217, 0.18414, -0.10022, -0.06042, 0.09753, 0.08347, 0.22772, -0.1287,
    -0.03413, -0.15244, -0.01357, -0.04591, 0.04335, -0.0524, -0.15999, -0.1058, 0.04743, -0.11757,
    -0.22713, 0.0051, 0.14933, -0.08386, -0.03711, -0.13977, 0.01583, -0.10567, 0.0733, -0.17869,
    0.23141, 0.26694, -0.26488, 0.22041, -0.20511, 0.46229, 0.16141, 0.26153, -0.03037, 0.09079,
    0.42473, 0.0457, 0.10304, -0.2576, -0.11141, 0.19173, 0.29692, -0.12137, 0.23158, 0.10857,
    -0.04841, -0.13804, -0.04256, -0.1489, 0.00468, -0.09818, -0.14926, 0.07362, -0.09974, -0.15105,
    0.12018, 0.21731, 0.0623, -0.10331, 0.13177, -0.0149, 0.00034, 0.07189, 0.00051, 0.00422,
    -0.0265, 0.04841, -0.04457, 0.04102, 0.19369, -0.02792, 0.06395,
]


def test_headline_numbers(spark):
    start = dt.datetime(2024, 9, 9)
    rows = [(start + dt.timedelta(weeks=i), r / 100, r / 100, 0.0, ic, 98.7, 300, "LOW_VOL_GRIND")
            for i, (r, ic) in enumerate(zip(RETURNS_PCT, ICS))]
    weekly = spark.createDataFrame(
        rows, "week timestamp_ntz, week_ret double, long_ret double, short_ret double, ic double, "
              "turnover_pct double, n_symbols int, regime string")
    got = reports.performance(weekly).first()
    assert got["n_weeks"] == 77
    assert got["total_return"] == pytest.approx(5.6475, abs=1e-3)
    assert got["annualised"] == pytest.approx(2.5939, abs=1e-3)
    assert got["sharpe"] == pytest.approx(3.2949, abs=1e-3)
    assert got["max_drawdown"] == pytest.approx(-0.1346, abs=1e-4)
    assert got["ic_mean"] == pytest.approx(0.0166, abs=1e-4)
    assert got["icir"] == pytest.approx(0.1108, abs=1e-4)
    assert got["positive_weeks_pct"] == pytest.approx(61.04, abs=0.01)
    assert got["ic_positive_pct"] == pytest.approx(51.9, abs=0.1)
    assert got["best_week"] == pytest.approx(0.2727, abs=1e-4)
    assert got["worst_week"] == pytest.approx(-0.0740, abs=1e-4)
