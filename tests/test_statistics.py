import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.ranks import average_rank, quantiles, spearman, spearman_small, with_rank
from barloom.functions.scalars import normal_cdf, student_two_sided
from barloom.operators import matrix, validation
from barloom.operators.layout import positions


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    n = 1200
    pdf = pd.DataFrame({
        "symbol": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]),
        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) // 3, unit="h"),
        "x": np.where(rng.random(n) < 0.3, 0.0, rng.normal(size=n)), "y": rng.normal(size=n)})
    pdf["y"] += 0.5 * pdf["x"]
    pdf["z"] = pdf["x"] + rng.normal(size=n)
    pdf = pdf.drop_duplicates(["symbol", "ts"]).reset_index(drop=True)
    df = spark.createDataFrame(pdf, "symbol string, ts timestamp_ntz, x double, y double, z double")
    return pdf, df.cache()


def test_distributed_rank(sample):
    pdf, df = sample
    got = with_rank(df, "x", ["symbol"], "r").toPandas().sort_values(["symbol", "ts"])["r"].to_numpy()
    want = pdf.sort_values(["symbol", "ts"]).groupby("symbol")["x"].rank().to_numpy()
    np.testing.assert_allclose(got, want)


def test_rank_correlations_agree(sample):
    pdf, df = sample
    want = pdf.groupby("symbol").apply(lambda g: g["x"].rank().corr(g["y"].rank()), include_groups=False)
    for fn in (spearman, spearman_small):
        got = fn(df, "x", "y", ["symbol"], 10).toPandas().set_index("symbol")["ic"]
        np.testing.assert_allclose(got.loc[want.index], want, rtol=1e-12)
    assert spearman(df, "x", "y", ["symbol"], 10_000).agg(F.max("ic")).first()[0] == 0.0


def test_constant_side_gives_zero(spark):
    df = spark.createDataFrame([("g", 1.0, float(i)) for i in range(20)], "g string, x double, y double")
    assert spearman_small(df, "x", "y", ["g"], 5).first()["ic"] == 0.0
    assert spearman(df, "x", "y", ["g"], 5).first()["ic"] == 0.0


def test_exact_quantiles(sample):
    pdf, df = sample
    probs = [0.01, 0.2, 0.5, 0.99]
    got = quantiles(df, "y", probs).first()["q"]
    np.testing.assert_allclose(got, np.percentile(pdf["y"], [100 * p for p in probs]))
    per = {r["symbol"]: r["q"] for r in quantiles(df, "x", probs, ["symbol"]).collect()}
    for s, g in pdf.groupby("symbol"):
        np.testing.assert_allclose(per[s], np.percentile(g["x"], [100 * p for p in probs]))


def test_positions_are_total_order(sample):
    pdf, df = sample
    got = positions(df, ["symbol"], "ts").toPandas().sort_values("_i")
    assert got["_i"].tolist() == list(range(len(pdf)))
    assert got[["ts", "symbol"]].apply(tuple, axis=1).is_monotonic_increasing


def test_exact_sample(sample):
    pdf, df = sample
    one, two = matrix.exact_sample(df, 137, 9).toPandas(), matrix.exact_sample(df, 137, 9).toPandas()
    assert len(one) == 137
    assert set(map(tuple, one[["symbol", "ts"]].values)) == set(map(tuple, two[["symbol", "ts"]].values))
    assert matrix.exact_sample(df, 10_000, 9).count() == len(pdf)


def test_target_transforms(sample):
    pdf, df = sample
    ranked = matrix.rank_normalise(df, "y").toPandas()["y"]
    assert ranked.between(-1, 1, inclusive="neither").all() and abs(ranked.mean()) < 1e-12
    w = matrix.winsorise(df, "y", 5.0).toPandas()["y"]
    assert w.min() == pytest.approx(np.percentile(pdf["y"], 5))
    flat = matrix.demean_by_day(df, "y", "d").groupBy(F.to_date("ts").alias("d0")).agg(F.avg("d").alias("m"))
    assert flat.agg(F.max(F.abs("m"))).first()[0] < 1e-12


def test_cross_section_betas_match_least_squares(sample):
    pdf, df = sample
    many = df.withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    got = validation.cross_section_betas(many, ["x", "z"], "y", 20).toPandas()
    pdf = pdf.assign(ts=pdf["ts"].dt.floor("D"))
    for ts, g in pdf.groupby("ts"):
        X = g[["x", "z"]].to_numpy()
        X = (X - X.mean(0)) / X.std(0)
        beta = np.linalg.lstsq(X, g["y"] - g["y"].mean(), rcond=None)[0]
        row = got[got["ts"] == ts].set_index("feature")["beta"]
        np.testing.assert_allclose([row["x"], row["z"]], beta, rtol=1e-9)


def test_false_discovery_brute_force(spark):
    p = [0.001, 0.012, 0.03, 0.035, 0.5, 0.9]
    df = spark.createDataFrame([(f"f{i}", v) for i, v in enumerate(p)], "feature string, p_value double")
    got = {r["feature"]: r["significant"] for r in validation.benjamini_hochberg(df, 0.06).collect()}
    passing = [i for i, v in enumerate(p) if v <= (i + 1) / len(p) * 0.06]
    assert got == {f"f{i}": i <= max(passing) for i in range(len(p))}


def test_probability_functions(spark):
    assert student_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert student_two_sided(0.0, 5) == pytest.approx(1.0)
    assert student_two_sided(1.0, 1) == pytest.approx(0.5)
    df = spark.createDataFrame([(0.0,), (1.959963985,)], "z double")
    got = [r[0] for r in df.select(normal_cdf("z")).collect()]
    assert got == pytest.approx([0.5, 0.975], abs=1e-8)


def test_redundancy_keeps_the_earlier_feature(spark):
    pairs = spark.createDataFrame(
        [("a", "b", 0.95), ("b", "c", 0.99), ("a", "c", 0.1)], "feature_a string, feature_b string, r double")
    assert validation.redundant_features(pairs, ["a", "b", "c"]) == ["b"]


def test_leak_test_flags(sample):
    _, df = sample
    row = validation.leak_test(df, ["x", "z"], "y", 2, max_shuffled=0.1).first()
    assert row["shuffled_test_pass"] and row["leaked_test_pass"]


def test_return_matrix(spark):
    rng = np.random.default_rng(0)
    rows = [(w, s, float(rng.normal())) for w in range(40) for s in "abc" if (w, s) != (3, "b")]
    df = spark.createDataFrame(rows, "week int, symbol string, ret double")
    wide = pd.DataFrame(rows, columns=["w", "s", "r"]).pivot(index="w", columns="s", values="r")
    for kind, want in (("cov", wide.cov()), ("corr", wide.corr())):
        for r in validation.return_matrix(df, ["a", "b", "c"], kind).collect():
            assert r["value"] == pytest.approx(want.loc[r["a"], r["b"]], abs=1e-10)


def test_rank_correlations_of_zero_are_exact(spark):
    """The share of positive ICs does not hang on rounding: 60 weeks whose ranks do not correlate, rows in any order."""
    rng = np.random.default_rng(3)
    rows, week = [], 0
    while week < 60:
        x, y = np.arange(1, 12), rng.permutation(11) + 1
        if ((x - 6) * (y - 6)).sum() == 0:
            rows += [(week, float(x[i]) / 7, float(y[i]) / 9) for i in rng.permutation(11)]
            week += 1
    got = spearman_small(spark.createDataFrame(rows, "week int, x double, y double"), "x", "y", ["week"], 10).collect()
    assert len(got) == 60 and {r.ic for r in got} == {0.0}
