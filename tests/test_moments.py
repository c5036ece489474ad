"""Segment moments, elastic-net paths and permutations against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import models, moments


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(100, [1, 5, 0.2], (600, 3))
    y = 0.3 * (x[:, 0] - 100) - 0.05 * (x[:, 1] - 100) + rng.normal(0, 0.4, 600)
    rows = [(f"S{i % 3}", i, i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "symbol string, n int, _i long, a double, b double, c double, y double") \
        .withColumn("ts", F.timestamp_seconds(F.col("n") * 60).cast("timestamp_ntz")).drop("n")
    return df.repartition(5).cache(), x, y


def test_segments_add_up(table):
    df, x, y = table
    shift = [100.0, 100.0, 100.0, 0.0]
    grams = moments.segment_moments(df, ["a", "b", "c", "y"], [0, 100, 101, 350], shift)
    z = np.column_stack([np.ones(600), x, y]) - [0, *shift]
    for g, (lo, hi) in zip(grams, ((0, 100), (100, 101), (101, 350))):
        assert np.allclose(g, z[lo:hi].T @ z[lo:hi])


def test_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    y = x @ [1, 0, 0, -2, 0, 0.5] + rng.normal(size=300)
    q, c = np.cov(x.T, bias=True), np.cov(np.column_stack((x, y)).T, bias=True)[:-1, -1]
    for alpha, share in ((0.3, 0.5), (2.0, 0.9), (0.01, 0.99)):
        b = moments.descend(q, c, alpha, share, np.zeros(6))
        slope = c - q @ b - alpha * (1 - share) * b
        assert np.allclose(slope[b != 0], alpha * share * np.sign(b[b != 0]), atol=1e-6)
        assert (np.abs(slope[b == 0]) <= alpha * share + 1e-6).all()
    assert not moments.descend(q, c, 1e6, 0.5, np.zeros(6)).any()


def test_path_equals_spark_fits_fold_by_fold(table):
    df, _, _ = table
    folds = models.fold_bounds(600, 3, 10)
    path = moments.ElasticPath(df, ["a", "b", "c"], "y", folds, (0.5, 0.9), (0.05, 0.01))
    for point in ((0.5, 0.05), (0.9, 0.01)):
        errors = []
        for end, lo, hi in folds:
            model = models.fit_elastic_net(df.where(F.col("_i") < end), ["a", "b", "c"], "y", point[1], point[0])
            held = models.predict(model, df.where((F.col("_i") >= lo) & (F.col("_i") < hi)))
            errors.append(held.agg(F.avg(F.pow(F.col("y") - F.col("pred"), F.lit(2.0)))).first()[0])
        assert path.errors[point] == pytest.approx(np.mean(errors), rel=1e-2)  # both scale by approximate quantiles
        seen = path.held_out(df, point)
        mse = [r["m"] for r in seen.groupBy("fold").agg(F.avg(F.pow(F.col("y") - F.col("pred"), F.lit(2.0))).alias("m")).collect()]
        assert np.mean(mse) == pytest.approx(path.errors[point], rel=1e-9)
    assert path.errors[path.best()] == min(path.errors.values())


def test_chosen_net_reports_its_own_point(table):
    df, _, _ = table
    _, best = models.train_elastic_net(df.drop("_i"), ["a", "b", "c"], "y", (0.5,), (10.0, 0.01), 3, 10)
    assert best["alpha"] == 0.01 and best["folds"] == 3 and best["ic"] > 0.4 and 0 < best["r2"] < 1


def test_permuting_a_useful_column_costs_most(table):
    df, _, _ = table
    model = models.fit_elastic_net(df, ["a", "b", "c"], "y", 0.001, 0.5)
    found = {r["feature"]: r["drop"] for r in models.permutation_importance(model, df.drop("_i"), ["a", "b", "c"], "y").collect()}
    assert found["a"] > 0.1 and found["a"] > found["b"] > found["c"] and abs(found["c"]) < 0.05
