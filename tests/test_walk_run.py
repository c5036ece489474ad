"""Runs in committed blocks: resumed equals whole, torn attempts never show, Spark ML rivals."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from barloom.operators import models
from barloom.operators.walkforward import Live, Schedule, decide
from barloom.operators.walkrun import LineLearner, ModelLearner, walk_forward_run, weekly_of
from barloom.plans.portfolio_queries import RUN, _walk_data
from barloom.sources.ledger import Ledger
from conftest import SF

PLAN = replace(RUN, schedule=replace(RUN.schedule, retrain_every=90), kill=-0.02)


@pytest.fixture(scope="module")
def data(spark):
    return _walk_data(spark, SF)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_resumed_after_any_block_equals_whole(spark, data, tmp_path):
    whole = Ledger(spark, f"{tmp_path}/whole")
    n = walk_forward_run(data, PLAN, LineLearner(), whole, "a")
    assert n >= 3
    parts = Ledger(spark, f"{tmp_path}/parts")
    for stop in range(1, n + 1):
        assert walk_forward_run(data, PLAN, LineLearner(), parts, "a", stop_after=stop) == stop
        seen = parts.read("a", "weekly")
        if stop < n and seen is not None:  # killed between tables: written, not committed
            parts.attempt("a", stop).write("weekly", seen.drop("block"))
    assert walk_forward_run(data, PLAN, LineLearner(), parts, "a") == n
    weekly = rows(weekly_of(parts, "a"))
    assert weekly == rows(weekly_of(whole, "a")) and len(weekly) > 50
    assert "KILL_SWITCH" in {x for r in weekly for x in r}  # the pause runs over blocks, too
    for table in ("trades", "features", "training", "decisions"):
        assert rows(parts.read("a", table)) == rows(whole.read("a", table))
    assert weekly_of(parts, "other") is None


def test_of_two_commits_of_a_block_the_first_counts(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    assert ledger.last("r") == (0, None)
    for value in (1, 2):
        attempt = ledger.attempt("r", 0)
        attempt.write("t", spark.range(value))
        attempt.commit({"value": value})
    attempt = ledger.attempt("r", 2)  # a gap is not passed
    attempt.commit({"value": 9})
    assert ledger.last("r") == (1, {"value": 1})
    assert ledger.read("r", "t").count() == 1 and ledger.read("r", "none") is None


def test_rival_spark_models_are_saved_and_loaded(spark, data, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    learner = ModelLearner(models.TreeParams(trees=2, depth=2, min_leaf=5), k=2, gap=5, l1_shares=(0.5,), alphas=(0.001,))
    plan = replace(PLAN, schedule=replace(PLAN.schedule, retrain_every=250, min_rows=50))
    n = walk_forward_run(data, plan, learner, ledger, "m", stop_after=1)
    again = walk_forward_run(data, plan, learner, ledger, "m")
    assert n == 1 and again == 2
    _, state = ledger.last("m")
    assert state["retrains"] >= 1
    if state["model"]:
        assert state["model"]["kind"] in ("trees", "elastic_net") and weekly_of(ledger, "m").count() > 0


def test_decisions_follow_the_rules():
    plan = Schedule(gate_threshold=-0.1, invert=True, invert_threshold=0.0, gate_weeks=2)
    live = Live()
    week = {"n_symbols": 9, "ic": -0.04, "feature_ic": 0.2, "n_features": 5}
    assert decide(week, live, plan) == (False, False, -0.04)
    assert decide(week, live, plan) == (False, False, -0.04)
    assert decide(week, live, plan) == (False, True, 0.04)          # both of the last weeks were below zero
    assert decide(week, live, plan) == (False, False, -0.04)        # the mean sees the flipped IC: it is 0
    assert decide({**week, "feature_ic": -0.3}, live, plan) == (True, False, -0.3)
    assert decide(week, live, plan) == (False, False, -0.04)        # a gated week leaves the mean undefined
    assert decide({**week, "n_symbols": 4}, live, plan) is None and len(live.recent) == 2
    assert decide(week, Live([-0.5, -0.5]), plan)[:2] == (True, False)
    assert decide(week, Live([-0.5, -0.5]), Schedule(gate_weeks=2)) == (False, False, -0.04)  # gate off by default
    assert decide(week, Live(), Schedule(force_invert=True)) == (False, True, 0.04)
    assert decide(week, Live([0.1]), plan, paused=True) == (False, False, 0.0)


@pytest.mark.parametrize(("refused", "every"), [(3, 60), (99, 120)])
def test_a_resumed_run_without_an_early_model(spark, monkeypatch, refused, every):
    """Blocks that adopt no model write no metrics: the killed run has none yet, or the whole run."""
    from barloom.plans import portfolio_queries as plans

    class Refusing(LineLearner):
        fits = 0

        def fit(self, *args):
            model, cv = super().fit(*args)
            Refusing.fits += 1
            return model, -1.0 if Refusing.fits <= refused else 1.0

    monkeypatch.setattr(plans, "LineLearner", Refusing)
    monkeypatch.setattr(plans, "RUN", replace(RUN, schedule=replace(RUN.schedule, retrain_every=every, min_rows=50)))
    weekly = plans.walk_forward_run_weekly(spark, SF)
    assert (weekly.count() > 0) == (Refusing.fits > refused)
    assert "cum_ret" in weekly.columns
