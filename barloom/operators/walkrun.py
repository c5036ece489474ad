"""A walk-forward run in committed blocks: features, models, trades and metrics of one retrain after another.

The driver loops over retrain blocks (a few weeks each); every step inside a block is a Spark job over the
block's training window or its weeks. A block ends with one commit that also carries the state of the next
one, a few numbers and names. A run that was killed anywhere goes on after its last commit and gives
what it would have given in one go: a block depends on data, the plan and the committed blocks alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from typing import Protocol

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from ..sources.ledger import Attempt, Ledger
from . import models, portfolio, walkforward
from .ic import filter_features, pooled_ic
from .models import sign_flipped
from .regime import KILL_SWITCH
from .stability import propose_update
from .universe import complete_rows, training_window
from .walkforward import Live, Schedule, decide, line_value, marked_metrics, week_inputs
from .weekly import last_rows


@dataclass(frozen=True)
class RunPlan:
    """Everything a run is given but its data."""

    active: tuple[str, ...]
    core: tuple[str, ...] = ()
    candidates: tuple[str, ...] = ()
    schedule: Schedule = Schedule()
    rules: portfolio.Rules = portfolio.Rules()
    ic_every: int = 2            # weeks between two records of feature ICs
    last_ics: int = 4            # records that a change of features looks at
    max_turnover: int = 3
    ic_threshold: float = 0.005  # pre-filter on the training window
    min_features: int = 20
    margin: float = 0.005        # by which the challenger must win
    kill: float = -0.20
    pause_weeks: int = 4

    def pool(self) -> list[str]:
        return list(dict.fromkeys([*self.core, *self.active, *self.candidates]))


@dataclass(frozen=True)
class RunData:
    """Inputs: ``feats`` (symbol, ts, features, target), weekly returns, regimes, volatility, feature ICs."""

    feats: DataFrame
    target: str
    rets: DataFrame
    regimes: DataFrame
    rvol: DataFrame
    history: DataFrame  # week, feature, ic


@dataclass
class State:
    """What the next block needs: written with each commit."""

    active: list[str]
    weeks: int = 0                # weeks decided so far
    model: dict | None = None
    retrains: int = 0
    adopted: int = 0
    recent: list = field(default_factory=list)
    cum: float = 1.0
    peak: float = 0.0
    paused: int = 0               # weeks of a pause still to come
    book_block: int | None = None  # block with the newest book


class Learner(Protocol):
    """Fits two rivals on a training window and scores rows with the one that was chosen."""

    def fit(self, rows: DataFrame, features: Sequence[str], ics: Mapping[str, float], target: str, margin: float,
            attempt: Attempt) -> tuple[dict, float]:
        """(model as JSON values, cross-validated IC of the winner)."""

    def score(self, model: dict, rows: DataFrame, out: str) -> DataFrame:
        """Rows with the model's prediction in ``out``."""


class LineLearner:
    """Rivals: the line through the strongest feature, and the mean of one line for each feature.

    Both are judged on the rows of the last ``holdout_days`` of the window, by lines of the rows before; the
    winner's lines are those of the whole window. All lines of a fit come from one aggregate.
    """

    def __init__(self, holdout_days: int = 182):
        self.holdout_days = holdout_days

    def fit(self, rows, features, ics, target, margin, attempt):
        cut = rows.agg(F.max("ts")).scalar() - F.expr(f"INTERVAL {self.holdout_days} DAYS")
        rows = stage(rows.withColumn("_late", F.col("ts") > cut))
        early = ~F.col("_late")
        sums = []
        for f in features:
            for name, keep in (("all", F.lit(True)), ("early", early)):
                x, y = F.when(keep, F.col(f)), F.when(keep, F.col(target))
                sums += [F.regr_slope(y, x).alias(f"b {name} {f}"), F.regr_intercept(y, x).alias(f"a {name} {f}")]
        fitted = rows.agg(*sums).first().asDict()

        def line(name, chosen):
            weights = {"": sum(fitted[f"a {name} {f}"] or 0.0 for f in chosen) / len(chosen)}
            return weights | {f: (fitted[f"b {name} {f}"] or 0.0) / len(chosen) for f in chosen}

        strongest = [min(features, key=lambda f: (-abs(ics[f]), f))]
        late = rows.where("_late")
        cv = [models.quality(late.withColumn("pred", line_value(_weights(line("early", chosen)), features)), target)
              for chosen in (strongest, list(features))]
        winner = models.choose_model(*cv, margin)
        chosen = strongest if winner == "trees" else list(features)
        return {"line": line("all", chosen)}, cv[winner != "trees"]["ic"]

    def score(self, model, rows, out):
        return rows.withColumn(out, line_value(_weights(model["line"]), [f for f in model["line"] if f]))


def _weights(line: Mapping[str, float]):
    return F.create_map(*[x for f, w in line.items() for x in (F.lit(f), F.lit(float(w)))])


class ModelLearner:
    """Rivals: boosted trees and the elastic net; the winner is saved with the block's attempt."""

    def __init__(self, params: models.TreeParams = models.PRIMARY, k: int = 5, gap: int = 48, **net):
        self.params, self.k, self.gap, self.net = params, k, gap, net

    def fit(self, rows, features, ics, target, margin, attempt):
        trees, tree_cv = models.train_trees(rows, features, target, self.params, self.k, self.gap)
        net, net_cv = models.train_elastic_net(rows, features, target, k=self.k, gap=self.gap, **self.net)
        kind = models.choose_model(tree_cv, net_cv, margin)
        model, cv = (trees, tree_cv) if kind == "trees" else (net, net_cv)
        path = attempt.path("model")
        model.write().save(path)
        return {"kind": kind, "path": path, "features": list(features)}, cv["ic"]

    def score(self, model, rows, out):
        return models.predict(PipelineModel.load(model["path"]), rows.na.drop(how="any", subset=model["features"]), out)


def walk_forward_run(data: RunData, plan: RunPlan, learner: Learner, ledger: Ledger, run_id: str,
                     stop_after: int | None = None) -> int:
    """Do the blocks that are not committed yet (up to ``stop_after`` blocks in all); returns how many are.

    Each block writes ``features`` (status after the update), ``training`` (feature ICs and what the
    pre-filter kept), ``decisions``, ``trades``, ``picks`` and ``weekly``.
    """
    s = plan.schedule
    pool = plan.pool()
    rows = stage(data.feats.select("symbol", "ts", *pool, data.target))
    scored = stage(last_rows(rows, pool, s.score_rows).na.drop(how="any", subset=pool))
    weeks = [r["week"] for r in scored.select("week").distinct().orderBy("week").collect()]  # one row a week
    blocks = [weeks[i:i + s.retrain_every] for i in range(0, len(weeks), s.retrain_every)]
    every = data.feats.sparkSession.createDataFrame(
        [(w, i) for i, w in enumerate(weeks)], "week timestamp_ntz, _n int")
    data = replace(data, feats=rows, **{c: stage(getattr(data, c)) for c in ("rets", "regimes", "rvol")})
    history = stage(data.history.join(every, "week").where(F.col("_n") % plan.ic_every == 0).drop("_n"))
    done, saved = ledger.last(run_id)
    state = State(**saved) if saved else State(list(plan.active))
    for b in range(done, len(blocks) if stop_after is None else min(stop_after, len(blocks))):
        attempt = ledger.attempt(run_id, b)
        state = _block(data, plan, learner, ledger, attempt, rows, scored, history, blocks[b], state)
        attempt.commit(asdict(state))
        done = b + 1
    return done


def _block(data, plan, learner, ledger, attempt, rows, scored, history, weeks, state) -> State:
    s = plan.schedule
    state = State(**asdict(state))
    past = history.where(F.col("week") < F.lit(weeks[0]).cast("timestamp_ntz"))
    if attempt.block:
        judged = past.join(data.regimes.select("week", "regime"), "week")
        update = attempt.write("features", propose_update(
            judged, state.active, plan.core, plan.candidates, plan.last_ics, plan.max_turnover))
        inside = {r["feature"] for r in update.where("in_set").select("feature").collect()}  # one row a feature
        state.active = [f for f in plan.pool() if f in inside]
    train = stage(complete_rows(training_window(rows, weeks[0], s.train_weeks, s.embargo_minutes), [*plan.pool(), data.target]))
    if state.active and train.count() >= s.min_rows:
        ics = pooled_ic(train, state.active, data.target).select("feature", "ic")
        kept = attempt.write("training", filter_features(ics, plan.ic_threshold, plan.min_features)).collect()  # one row a feature
        chosen = [f for f in state.active if any(r["feature"] == f and r["selected"] for r in kept)]
        state.retrains += 1
        if chosen:
            model, cv = learner.fit(train, chosen, {r["feature"]: r["ic"] for r in kept}, data.target, plan.margin, attempt)
            if models.adopt_retrain({"ic": cv}):
                state.model, state.adopted = model, state.adopted + 1
    if state.model is None:
        return state

    mine = scored.where(F.col("week").between(*[F.lit(w).cast("timestamp_ntz") for w in (weeks[0], weeks[-1])]))
    preds = stage(learner.score(state.model, mine, "pred").groupBy("symbol", "week").agg(F.avg("pred").alias("pred")))
    facts = [r.asDict() for r in week_inputs(preds, data.rets, history).orderBy("week").collect()]  # one row a week
    book = _book(ledger, attempt, state)
    start = F.lit(weeks[0]).cast("timestamp_ntz")
    # A pause changes what later weeks decide and hold, so the block is gone through again after each trip.
    shut: set = set()
    while True:
        live = Live(list(state.recent))
        found = [(w["week"], *d) for w in facts if (d := decide(w, live, s, w["week"] in shut)) is not None]
        gate = preds.sparkSession.createDataFrame(found, "week timestamp_ntz, gated boolean, flipped boolean, ic double")
        stopped = F.col("week").isin([F.lit(w).cast("timestamp_ntz") for w in shut]) if shut else F.lit(False)
        traded = sign_flipped(preds.join(gate.where(~F.col("gated") & ~stopped).select("week", "flipped"), "week"), F.col("flipped")).drop("flipped")
        picks = stage(portfolio.pick(traded, data.regimes, plan.rules))
        held = picks if book is None else picks.unionByName(book)
        trades = stage(portfolio.trades(held, data.rets, data.rvol, plan.rules.fee).where(F.col("week") >= start))
        results = {r["week"]: r["week_ret"] for r in portfolio.week_results(trades).collect()}  # one row a week
        closed, end = _paused([w for w, *_ in found], results, plan, state)
        if closed <= shut:
            break
        shut |= closed
    end.recent = live.recent
    if not found:
        return end
    attempt.write("decisions", gate)
    attempt.write("trades", trades)
    if not attempt.write("picks", picks).isEmpty():
        end.book_block = attempt.block
    weekly = marked_metrics(gate, traded, trades, portfolio.turnover(held).where(F.col("week") >= start), data.regimes)
    attempt.write("weekly", weekly.drop("cum_ret", "drawdown", "max_drawdown", "annualised").withColumns({
        "regime": F.when(stopped, F.lit(KILL_SWITCH)).otherwise(F.col("regime")),
        "turnover_pct": F.when(stopped, F.lit(0.0)).otherwise(F.col("turnover_pct"))}))
    return end


def _book(ledger: Ledger, attempt: Attempt, state: State) -> DataFrame | None:
    """Picks of the newest traded week of earlier blocks."""
    if state.book_block is None:
        return None
    picks = ledger.read(attempt.run_id, "picks", attempt.block).where(F.col("block") == state.book_block).drop("block")
    return stage(picks.where(F.col("week") == picks.agg(F.max("week")).scalar()))


def _paused(weeks: Sequence, results: Mapping, plan: RunPlan, state: State) -> tuple[set, State]:
    """Weeks of the block that fall into a pause, by these results, and the state after the block.

    Up to the end of the first pause that the results do not know of yet they are right; later trips show
    in the next round.
    """
    state, out = State(**asdict(state)), set()
    for week in weeks:
        fall = state.cum / state.peak - 1 if state.peak > 0 else 0.0
        if not state.paused and fall < plan.kill:
            state.paused = plan.pause_weeks
        if state.paused:
            out.add(week)
            state.paused -= 1
            if not state.paused:
                state.peak = state.cum  # the fall is measured afresh
            continue
        state.cum *= 1 + results.get(week, 0.0)
        state.peak = max(state.peak, state.cum)
    state.weeks += len(weeks)
    return out, state


def weekly_of(ledger: Ledger, run_id: str) -> DataFrame | None:
    """Weekly metrics of all committed blocks, with compounding and drawdown over the whole run."""
    rows = ledger.read(run_id, "weekly")
    return None if rows is None else portfolio.with_drawdown(rows)
