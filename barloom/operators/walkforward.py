"""Walk-forward runs: refit on a rolling window, score the weeks until the next fit, gate, trade, report."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import spearman_small
from ..session import stage
from . import portfolio
from .models import sign_flipped
from .regime import IC_GATED
from .universe import complete_rows, training_window
from .weekly import last_rows


@dataclass(frozen=True)
class Schedule:
    """When a run fits, what it fits on, and when it stands aside or turns its signal round.

    Gate and inversion have thresholds of their own and both act: the gate first, and at its default of -1
    never by the model's own ICs.
    """

    train_weeks: int = 104
    retrain_every: int = 4
    embargo_minutes: int = 60
    min_rows: int = 100
    score_rows: int = 12
    gate_weeks: int = 4
    gate_threshold: float = -1.0
    gate_features: int = 4
    invert: bool = False
    invert_threshold: float = 0.0
    force_invert: bool = False
    min_predictions: int = portfolio.MIN_PREDICTIONS


Line = Mapping[str, float]  # coefficients by feature; the intercept under ""


def least_squares(target: str, feature: str) -> Callable[[DataFrame], Line]:
    """Fit of a line through one feature."""
    def fit(rows: DataFrame) -> Line:
        line = rows.agg(F.regr_slope(target, feature).alias("b"), F.regr_intercept(target, feature).alias("a")).first()
        return {"": line["a"], feature: line["b"]}
    return fit


def line_value(weights: Column, features: Sequence[str]) -> Column:
    """Value of a line whose coefficients are a map column; features it does not name do not count."""
    value = weights[""]
    for f in features:
        value = value + F.coalesce(weights[f] * F.col(f), F.lit(0.0))
    return value


def walk_forward_predictions(feats: DataFrame, features: Sequence[str], target: str,
                             fit: Callable[[DataFrame], Line], plan: Schedule = Schedule()) -> DataFrame:
    """(symbol, week, pred): each week scored by the newest model fitted before it.

    ``fit(rows)`` gives a line over the features. The loop runs once for each retrain, over the
    week table; a retrain without enough rows keeps the model before it. The lines become a table of weeks and
    coefficients, so all weeks are scored in one join over rows that were gathered once.
    """
    rows = stage(feats.select("symbol", "ts", *features, target))
    scored = stage(last_rows(rows, features, plan.score_rows).na.drop(how="any", subset=list(features)))
    weeks = [r["week"] for r in scored.select("week").distinct().orderBy("week").collect()]  # one row a week
    model, lines = None, []
    for start in range(0, len(weeks), plan.retrain_every):
        block = weeks[start:start + plan.retrain_every]
        train = complete_rows(training_window(rows, block[0], plan.train_weeks, plan.embargo_minutes), [*features, target])
        if train.count() >= plan.min_rows:
            model = dict(fit(train))
        if model is not None:
            lines += [(week, model) for week in block]
    table = feats.sparkSession.createDataFrame(lines, "week timestamp_ntz, _line map<string, double>")
    return scored.join(table, "week").groupBy("symbol", "week").agg(F.avg(line_value(F.col("_line"), features)).alias("pred"))


@dataclass
class Live:
    """What the decisions of later weeks need of earlier ones: the newest live ICs, None for a gated week."""

    recent: list = field(default_factory=list)


def decide(week: Mapping, live: Live, plan: Schedule, paused: bool = False) -> tuple[bool, bool, float] | None:
    """(gated, flipped, ic) of one week, or None if it has too few predictions; ``live`` moves on.

    A week that is paused for another reason is neither, and its IC counts as 0.

    ``week`` holds ``n_symbols``, the plain ``ic`` of its predictions, and mean and number of the newest ICs
    of features before it. A week is gated if the features' mean, or the mean live IC of the last
    ``gate_weeks`` weeks, is below the gate; its IC is then the features' mean. Otherwise it is flipped if
    the live mean is below the inversion threshold; the live IC is that of the predictions as traded, so it
    changes sign with them. A gated week among the last ones leaves the live mean undefined.
    """
    if paused:
        live.recent = [*live.recent, 0.0][-plan.gate_weeks:]
        return False, False, 0.0
    mean = sum(live.recent) / len(live.recent) if len(live.recent) == plan.gate_weeks and None not in live.recent else None
    weak = week["n_features"] >= plan.gate_features and week["feature_ic"] < plan.gate_threshold
    if weak or (mean is not None and mean < plan.gate_threshold):
        found = True, False, float(week["feature_ic"])
    elif week["n_symbols"] < plan.min_predictions:
        return None
    else:
        flip = plan.force_invert or (plan.invert and mean is not None and mean < plan.invert_threshold)
        found = False, flip, -float(week["ic"]) if flip else float(week["ic"])
    live.recent = [*live.recent, None if found[0] else round(found[2], 5)][-plan.gate_weeks:]
    return found


def week_inputs(preds: DataFrame, rets: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(week, n_symbols, ic, feature_ic, n_features): what ``decide`` looks at, one row a week.

    The plain IC is 0 below half the predictions, between 5 and 10, with a return. ``history`` is
    (week, feature, ic); of each feature the newest IC before the week counts.
    """
    counts = preds.groupBy("week").agg(F.count(F.lit(1)).alias("n_symbols"))
    found = spearman_small(preds.join(rets.select("symbol", "week", "ret"), ["symbol", "week"]), "pred", "ret", ["week"], 2)
    need = F.greatest(F.lit(5), F.least(F.lit(10), F.floor(F.col("n_symbols") / 2)))
    table = counts.join(found, "week", "left").select(
        "week", "n_symbols", F.when(F.col("n_obs") >= need, F.coalesce("ic", F.lit(0.0))).otherwise(0.0).alias("ic"))
    if history is None:
        return table.withColumns({"feature_ic": F.lit(0.0), "n_features": F.lit(0).cast("long")})
    names = [r["feature"] for r in history.select("feature").distinct().collect()]  # one row a feature
    every = history.select("week").union(counts.select("week")).distinct() \
        .select("week", F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")).alias("feature"))
    before = Window.partitionBy("feature").orderBy("week").rowsBetween(Window.unboundedPreceding, -1)
    newest = every.join(history.select("week", "feature", "ic"), ["week", "feature"], "left") \
        .withColumn("_prev", F.last("ic", ignorenulls=True).over(before)).groupBy("week").agg(
        F.avg("_prev").alias("feature_ic"), F.count("_prev").alias("n_features"))
    return table.join(newest, "week", "left").na.fill(0.0, ["feature_ic"]).na.fill(0, ["n_features"])


def decisions(weeks: DataFrame, plan: Schedule = Schedule(), by: Sequence[str] = ()) -> DataFrame:
    """(by, week, gated, flipped, ic) of ``week_inputs``, folded in week order for each portfolio.

    A portfolio has one row a week; the fold keeps ``gate_weeks`` numbers.
    """
    def fold(table: pd.DataFrame) -> pd.DataFrame:
        live, out = Live(), []
        for row in table.sort_values("week").to_dict("records"):
            found = decide(row, live, plan)
            if found is not None:
                out.append((*[row[c] for c in by], row["week"], *found))
        return pd.DataFrame(out, columns=[*by, "week", "gated", "flipped", "ic"])

    kinds = dict(weeks.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in by) + f"week {kinds['week']}, gated boolean, flipped boolean, ic double"
    return weeks.groupBy(*by).applyInPandas(fold, schema)


def gated_run(preds: DataFrame, rets: DataFrame, regimes: DataFrame, rvol: DataFrame,
              rules: portfolio.Rules = portfolio.Rules(), plan: Schedule = Schedule(),
              history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(trades, weekly metrics) of predictions; gated weeks are not traded, flipped ones against their sign.

    A gated week keeps its row, with the marker in place of the regime, no symbols, trades, return or
    turnover, and the features' mean IC; the book before it counts as held.
    """
    preds = stage(preds)
    gate = stage(decisions(week_inputs(preds, rets, history), plan))
    traded = sign_flipped(preds.join(gate.where(~F.col("gated")).select("week", "flipped"), "week"), F.col("flipped")).drop("flipped")
    picks = stage(portfolio.pick(traded, regimes, rules))
    trades = stage(portfolio.trades(picks, rets, rvol, rules.fee))
    return trades, stage(marked_metrics(gate, traded, trades, portfolio.turnover(picks), regimes))


def marked_metrics(gate: DataFrame, traded: DataFrame, trades: DataFrame, turnover: DataFrame, regimes: DataFrame) -> DataFrame:
    """Weekly metrics of the weeks of ``gate``, with marker rows where it is closed."""
    shut = gate.where("gated").select("week")
    symbols = traded.groupBy("week").agg(F.count(F.lit(1)).alias("n_symbols"))
    turnover = turnover.select("week", "turnover_pct").unionByName(shut.select("week", F.lit(0.0).alias("turnover_pct")))
    regimes = regimes.select("week", "regime").join(shut, "week", "left_anti").unionByName(shut.select("week", F.lit(IC_GATED).alias("regime")))
    return portfolio.weekly_metrics(gate.select("week"), portfolio.week_results(trades), gate.select("week", "ic"), turnover,
                                    regimes, symbols)
