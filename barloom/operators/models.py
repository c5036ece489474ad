"""Models on Spark ML: scaling, purged walk-forward folds, boosted trees, elastic net, confidence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import RobustScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import spearman
from ..session import stage
from .ic import row_positions
from .matrix import hash_text, row_key
from .layout import positions
from .moments import ElasticPath


@dataclass(frozen=True)
class TreeParams:
    """Boosted-tree settings; the defaults are the primary model's."""

    trees: int = 500
    rate: float = 0.03
    depth: int = 3
    min_leaf: int = 200
    row_share: float = 0.6
    column_share: float = 0.8
    holdout: float = 0.1
    seed: int = 42


PRIMARY = TreeParams()
CHALLENGER = replace(PRIMARY, rate=0.05, min_leaf=100, row_share=0.7)
EXPANDING = TreeParams(trees=1000, rate=0.02, depth=4, min_leaf=50, row_share=0.8, column_share=0.7)


def fold_bounds(n: int, k: int, gap: int, reserve_gaps: bool = True) -> list[tuple[int, int, int]]:
    """(train_end, val_start, val_end) of each walk-forward fold over n time-ordered rows.

    With ``reserve_gaps`` the purge gaps are taken off the row budget first (and must fit).
    """
    usable = n - 2 * gap * k if reserve_gaps else n
    if usable <= 0:
        raise ValueError(f"{n} rows are too few for {k} folds with a gap of {gap}")
    size = usable // (k + 1)
    folds = [((i + 1) * size, (i + 1) * size + gap, (i + 2) * size + gap) for i in range(k)]
    return [f for f in folds if f[2] <= n]


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Rows with their time-ordered position ``_i``, written once: every fold filters it."""
    return stage(row_positions(rows, ["ts", "symbol"]))


def folds(ordered: DataFrame, k: int = 5, gap: int = 48, reserve_gaps: bool = True):
    n = ordered.count()
    for end, lo, hi in fold_bounds(n, k, gap, reserve_gaps):
        yield ordered.where(F.col("_i") < end), ordered.where((F.col("_i") >= lo) & (F.col("_i") < hi))


def _front(features: Sequence[str]) -> list:
    return [
        VectorAssembler(inputCols=list(features), outputCol="_raw"),
        RobustScaler(inputCol="_raw", outputCol="features", withCentering=True, withScaling=True),
    ]


def robust_scaler(rows: DataFrame, features: Sequence[str]) -> PipelineModel:
    """Median and interquartile scaling; Spark ML keeps approximate quantile sketches."""
    return Pipeline(stages=_front(features)).fit(rows)


def scaled(model: PipelineModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    arr = vector_to_array("features")
    out = model.transform(rows)
    return out.select("symbol", "ts", *[arr[i].alias(f) for i, f in enumerate(features)])


def fit_trees(rows: DataFrame, features: Sequence[str], target: str,
              p: TreeParams = PRIMARY, classify: bool = False) -> PipelineModel:
    """Gradient-boosted trees; the last ``holdout`` share of the rows (by ``_i``) stops the boosting."""
    kind = GBTClassifier if classify else GBTRegressor
    model = kind(
        featuresCol="features", labelCol=target, maxIter=p.trees, stepSize=p.rate, maxDepth=p.depth,
        minInstancesPerNode=p.min_leaf, subsamplingRate=p.row_share,
        featureSubsetStrategy=str(p.column_share), seed=p.seed)
    if "_i" in rows.columns and p.holdout:
        edge = rows.agg(F.max("_i").alias("m"), F.min("_i").alias("l")).first()
        cut = edge["m"] - int((edge["m"] - edge["l"] + 1) * p.holdout)
        rows = rows.withColumn("_stop", F.col("_i") > cut)
        model = model.setValidationIndicatorCol("_stop")
    return Pipeline(stages=[*_front(features), model]).fit(rows)


def fit_elastic_net(rows: DataFrame, features: Sequence[str], target: str, alpha: float,
                    l1_share: float) -> PipelineModel:
    net = LinearRegression(featuresCol="features", labelCol=target, regParam=alpha,
                           elasticNetParam=l1_share, standardization=False, solver="normal")
    return Pipeline(stages=[*_front(features), net]).fit(rows)


def predict(model: PipelineModel, rows: DataFrame, out: str = "pred") -> DataFrame:
    """Score rows; for a classifier the probability of the positive class."""
    scored = model.transform(rows)
    value = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
    return scored.withColumn(out, value).select(*rows.columns, out)


def quality(scored: DataFrame, target: str, pred: str = "pred") -> dict:
    """Rank IC and R2 of scored rows."""
    ic = spearman(scored, pred, target, (), 10).first()
    err = F.pow(F.col(target) - F.col(pred), F.lit(2.0))
    fit = scored.agg((1 - F.sum(err) / (F.var_pop(target) * F.count(target))).alias("r2"), F.avg(err).alias("mse")).first()
    return {"ic": float(ic["ic"]) if ic else 0.0, "r2": float(fit["r2"] or 0.0), "mse": float(fit["mse"] or 0.0),
            "n": int(ic["n_obs"]) if ic else 0}


def cross_validate(ordered: DataFrame, target: str, fit, k: int = 5, gap: int = 48,
                   reserve_gaps: bool = True) -> dict:
    """Mean IC, ICIR, R2 and squared error over purged folds; ``fit(train) -> model``."""
    scores = [
        quality(stage(predict(fit(train), val)), target)
        for train, val in folds(ordered, k, gap, reserve_gaps)
    ]
    ics = [s["ic"] for s in scores]
    mean = sum(ics) / max(len(ics), 1)
    spread = (sum((i - mean) ** 2 for i in ics) / max(len(ics), 1)) ** 0.5
    return {"ic": mean, "icir": mean / spread if spread > 1e-10 else 0.0,
            "r2": sum(s["r2"] for s in scores) / max(len(scores), 1),
            "mse": sum(s["mse"] for s in scores) / max(len(scores), 1), "folds": len(scores)}


def train_trees(rows: DataFrame, features: Sequence[str], target: str, p: TreeParams = PRIMARY,
                k: int = 5, gap: int = 48) -> tuple[PipelineModel, dict]:
    ordered = ordered_rows(rows)
    cv = cross_validate(ordered, target, lambda t: fit_trees(t, features, target, p), k, gap)
    return fit_trees(ordered, features, target, p), cv


def alpha_grid(top: float, n: int = 20, floor: float = 0.001, span: float = 1e-3) -> list[float]:
    """Geometric grid from ``top`` down to ``top * span``, floored."""
    step = span ** (1 / max(n - 1, 1))
    return sorted({max(top * step ** i, floor) for i in range(n)}, reverse=True)


def train_elastic_net(rows: DataFrame, features: Sequence[str], target: str,
                      l1_shares: Sequence[float] = (0.5, 0.7, 0.9, 0.95, 0.99),
                      alphas: Sequence[float] | None = None, k: int = 5, gap: int = 48
                      ) -> tuple[PipelineModel, dict]:
    """(l1 share, alpha) with the smallest mean error over the folds, then one fit on everything.

    The IC reported is that of the chosen point, not the best of the grid.
    All penalties and folds come from moments (``ElasticPath``): the rows are read four times in all.
    """
    ordered = ordered_rows(rows)
    path = ElasticPath(ordered, features, target, fold_bounds(ordered.count(), k, gap), l1_shares, list(alphas or alpha_grid(0.1)))
    share, alpha = path.best()
    held = path.held_out(ordered, (share, alpha))
    ics = {r["fold"]: float(r["ic"] or 0.0) for r in spearman(held, "pred", target, ["fold"], 10).collect()}  # one row a fold
    r2 = held.groupBy("fold").agg((1 - F.avg(F.pow(F.col(target) - F.col("pred"), F.lit(2.0))) / F.var_pop(target)).alias("r2"))
    n = len(path.folds)
    mean = sum(ics.values()) / n
    spread = ((sum(i * i for i in ics.values()) / n) - mean ** 2) ** 0.5 if n else 0.0
    best = {"ic": mean, "icir": mean / spread if spread > 1e-10 else 0.0, "r2": float(r2.agg(F.sum("r2")).first()[0] or 0.0) / n,
            "mse": path.errors[share, alpha], "folds": n, "alpha": alpha, "l1_share": share}
    return fit_elastic_net(ordered, features, target, alpha, share), best


def choose_model(tree: dict, net: dict, margin: float = 0.005) -> str:
    return "elastic_net" if net["ic"] > tree["ic"] + margin else "trees"


def adopt_retrain(cv: dict) -> bool:
    return cv["ic"] > 0


def train_confidence(rows: DataFrame, features: Sequence[str], target: str,
                     base: TreeParams = PRIMARY, conf: TreeParams = PRIMARY, k: int = 5,
                     gap: int = 48, min_rows: int = 200) -> PipelineModel | None:
    """Classifier of P(sign of the prediction is right), trained on out-of-fold predictions."""
    ordered = ordered_rows(rows)
    parts = [
        predict(fit_trees(train, features, target, base), val)
        for train, val in folds(ordered, k, gap)
    ]
    if not parts:
        return None
    oos = parts[0]
    for p in parts[1:]:
        oos = oos.unionByName(p)
    oos = stage(oos.withColumn(
        "_right", (F.signum("pred") == F.signum(F.col(target))).cast("double")))
    if oos.count() < min_rows:
        return None
    return fit_trees(oos, [*features, "pred"], "_right", conf, classify=True)  # ``_i`` keeps the stop set


def area_under_curve(scored: DataFrame, label: str, score: str = "pred") -> float:
    return BinaryClassificationEvaluator(
        rawPredictionCol=score, labelCol=label, metricName="areaUnderROC").evaluate(scored)


def importances(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """(feature, importance), largest first: tree gains, or absolute coefficients of a linear model."""
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = [(f, abs(float(values[i]))) for i, f in enumerate(features)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def permutation_importance(model: PipelineModel, rows: DataFrame, features: Sequence[str], target: str,
                           seed: int = 42) -> DataFrame:
    """(feature, ic, drop): loss of IC when one column is permuted.

    A column is permuted by pairing row positions with positions in a seeded-digest order. Each row is scored
    once as it is and once for each feature with that one value swapped, all in one pass and one grouped rank.
    """
    keyed = row_key(rows.select("symbol", "ts", *features, target)).withColumn(
        "_hash", hash_text(seed, ["_key"]))
    base = stage(positions(keyed, ["symbol"], "ts", out="_i"))
    other = positions(base.drop("_i"), ["_hash"], F.substring("_hash", 1, 3), out="_i").select(
        "_i", F.struct(*features).alias("_other"))
    tries = F.array(*[
        F.struct(F.lit(swap).alias("_swap"), *[(F.col(f"_other.{f}") if f == swap else F.col(f)).alias(f) for f in features])
        for swap in ("", *features)])
    mixed = base.join(other, "_i").select(target, F.explode(tries).alias("_t")).select(target, "_t.*")
    ics = spearman(predict(model, mixed), "pred", target, ["_swap"], 10).select("_swap", F.coalesce("ic", F.lit(0.0)).alias("ic"))
    ics = {r["_swap"]: float(r["ic"]) for r in ics.collect()}  # one row a feature
    table = base.sparkSession.createDataFrame(
        [(f, ics.get(f, 0.0), ics.get("", 0.0) - ics.get(f, 0.0)) for f in features], "feature string, ic double, drop double")
    return table.orderBy(F.desc("drop"), "feature")


def weekly_predictions(model: PipelineModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(symbol, week, pred): mean score of the complete last rows before each week."""
    return predict(model, rows.na.drop(how="any", subset=list(features))).groupBy("symbol", "week").agg(
        F.avg("pred").alias("pred"))


def walk_forward_schedule(weeks: DataFrame, retrain_every: int = 4, ic_every: int = 2) -> DataFrame:
    """Which weeks retrain and which measure feature ICs."""
    return weeks.withColumns({
        "retrain": F.col("week") % retrain_every == 0,
        "measure_ic": (F.col("week") > 1) & (F.col("week") % ic_every == 0),
    })


def sign_flipped(preds: DataFrame, flip: bool | Column) -> DataFrame:
    """Predictions, negated always or where ``flip`` holds (e.g. recent live IC below zero)."""
    cond = flip if isinstance(flip, Column) else F.lit(flip)
    return preds.withColumn("pred", F.when(cond, -F.col("pred")).otherwise(F.col("pred")))
