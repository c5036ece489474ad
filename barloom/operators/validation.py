"""Statistical validation: cross-sectional regressions, multiple testing, redundancy, drift, leakage."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranks import plain_corr, spearman, value_bucket, with_rank
from ..functions.scalars import normal_cdf, ratio, t_two_sided
from ..session import stage
from .ic import melt
from .matrix import exact_sample, feature_pairs, hash_fraction, hash_text, row_key
from .layout import CHUNK_ROWS, lay_out, positions
from .resample import week_of
from .universe import complete_rows
from .weekly import sampled_times


# --- cross-sectional regression ----------------------------------------------------------------

@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve_normal(cov: pd.Series, cov_y: pd.Series, sd: pd.Series) -> pd.Series:
    """Least-squares coefficients of z-scored columns from their (co)variances; minimum norm."""
    if not len(cov):
        return pd.Series([], dtype=object)
    s = np.array(sd.tolist(), dtype=float)
    s = np.where(s == 0, 1.0, s)
    k = s.shape[1]
    gram = np.array(cov.tolist(), dtype=float).reshape(-1, k, k) / (s[:, :, None] * s[:, None, :])
    right = np.array(cov_y.tolist(), dtype=float) / s
    return pd.Series(list((np.linalg.pinv(gram, hermitian=True) @ right[:, :, None])[:, :, 0]))


def cross_section_betas(rows: DataFrame, features: Sequence[str], target: str,
                        min_symbols: int = 20) -> DataFrame:
    """(ts, feature, beta): per timestamp, demeaned target on z-scored features.

    Only the moments of a timestamp travel: they are combined map-side, and the k x k system is
    solved per timestamp afterwards.
    """
    full = complete_rows(rows, [*features, target])
    pair = lambda a, b: F.covar_pop(a, b)
    upper = {(a, b): pair(a, b) for i, a in enumerate(features) for b in features[i:]}
    cov = F.array(*[upper.get((a, b), upper.get((b, a))) for a in features for b in features])
    moments = full.groupBy("ts").agg(
        F.count(F.lit(1)).alias("n"), cov.alias("cov"),
        F.array(*[pair(f, target) for f in features]).alias("cov_y"),
        F.array(*[F.stddev_pop(f) for f in features]).alias("sd"),
    ).where(F.col("n") >= min_symbols)
    betas = moments.select("ts", _solve_normal("cov", "cov_y", "sd").alias("b"))
    names = F.array(*[F.lit(f) for f in features])
    return betas.select("ts", F.explode(F.arrays_zip(names.alias("feature"), F.col("b").alias("beta"))).alias("z")) \
        .select("ts", F.col("z.feature").alias("feature"), F.col("z.beta").alias("beta"))


def newey_west(series: DataFrame, value: str, order: str, by: Sequence[str],
               chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(by, n, mean, std, nw_se) with a Bartlett kernel of floor(n^(1/3)) lags, at least one.

    A row meets only its own lags, in a frame of that many rows; long series are cut into chunks.
    """
    rows = stage(series.where(F.col(value).isNotNull()).select(*by, order, value))
    sets = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    longest = int((sets.agg(F.max("n")).first()[0] or 0) ** (1 / 3)) + 1
    keyed = rows.join(sets, list(by)).withColumns({
        "_series": F.concat_ws("|", *by), "_x": F.col(value) - F.col("mean"),
        "_lags": F.greatest(F.lit(1), F.floor(F.pow(F.col("n"), F.lit(1 / 3)))).cast("int")})
    layout = lay_out(keyed, longest, key="_series", ts=order, chunk_rows=chunk_rows)
    before = F.collect_list("_x").over(layout.window().rowsBetween(-longest, -1))
    with_lags = layout.trim(layout.df.withColumn("_before", before))
    reach = F.least("_lags", F.size("_before"))
    cross = F.when(reach > 0, F.aggregate(
        F.sequence(F.lit(1), reach), F.lit(0.0),
        lambda acc, k: acc + 2.0 * (1.0 - k / (F.col("_lags") + 1)) * F.element_at("_before", -k))).otherwise(0.0)
    total = with_lags.groupBy(*by).agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("std").alias("std"),
        F.sum(F.col("_x") * (F.col("_x") + cross)).alias("_v"))
    se = F.when(F.col("n") < 2, 1e-12).otherwise(
        F.sqrt(F.greatest(F.col("_v") / F.col("n"), F.lit(1e-16)) / F.col("n")))
    return total.select(*by, "n", "mean", "std", se.alias("nw_se"))


def fama_macbeth(rows: DataFrame, features: Sequence[str], target: str, min_symbols: int = 20,
                 times: int | None = None, min_periods: int = 10) -> DataFrame:
    """(feature, coef_mean, coef_std, t_stat, p_value, n_periods) over all timestamps.

    A caller may ask for about ``times`` of them, taken evenly from all timestamps.
    """
    if times:
        rows = rows.join(sampled_times(rows, times), "ts", "left_semi")
    betas = cross_section_betas(rows, features, target, min_symbols)
    nw = newey_west(betas, "beta", "ts", ["feature"])
    names = rows.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    all_rows = names.join(nw, "feature", "left")
    ok = F.coalesce(F.col("n") >= min_periods, F.lit(False))
    t = F.when(F.col("nw_se") > 1e-12, ratio("mean", "nw_se")).otherwise(0.0)
    out = all_rows.select(
        "feature", F.when(ok, F.col("mean")).otherwise(0.0).alias("coef_mean"),
        F.when(ok, F.col("std")).otherwise(0.0).alias("coef_std"),
        F.when(ok, t).otherwise(0.0).alias("t_stat"),
        F.coalesce("n", F.lit(0)).alias("n_periods"))
    p = F.when(F.col("n_periods") >= min_periods,
               t_two_sided(F.col("t_stat"), (F.col("n_periods") - 1).cast("double"))).otherwise(1.0)
    return out.withColumn("p_value", p).orderBy(F.desc(F.abs("t_stat")), "feature")


def benjamini_hochberg(tests: DataFrame, alpha: float = 0.05, p: str = "p_value",
                       name: str = "feature") -> DataFrame:
    """Add ``bh_rank``, ``bh_threshold`` and ``significant``. One row per hypothesis: tens of rows."""
    w = Window.orderBy(p, name)
    everything = Window.partitionBy()
    ranked = tests.withColumn("bh_rank", F.row_number().over(w).cast("long")).withColumn(
        "bh_threshold", F.col("bh_rank") * alpha / F.count(F.lit(1)).over(everything))
    last = F.max(F.when(F.col(p) <= F.col("bh_threshold"), F.col("bh_rank"))).over(everything)
    return ranked.withColumn("_last", F.coalesce(last, F.lit(0))).withColumn(
        "significant", F.col("bh_rank") <= F.col("_last")).drop("_last")


# --- redundancy ---------------------------------------------------------------------------------

def spearman_pairs(rows: DataFrame, features: Sequence[str], sample: int | None = None,
                   seed: int = 42) -> DataFrame:
    """(feature_a, feature_b, r): rank correlation of all pairs over pooled complete rows.

    All rows count, unless the caller asks for a sample of a given size.
    """
    pooled = complete_rows(rows.select("symbol", "ts", *features), features)
    if sample:
        pooled = exact_sample(pooled, sample, seed)
    ranked = stage(pooled)
    for f in features:
        ranked = with_rank(ranked, f, (), f"_r_{f}")
    pairs = feature_pairs(features)
    one = ranked.agg(*[plain_corr(f"_r_{a}", f"_r_{b}").alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"p{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)])))


def redundant_features(pairs: DataFrame, features: Sequence[str], limit: float = 0.85) -> list[str]:
    """Later features correlated beyond the limit with an earlier kept one (k^2 numbers, on the driver)."""
    close = {(r["feature_a"], r["feature_b"]) for r in pairs.where(F.abs("r") > limit).collect()}
    dropped: list[str] = []
    for i, b in enumerate(features):
        if any((a, b) in close and a not in dropped for a in features[:i]):
            dropped.append(b)
    return dropped


def stationarity(feats: DataFrame, features: Sequence[str], last: int | None = None, min_obs: int = 100,
                 critical: float = -2.86, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(feature, mean_stat, pct_stationary, n_series): Dickey-Fuller t statistic per series, no lags.

    All symbols and all values count; with ``last`` only the newest values of each series.
    """
    long = melt(feats.select("symbol", "ts", *features), ["symbol", "ts"], features) \
        .where(F.col("value").isNotNull())
    if last:
        newest = Window.partitionBy("feature", "symbol").orderBy(F.desc("ts"))
        long = long.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= last)
    layout = lay_out(long.withColumn("_series", F.concat_ws("|", "feature", "symbol")), 1, key="_series",
                     chunk_rows=chunk_rows)
    prev = F.lag("value", 1).over(layout.window())
    steps = layout.trim(layout.df.withColumn("_prev", prev)) \
        .withColumn("_step", F.col("value") - F.col("_prev"))
    series = steps.groupBy("feature", "symbol").agg(
        F.count(F.lit(1)).alias("_obs"), F.count("_step").alias("n"),
        (F.var_pop(F.when(F.col("_step").isNotNull(), F.col("_prev"))) * F.count("_step")).alias("sxx"),
        (F.var_pop("_step") * F.count("_step")).alias("syy"),
        (F.covar_pop("_prev", "_step") * F.count("_step")).alias("sxy"),
    ).where((F.col("_obs") >= min_obs) & (F.col("sxx") > 0))
    slope = F.col("sxy") / F.col("sxx")
    resid = F.col("syy") - slope * F.col("sxy")
    stat = ratio(slope, F.sqrt(F.greatest(resid, F.lit(0.0)) / (F.col("n") - 2) / F.col("sxx")))
    return series.withColumn("stat", stat).where(F.col("stat").isNotNull()).groupBy("feature").agg(
        F.avg("stat").alias("mean_stat"),
        (F.avg((F.col("stat") < critical).cast("double")) * 100).alias("pct_stationary"),
        F.count(F.lit(1)).alias("n_series"))


def full_validation(rows: DataFrame, features: Sequence[str], target: str, alpha: float = 0.10,
                    max_corr: float = 0.85, min_symbols: int = 20, times: int | None = None,
                    sample: int | None = None) -> DataFrame:
    """One row per feature: regression, false-discovery, redundancy and stationarity verdicts."""
    fm = benjamini_hochberg(fama_macbeth(rows, features, target, min_symbols, times), alpha)
    dropped = redundant_features(spearman_pairs(rows, features, sample), features, max_corr)
    still = stationarity(rows, features)
    out = fm.join(still, "feature", "left").withColumn("redundant", F.col("feature").isin(dropped))
    return out.withColumn("valid", F.col("significant") & ~F.col("redundant"))


# --- drift --------------------------------------------------------------------------------------

def importance_drift(current: DataFrame, previous: DataFrame, top: int = 5) -> DataFrame:
    """One row: RMSE and rank correlation of importances on common features, and the top movers."""
    both = current.select("feature", F.col("importance").alias("cur")).join(
        previous.select("feature", F.col("importance").alias("prev")), "feature")
    w = lambda c: Window.orderBy(c)  # noqa: E731  (one row per feature)
    full = lambda c: w(c).rangeBetween(Window.unboundedPreceding, 0)
    rank = lambda c: (F.rank().over(w(c)) + F.count(F.lit(1)).over(full(c))) / 2.0
    moved = both.withColumns({
        "_rc": rank("cur"), "_rp": rank("prev"), "_d": F.abs(F.col("cur") - F.col("prev"))})
    place = F.row_number().over(Window.orderBy(F.desc("_d"), "feature"))
    movers = F.sort_array(F.collect_list(F.when(
        F.col("_place") <= top, F.struct(F.col("_place"), F.col("feature")))))
    return moved.withColumn("_place", place).agg(
        F.sqrt(F.avg(F.pow(F.col("cur") - F.col("prev"), F.lit(2.0)))).alias("drift_rmse"),
        plain_corr("_rc", "_rp").alias("rank_corr"),
        F.transform(movers, lambda s: s["feature"]).alias("top_movers"))


def distribution_summary(values: DataFrame, x: str) -> DataFrame:
    """Mean, deviation, skewness and excess kurtosis, all of the population."""
    return values.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
                      F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))


def ks_two_sample(a: DataFrame, b: DataFrame, x: str) -> DataFrame:
    """One row: Kolmogorov-Smirnov distance, asymptotic p-value and both sizes.

    Counts per distinct value, running sums inside value buckets, bucket totals carried over: the
    union is never sorted in one task.
    """
    freq = (
        a.select(x, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
        .unionByName(b.select(x, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
        .where(F.col(x).isNotNull()).groupBy(x).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
        .withColumn("_k", value_bucket(x))
    )
    before = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    totals = freq.groupBy("_k").agg(F.sum("_a").alias("_ta"), F.sum("_b").alias("_tb")).select(
        "_k", F.coalesce(F.sum("_ta").over(before), F.lit(0)).alias("_oa"),
        F.coalesce(F.sum("_tb").over(before), F.lit(0)).alias("_ob"))
    run = Window.partitionBy("_k").orderBy(x)
    n = F.struct(F.col("na"), F.col("nb"))
    sizes = freq.agg(F.sum("_a").cast("double").alias("na"), F.sum("_b").cast("double").alias("nb")) \
        .select(n.alias("s")).scalar()
    gaps = freq.join(totals, "_k").select(
        sizes.alias("_s"), (F.col("_oa") + F.sum("_a").over(run)).alias("_ca"),
        (F.col("_ob") + F.sum("_b").over(run)).alias("_cb"))
    gap = F.abs(F.col("_ca") / F.col("_s.na") - F.col("_cb") / F.col("_s.nb"))
    one = gaps.agg(F.max(gap).alias("ks_stat"), F.first("_s.na").alias("na"), F.first("_s.nb").alias("nb"))
    lam = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))) * F.col("ks_stat")
    tail = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    p = F.when(lam < 0.2, 1.0).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))
    return one.select("ks_stat", p.alias("p_value"), F.col("na").cast("long").alias("n_current"),
                      F.col("nb").cast("long").alias("n_previous"))


def governance(ic_in: float, ic_out: float, current: DataFrame, previous: DataFrame,
               preds: DataFrame, preds_prev: DataFrame, x: str = "pred") -> DataFrame:
    """One-row drift report with its warnings."""
    joined = importance_drift(current, previous).select(F.struct("*").alias("imp"))
    ks = ks_two_sample(preds, preds_prev, x).select(F.struct("*").alias("ks"))
    stats = distribution_summary(preds, x)
    out = stats.withColumns({"imp": joined.scalar(), "ks": ks.scalar()})
    gap = ic_in - ic_out
    notes = F.array_compact(F.array(
        F.when(F.lit(gap > 0.02), F.lit("OVERFIT")),
        F.when(F.col("imp.rank_corr") < 0.5, F.lit("DRIFT")),
        F.when(F.col("ks.p_value") < 0.01, F.lit("SHIFT"))))
    return out.select(
        F.lit(float(gap)).alias("ic_gap"), F.col("imp.drift_rmse"), F.col("imp.rank_corr"),
        F.col("imp.top_movers"), F.col("mean").alias("pred_mean"), F.col("std").alias("pred_std"),
        F.col("skew").alias("pred_skew"), F.col("kurt").alias("pred_kurt"), F.col("ks.ks_stat"),
        F.col("ks.p_value").alias("ks_p_value"), notes.alias("warnings"))


# --- leakage ------------------------------------------------------------------------------------

def leak_test(rows: DataFrame, features: Sequence[str], target: str, embargo: int = 48,
              seed: int = 42, max_shuffled: float = 0.02, min_leaked: float = 0.95) -> DataFrame:
    """One row: IC against a permuted target, against the target plus noise, and against the past.

    The permutation pairs the rows by position in a seeded-digest order, an equi-join on positions.
    """
    names = list(features)
    base = stage(row_key(complete_rows(rows.select("symbol", "ts", *names, target), [*names, target]))
                 .withColumn("_hash", hash_text(seed, ["_key"])))
    cell = F.substring("_hash", 1, 3)
    here = positions(base, ["symbol"], "ts", out="_i")
    there = positions(base.select("_hash", F.col(target).alias("_y")), ["_hash"], cell, out="_i")
    shuffled = here.join(there.select("_i", "_y"), "_i").select("_y", *names)
    null_ic = spearman(melt(shuffled, ["_y"], names), "value", "_y", ["feature"], 101)

    u1 = F.greatest(hash_fraction(hash_text(seed + 1, ["_key"])), F.lit(1e-12))
    u2 = hash_fraction(hash_text(seed + 2, ["_key"]))
    normal = F.sqrt(-2 * F.ln(u1)) * F.cos(2 * np.pi * u2)
    scale = base.agg(F.stddev_pop(target)).scalar() * 1e-6
    noisy = base.select(target, (F.col(target) + normal * scale).alias("_leak"))
    leak = spearman(noisy, "_leak", target, (), 101).select(F.col("ic").alias("_l"))

    placed = positions(base, ["ts"], week_of("ts"), ["symbol"], out="_i")
    past = placed.select("symbol", (F.col("_i") + embargo + 1).alias("_i"), F.col(target).alias("_past"))
    past_ic = spearman(placed.select("symbol", "_i", target).join(past, ["symbol", "_i"]),
                       "_past", target, (), 2).select(F.col("ic").alias("_p"))
    out = null_ic.agg(F.coalesce(F.avg(F.when(F.col("n_obs") > 100, F.abs("ic"))), F.lit(0.0))
                      .alias("shuffled_mean_abs_ic"))
    return out.withColumns({
        "leaked_feature_ic": F.coalesce(leak.scalar(), F.lit(0.0)),
        "past_feature_ic": F.coalesce(past_ic.scalar(), F.lit(0.0)),
    }).withColumns({
        "shuffled_test_pass": F.col("shuffled_mean_abs_ic") < max_shuffled,
        "leaked_test_pass": F.col("leaked_feature_ic") > min_leaked,
    })


def deflated_sharpe(runs: DataFrame, sharpe: str, n: str, skew: str, kurt: str,
                    n_trials: int) -> DataFrame:
    """Add expected maximum, deflated Sharpe, p-value and the 95 % verdict. ``kurt`` is raw kurtosis."""
    euler = 0.5772156649
    if n_trials > 1:
        root = float(np.sqrt(2 * np.log(n_trials)))
        expected = root - (euler + float(np.log(np.log(n_trials)))) / (2 * root)
    else:
        expected = 0.0
    s = F.col(sharpe)
    var = (1 - F.col(skew) * s + (F.col(kurt) - 1) / 4 * s * s) / F.greatest(F.col(n) - 1, F.lit(1))
    z = (s - expected) / F.sqrt(F.greatest(var, F.lit(1e-10)))
    return runs.withColumn("expected_max_sharpe", F.lit(expected)).withColumn(
        "deflated_sharpe", normal_cdf(z)).withColumn(
        "p_value", 1 - F.col("deflated_sharpe")).withColumn(
        "significant", F.col("deflated_sharpe") > 0.95)


def return_matrix(returns: DataFrame, symbols: Sequence[str], kind: str = "cov",
                  min_obs: int = 2) -> DataFrame:
    """(a, b, n, value): covariance or correlation of weekly returns of the given holdings.

    Weeks are laid out with one column per holding; the pair sums (over weeks where both have a
    return) are aggregates over those rows, so no table of pairs per week is emitted.
    """
    cols = {s: f"c{i}" for i, s in enumerate(symbols)}
    wide = returns.where(F.col("symbol").isin(list(symbols))).groupBy("week").agg(*[
        F.max(F.when(F.col("symbol") == s, F.col("ret"))).alias(c) for s, c in cols.items()])
    both = lambda j, c: F.when(F.col(f"_x.c{j}").isNotNull(), c)
    x = F.col("_a.x")
    # One row per (week, holding), and per row sums against every holding at once.
    rows = wide.select(F.struct(*cols.values()).alias("_x"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(c).alias("x")) for i, c in enumerate(cols.values())
    ])).alias("_a")).where(x.isNotNull())
    sums = []
    for j in range(len(symbols)):
        y = F.col(f"_x.c{j}")
        sums += [F.count(y).alias(f"n{j}"), F.sum(both(j, x)).alias(f"sx{j}"), F.sum(y).alias(f"sy{j}"),
                 F.sum(x * y).alias(f"xy{j}")]
        if kind != "cov":
            sums += [F.sum(both(j, x * x)).alias(f"xx{j}"), F.sum(y * y).alias(f"yy{j}")]
    made = rows.groupBy(F.col("_a.i").alias("i")).agg(*sums)

    def value(j: int) -> Column:
        n = F.col(f"n{j}").cast("double")
        sx, sy = F.col(f"sx{j}"), F.col(f"sy{j}")
        cross = F.col(f"xy{j}") - ratio(sx * sy, n)
        if kind == "cov":
            return ratio(cross, n - 1)
        spread = lambda s2, s1: F.greatest(s2 - ratio(s1 * s1, n), F.lit(0.0))
        return ratio(cross, F.sqrt(spread(F.col(f"xx{j}"), sx) * spread(F.col(f"yy{j}"), sy)))

    names = F.array(*[F.lit(s) for s in symbols])
    return made.select("i", F.inline(F.array(*[
        F.struct(F.lit(j).alias("j"), F.lit(s).alias("b"), F.col(f"n{j}").alias("n"), value(j).alias("value"))
        for j, s in enumerate(symbols)
    ]))).where((F.col("j") >= F.col("i")) & (F.col("n") >= min_obs)).select(
        F.get(names, F.col("i")).alias("a"), "b", "n", "value")
