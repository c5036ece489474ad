"""Turnover-capped feature-set updates and their overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Features judged only in sideways regimes, and those regimes.
MEAN_REVERSION = ("rsi_14", "mean_rev_zscore_1h", "bb_pos")
SIDEWAYS = ("LOW_VOL_GRIND", "HIGH_VOL_LATERAL")


def propose_update(history: DataFrame, active: Sequence[str], core: Sequence[str],
                   candidates: Sequence[str], last: int = 4, max_turnover: int = 3,
                   enforce_cap: bool = True) -> DataFrame:
    """(feature, status, in_set) from history(week, feature, ic, regime).

    The newest ``last`` observations count. Three negative ones remove an active non-core feature,
    two positive ones (or none that counts) admit a candidate, best mean first; removals use the turnover
    budget before additions. ``enforce_cap=False`` drops every removal whatever the budget.
    One row per feature: the unpartitioned windows see tens of rows.
    """
    spark = history.sparkSession
    names = list(dict.fromkeys([*core, *active, *candidates]))
    flags = spark.createDataFrame(
        [(n, n in core, n in active, n in candidates, i) for i, n in enumerate(names)],
        "feature string, core boolean, active boolean, candidate boolean, place int")
    newest = Window.partitionBy("feature").orderBy(F.desc("week"))
    recent = history.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= last)
    counts = ~F.col("feature").isin(*MEAN_REVERSION) | F.col("regime").isin(*SIDEWAYS)
    stats = recent.groupBy("feature").agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(counts).alias("n"),
        F.count_if(counts & (F.col("ic") < 0)).alias("neg"), F.count_if(counts & (F.col("ic") > 0)).alias("pos"),
        F.coalesce(F.avg(F.when(counts, F.col("ic"))), F.lit(0.0)).alias("mean_ic"))
    df = flags.join(stats, "feature", "left").na.fill(0, ["seen", "n", "neg", "pos"]).na.fill(0.0, ["mean_ic"])
    remove = F.col("active") & ~F.col("core") & (F.col("seen") >= 3) & (F.col("neg") >= 3)
    add = (
        F.col("candidate") & ~F.col("core") & (~F.col("active") | remove) & (F.col("seen") >= 2)
        & ((F.col("n") == 0) | (F.col("pos") >= 2))
    )
    df = df.withColumns({"_remove": remove, "_add": add})
    in_order = Window.orderBy(F.desc("_remove"), "place")
    by_ic = Window.orderBy(F.desc("_add"), F.desc("mean_ic"), "place")
    df = df.withColumns({
        "_rm_rank": F.row_number().over(in_order), "_add_rank": F.row_number().over(by_ic),
        "_n_rm": F.least(F.sum(F.col("_remove").cast("int")).over(Window.partitionBy()), F.lit(max_turnover)),
    })
    gone = F.col("_remove") & (F.lit(not enforce_cap) | (F.col("_rm_rank") <= max_turnover))
    added = F.col("_add") & (F.col("_add_rank") <= max_turnover - F.col("_n_rm"))
    status = (
        F.when(F.col("core"), "CORE").when(added, "ADDED").when(gone, "REMOVED")
        .when(F.col("active"), "KEPT").otherwise("OUT")
    )
    return df.select("feature", status.alias("status"), status.isin("CORE", "ADDED", "KEPT").alias("in_set"))


def jaccard_overlap(sets: DataFrame) -> DataFrame:
    """One row: mean overlap of consecutive sets in sets(step, feature); 1 with fewer than two."""
    packed = sets.groupBy("step").agg(F.collect_set("feature").alias("s"))  # one row per retrain
    prev = F.lag("s").over(Window.orderBy("step"))
    each = packed.select((F.size(F.array_intersect("s", prev)) / F.size(F.array_union("s", prev))).alias("j"))
    return each.agg(F.coalesce(F.avg("j"), F.lit(1.0)).alias("jaccard"))
