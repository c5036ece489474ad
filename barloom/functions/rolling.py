"""Trailing-window statistics with a minimum count of valid rows, and exponential averages.

Every frame is Spark's sliding window: each value is computed from the rows of its own frame alone,
with the engine's one-pass moments. Differences of running sums would cost less for long frames, but
lose small spreads once a series changes level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..operators.layout import Layout, block_length
from .scalars import ratio


@dataclass(frozen=True)
class Roll:
    """One trailing statistic: ``kind`` of column ``x`` (and ``y``) over ``n`` rows."""

    kind: str
    x: str
    n: int
    min_rows: int
    y: str | None = None


def _valid(x: str, y: str | None) -> Column:
    ok = F.col(x).isNotNull()
    if y:
        ok = ok & F.col(y).isNotNull()
    return ok


def sample_skew(n: Column, g: Column) -> Column:
    return F.when(n > 2, g * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurt(n: Column, k: Column) -> Column:
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6))


def _sliding(roll: Roll, layout: Layout) -> Column:
    w = layout.last_rows(roll.n)
    x = F.col(roll.x)
    if roll.y:
        ok = _valid(roll.x, roll.y)
        a, b = F.when(ok, x), F.when(ok, F.col(roll.y))
        # corr() raises on a constant side in ANSI mode.
        value = ratio(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w))
        cnt = F.count(F.when(ok, F.lit(1))).over(w)
    else:
        cnt = F.count(x).over(w)
        if roll.kind == "skew":
            value = sample_skew(cnt, F.skewness(x).over(w))
        elif roll.kind == "kurt":
            value = sample_kurt(cnt, F.kurtosis(x).over(w))
        else:
            agg = {
                "sum": F.sum, "mean": F.avg, "std": F.stddev_samp, "std_pop": F.stddev_pop,
                "min": F.min, "max": F.max,
            }[roll.kind]
            value = agg(x).over(w)
    return F.when(cnt >= max(roll.min_rows, 1), value)


def with_rolls(layout: Layout, rolls: dict[str, Roll]) -> Layout:
    """Add every named trailing statistic; all share one partitioning and one sort."""
    return layout.with_df(layout.df.withColumns({name: _sliding(roll, layout) for name, roll in rolls.items()}))


def with_ema(layout: Layout, specs: dict[str, tuple[str, float]]) -> Layout:
    """Recursive exponential averages: name -> (input column, alpha). Needs ``in_blocks``.

    y = (1-a) y_prev + a x, the first valid value seeds, NULLs carry y while its weight keeps
    decaying. Unrolled, y is a decay factor times a running sum of x over that factor, so a running
    sum per block does it; the last value of the block before is added with its decay. What lies two
    blocks back has a weight below 1e-25 and is left out.
    """
    df, w = layout.df, layout.window()
    # Ordered by time alone, so that blocks and chunks ask for the same sort.
    block = Window.partitionBy(*layout.keys, "_blk").orderBy(layout.order[-1])
    upto_prev = layout.running(-1)
    in_block = block.rowsBetween(Window.unboundedPreceding, 0)
    keep = df.columns
    inputs = {x: f"_e_{x}" for x, _ in specs.values()}

    df = df.withColumns({
        f"{t}_last": F.last(F.when(F.col(x).isNotNull(), F.col("_pos")), ignorenulls=True)
        .over(upto_prev) for x, t in inputs.items()
    })
    step, weight = {}, {}
    for name, (x, alpha) in specs.items():
        t = inputs[x]
        gap = (F.col("_pos") - F.col(f"{t}_last")).cast("double")
        kept = F.pow(F.lit(1.0 - alpha), gap)
        # Seed rows (no value before) weigh one and do not decay anything.
        seed = F.col(f"{t}_last").isNull()
        a = F.when(seed, 1.0).otherwise(alpha / (kept + alpha))
        a = F.when(F.col(f"{t}_last") == F.col("_pos") - 1, alpha).otherwise(a)
        weight[f"_w_{name}"] = F.when(F.col(x).isNotNull(), a)
        step[f"_d_{name}"] = F.when(F.col(x).isNull() | seed, 0.0).otherwise(
            F.log1p(-F.when(F.col(f"{t}_last") == F.col("_pos") - 1, alpha)
                    .otherwise(alpha / (kept + alpha))))
    df = df.withColumns({**weight, **step})
    df = df.withColumns({f"_D_{n}": F.sum(f"_d_{n}").over(in_block) for n in specs})
    df = df.withColumns({
        f"_S_{n}": F.sum(F.coalesce(
            F.col(f"_w_{n}") * F.col(x) * F.exp(-F.col(f"_D_{n}")), F.lit(0.0))).over(in_block)
        for n, (x, _) in specs.items()
    })
    df = df.withColumns({f"_L_{n}": F.col(f"_S_{n}") * F.exp(F.col(f"_D_{n}")) for n in specs})
    next_blk = F.lead("_blk").over(w)
    df = df.withColumn("_end", next_blk.isNotNull() & (next_blk != F.col("_blk")))
    df = df.withColumns({
        f"_C_{n}": F.last(F.when(F.col("_end"), F.col(f"_L_{n}")), ignorenulls=True).over(upto_prev)
        for n in specs
    })
    out = {}
    for n, (x, _) in specs.items():
        seen = F.col(x).isNotNull() | F.col(f"{inputs[x]}_last").isNotNull()
        carried = F.coalesce(F.col(f"_C_{n}"), F.lit(0.0)) * F.exp(F.col(f"_D_{n}"))
        out[n] = F.when(seen, F.col(f"_L_{n}") + carried)
    return layout.with_df(df.withColumns(out).select(*keep, *specs))


def ema_block(alphas: list[float]) -> int:
    """Block length that suits every alpha of a feature set."""
    return min(block_length(a) for a in alphas)
