"""Text pieces shared by the check SQL."""

from __future__ import annotations

BARS_H = """bars_h as (
 select concat('S', cast(user_id % 8 as varchar)) as symbol, date_trunc('hour', ts) as ts,
  min_by(value, row(ts, event_id)) as open, max(value) as high, min(value) as low,
  max_by(value, row(ts, event_id)) as close, cast(count(*) as double) as volume
 from (select user_id, cast(ts as timestamp) as ts, event_id, value from events) group by 1, 2)"""

_TICK = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"
BARS_D = f"""bars_d as (
 select concat('L', cast(l_suppkey % 20 as varchar)) as symbol,
  date_trunc('day', cast(l_shipdate as timestamp)) as ts,
  min_by(l_extendedprice / l_quantity, {_TICK}) as open,
  max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
  max_by(l_extendedprice / l_quantity, {_TICK}) as close, sum(l_quantity) as volume
 from lineitem group by 1, 2)"""

W = "partition by symbol order by ts"


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """Rounded output column without negative zero."""
    once = f"cast(round({expr}, {digits}) as double)"
    text = f"case when {once} = 0 then cast(0 as double) else {once} end"
    return f"{text} as {name}" if name else text


def roll(agg: str, x: str, n: int, min_rows: int, part: str = W) -> str:
    frame = f"over ({part} rows between {n - 1} preceding and current row)"
    call = f"{agg}({x}) {frame}"
    return f"case when count({x}) {frame} >= {min_rows} then {call} end"


def roll_corr(x: str, y: str, n: int, min_rows: int) -> str:
    frame = f"over ({W} rows between {n - 1} preceding and current row)"
    both = f"case when {x} is not null and {y} is not null then"
    a, b = f"{both} {x} end", f"{both} {y} end"
    var = f"var_pop({a}) {frame} * var_pop({b}) {frame}"
    return (f"case when count({a}) {frame} >= {min_rows} and ({var}) > 1e-24 "
            f"then covar_pop({a}, {b}) {frame} / sqrt({var}) end")


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) over ({W})"


def ema(source: str, columns: dict[str, tuple[str, float]]) -> str:
    """Select of (symbol, ts, pos, averages) from a CTE with symbol, ts, pos: weights written out."""
    parts = []
    for name, (x, alpha) in columns.items():
        first = f"min(case when {x} is not null then pos end) over (partition by symbol)"
        parts.append((name, x, alpha, first))
    firsts = ", ".join(f"{f} as first_{n}" for n, _, _, f in parts)
    sums = ", ".join(
        f"sum(case when b.pos = b.first_{n} then 1.0 else {a!r} end "
        f"* pow({1 - a!r}, a.pos - b.pos) * b.{x}) as {n}"
        for n, x, a, _ in parts
    )
    return (f"select a.symbol, a.ts, a.pos, {sums} from {source} a join "
            f"(select *, {firsts} from {source}) b on a.symbol = b.symbol and b.pos <= a.pos "
            f"group by 1, 2, 3")


def spearman_cte(name: str, source: str, x: str, y: str, by: str, min_obs: int) -> str:
    """CTEs giving ({by}, n_obs, ic): average ranks, then Pearson; short or constant groups are 0."""
    return f"""{name}_p as (select {by}, {x} as x, {y} as y from {source}
  where {x} is not null and {y} is not null),
 {name}_r as (select {by},
  rank() over (partition by {by} order by x) + (count(*) over (partition by {by}, x) - 1) / 2.0 as rx,
  rank() over (partition by {by} order by y) + (count(*) over (partition by {by}, y) - 1) / 2.0 as ry
  from {name}_p),
 {name} as (select {by}, count(*) as n_obs, case when count(*) >= {min_obs}
   and var_pop(rx) > 0 and var_pop(ry) > 0 then corr(rx, ry) else 0.0 end as ic
  from {name}_r group by {by})"""
