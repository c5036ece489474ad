"""Forward log returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import log_ratio
from ..spec import ENGINE_HORIZONS, BarSpec
from .layout import CHUNK_ROWS, lay_out


def forward_returns(
    bars: DataFrame, horizons: dict[str, int], chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add ln(close k bars ahead / close) for every name -> k; NULL near the end of a series."""
    layout = lay_out(bars, 0, max(horizons.values()), chunk_rows=chunk_rows)
    w = layout.window()
    ahead = {f"_t_{n}": F.lead("close", k).over(w) for n, k in horizons.items()}
    df = layout.df.withColumns(ahead).withColumns(
        {n: log_ratio(f"_t_{n}", "close") for n in horizons}
    )
    return layout.trim(df.drop(*ahead))


def cache_targets(bars: DataFrame, spec: BarSpec, **kw) -> DataFrame:
    """Targets of the feature table: four hours for ``future_ret``, then the named horizons."""
    return forward_returns(bars, {"future_ret": spec.four_hour_bars, **spec.horizons}, **kw)


def engine_targets(bars: DataFrame, **kw) -> DataFrame:
    """Targets at fixed bar counts, whatever the length of a bar."""
    return forward_returns(bars, ENGINE_HORIZONS, **kw)
