"""Symbol universe, time ranges and row filters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite

# Instruments never traded, and bases pegged to a currency.
BLACKLIST = ["FTTUSDT", "EURUSDT", "USDCUSDT", "USDPUSDT", "FDUSDUSDT", "TUSDUSDT", "BUSDUSDT"]
PEGGED_BASES = ["AEUR", "BFUSD", "BUSD", "DAI", "EURI", "EUR", "FDUSD", "FRAX", "PYUSD", "RLUSD",
                "TUSD", "USD1", "USDC", "USDE", "USDP", "UST", "USTC", "XUSD"]
QUOTE = "USDT"


def is_excluded(symbol: str | Column, blacklist: Iterable[str] = BLACKLIST,
                pegged: Iterable[str] = PEGGED_BASES, quote: str = QUOTE) -> Column:
    """True for blacklisted symbols and pegged bases; the lists are constants, so no join."""
    s = F.upper(F.trim(F.col(symbol) if isinstance(symbol, str) else symbol))
    base = F.regexp_replace(s, f"{quote}$", "")
    return s.isin(list(blacklist)) | (s.endswith(quote) & base.isin(list(pegged)))


def tradeable(df: DataFrame, symbol: str = "symbol", **lists) -> DataFrame:
    return df.where(~is_excluded(symbol, **lists))


def pin_universe(df: DataFrame, names: str, symbol: str = "symbol") -> DataFrame:
    """Keep the symbols of a comma-separated list (any case, blanks ignored)."""
    wanted = [n.strip().upper() for n in names.split(",") if n.strip()]
    return df.where(F.upper(F.col(symbol)).isin(wanted)) if wanted else df


def trading_symbols(exchange: DataFrame, quote: str = QUOTE) -> DataFrame:
    return exchange.where((F.col("status") == "TRADING") & (F.col("quote") == quote)).select("symbol")


def live_universe(trained: DataFrame, trading: DataFrame, **lists) -> DataFrame:
    """Trained symbols that trade now, without the excluded ones."""
    return tradeable(trained.select("symbol").distinct(), **lists).join(
        trading.select("symbol"), "symbol", "left_semi")


def in_range(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Half-open time range; a plain predicate, so it reaches the scan."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v).cast("timestamp_ntz")
    return df.where((F.col(ts) >= lit(start)) & (F.col(ts) < lit(end)))


def training_window(df: DataFrame, end, weeks: int, embargo_minutes: int = 60) -> DataFrame:
    """Rows of the last ``weeks`` before ``end``, less the embargo."""
    end = F.lit(end).cast("timestamp_ntz")
    return in_range(
        df, end - F.expr(f"INTERVAL {7 * weeks} DAYS"),
        end - F.expr(f"INTERVAL {embargo_minutes} MINUTES"))


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where all columns are present and finite."""
    cleaned = df.withColumns({c: finite(c) for c in columns if dict(df.dtypes)[c] in ("double", "float")})
    return cleaned.na.drop(how="any", subset=list(columns))


def enough_history(df: DataFrame, min_rows: int, key: str = "symbol") -> DataFrame:
    """Symbols with at least ``min_rows`` rows. A count per symbol, then a semi join.

    The count is combined map-side; no window has to gather a symbol in one task.
    """
    long_enough = df.groupBy(key).count().where(F.col("count") >= min_rows).select(key)
    return df.join(long_enough, key, "left_semi")


def drop_stale_epochs(bars: DataFrame, first_year: int = 2018) -> DataFrame:
    """Without the symbols whose newest bar predates ``first_year`` (broken epoch units)."""
    ok = (
        bars.groupBy("symbol").agg(F.max("ts").alias("last"))
        .where(F.year("last") >= first_year).select("symbol")
    )
    return bars.join(ok, "symbol", "left_semi")


def warmup_masked(value: Column, position: Column, rows: int) -> Column:
    return F.when(position < rows, 0.0).otherwise(value)


def market_proxy(bars: DataFrame, preferred: Sequence[str] = ("BTCUSDT", "ETHUSDT"),
                 fallback: bool = True) -> DataFrame:
    """Bars of the market proxy: the first preferred symbol present, else the longest series."""
    counts = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    prio = F.lit(len(preferred))
    for i, name in reversed(list(enumerate(preferred))):
        prio = F.when(F.col("symbol") == name, i).otherwise(prio)
    ranked = counts.withColumn("prio", prio)
    if not fallback:
        ranked = ranked.where(F.col("prio") < len(preferred))
    chosen = ranked.orderBy("prio", F.desc("n"), "symbol").limit(1).select("symbol")
    return bars.join(F.broadcast(chosen), "symbol", "left_semi")  # one row
