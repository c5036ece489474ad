"""Live operators as Structured Streaming: bars, alerts, online averages, account state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from ..sources.bars import KLINE_SCHEMA, PRICE_COLUMNS
from ..functions.scalars import ratio


def kline_stream(spark: SparkSession, path: str, late: str = "1 hour", fmt: str = "json",
                 schema: T.StructType = KLINE_SCHEMA, files_per_batch: int = 1000) -> DataFrame:
    """Bar feed from files landing in a folder; each (symbol, open time) passes once.

    ``files_per_batch`` bounds a micro-batch, and with it what a stateful operator gets per symbol.
    """
    raw = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
           .format(fmt).load(path))
    numbers = [F.col(c).try_cast("double").alias(c) for c in PRICE_COLUMNS]
    bars = raw.select("symbol", F.timestamp_millis("open_time").alias("ts"), *numbers).na.drop(how="any")
    return deduplicated(bars, late)


def deduplicated(bars: DataFrame, late: str = "1 hour") -> DataFrame:
    return bars.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "ts"])


def tumbling_bars(ticks: DataFrame, width: str = "5 minutes", late: str = "10 minutes",
                  price: str = "price", size: str | None = None, tie: str | None = None) -> DataFrame:
    """OHLCV bars of ticks(symbol, ts, price), closed by the watermark (append mode).

    ``tie`` orders ticks of one instant.
    """
    order = F.struct("ts", tie) if tie else F.col("ts")
    volume = F.sum(size) if size else F.count(F.lit(1)).cast("double")
    return (
        ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"),
             F.min(price).alias("low"), F.max_by(price, order).alias("close"), volume.alias("volume"))
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def volume_alerts(bars: DataFrame, span: str = "1 day", slide: str = "1 hour", late: str = "1 hour",
                  threshold: float = 2.5, min_rows: int = 6) -> DataFrame:
    """Sliding-window z-score of the newest bar's volume; rows above the threshold are alerts."""
    agg = bars.withWatermark("ts", late).groupBy("symbol", F.window("ts", span, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("volume").alias("mean"), F.stddev_samp("volume").alias("std"),
        F.max_by("volume", "ts").alias("last_volume"))
    z = ratio(F.col("last_volume") - F.col("mean"), "std")
    return agg.where(F.col("n") >= min_rows).select(
        "symbol", F.col("w.end").alias("at"), "n", z.alias("volume_z"),
        F.coalesce(z > threshold, F.lit(False)).alias("alert"))


def latest_prices(bars: DataFrame) -> DataFrame:
    """Newest close per symbol (update or complete mode)."""
    return bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("price"), F.max("ts").alias("as_of"))


ONLINE_SCHEMA = "symbol string, ts timestamp, close double, ema double, rsi double"
_ONLINE_STATE = "close double, ema double, gain double, loss double, n long, last_ts long"


def online_averages(bars: DataFrame, span: int = 12, rsi: int = 14) -> DataFrame:
    """Running EMA and RSI per symbol with a few numbers of state (append mode).

    A micro-batch holds the new bars of a symbol only; rows not newer than the state are late and
    are passed over.
    """
    a, b = 2.0 / (span + 1), 1.0 / rsi

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        close, ema, gain, loss, n, last = state.get if state.exists else (0.0, 0.0, 0.0, 0.0, 0, -1)
        pdf = pd.concat(list(frames)).sort_values("ts")
        out = []
        for ts, c in zip(pdf["ts"], pdf["close"]):
            if ts.value <= last:
                continue
            if n == 0:
                ema = c
            else:
                up, down = max(c - close, 0.0), max(close - c, 0.0)
                ema += a * (c - ema)
                gain = up if n == 1 else gain + b * (up - gain)
                loss = down if n == 1 else loss + b * (down - loss)
            close, n, last = c, n + 1, ts.value
            strength = None if n < 2 or loss == 0 else 1.0 - 1.0 / (1.0 + gain / loss)
            out.append((key[0], ts, c, ema, strength))
        state.update((float(close), float(ema), float(gain), float(loss), int(n), int(last)))
        yield pd.DataFrame(out, columns=["symbol", "ts", "close", "ema", "rsi"])

    return bars.select("symbol", "ts", "close").groupBy("symbol").applyInPandasWithState(
        step, ONLINE_SCHEMA, _ONLINE_STATE, "append", "NoTimeout")


def marked_positions(bars: DataFrame, positions: DataFrame) -> DataFrame:
    """Stream of bars joined to the static positions: unrealised PnL at every bar."""
    move = F.col("close") / F.col("entry_price") - 1.0
    pnl = F.col("size_usd") * F.when(F.col("side") == "LONG", move).otherwise(-move)
    return bars.join(positions, "symbol").select("symbol", "ts", "side", pnl.alias("unrealised"))


PAUSE_SCHEMA = "account string, ts timestamp, equity double, drawdown double, paused boolean"


def pause_stream(equity: DataFrame, pause: float = -0.20, resume: float = -0.12) -> DataFrame:
    """Drawdown hysteresis per account over a stream of (account, ts, equity)."""
    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        peak, paused = state.get if state.exists else (0.0, False)
        out = []
        for ts, value in pd.concat(list(frames)).sort_values("ts")[["ts", "equity"]].itertuples(index=False):
            drawdown = value / peak - 1.0 if peak > 0 else 0.0
            paused = drawdown <= pause or (paused and drawdown < resume)
            peak = max(peak, value)
            out.append((key[0], ts, value, drawdown, paused))
        state.update((float(peak), bool(paused)))
        yield pd.DataFrame(out, columns=["account", "ts", "equity", "drawdown", "paused"])

    return equity.select("account", "ts", "equity").groupBy("account").applyInPandasWithState(
        step, PAUSE_SCHEMA, "peak double, paused boolean", "append", "NoTimeout")


def rebalance_due(last_rebalance, now, days: int = 7, force: bool = False, paused: bool = False) -> bool:
    """Is a rebalance due: forced, never done, or ``days`` old; never while paused."""
    if paused:
        return False
    return force or last_rebalance is None or (now - last_rebalance).total_seconds() >= days * 86400


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, append it to a parquet table, stop."""
    query = (stream.writeStream.outputMode(mode).format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def run_batches(stream: DataFrame, checkpoint: str, handle, mode: str = "update") -> None:
    """Process what is there, handing each micro-batch to ``handle(df, batch_id)``."""
    query = (stream.writeStream.outputMode(mode).foreachBatch(handle)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
