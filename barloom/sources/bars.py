"""Bar tables in, feature tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import finite
from ..operators.features import FEATURES, build_features
from ..operators.targets import cache_targets
from ..operators.universe import drop_stale_epochs
from ..spec import BarSpec

TIME_COLUMNS = ("timestamp", "time", "open_time", "__index_level_0__")  # the last: an unnamed stored index
PRICE_COLUMNS = ("open", "high", "low", "close", "volume")
MIN_SYMBOL_ROWS = 50
MIN_FEATURE_SHARE = 0.8
REBUILD_BELOW = 0.8


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def _epoch(c: Column) -> Column:
    """Whole numbers by their size: milliseconds, from 1e14 on microseconds, from 1e17 on nanoseconds."""
    micros = F.when(F.abs(c) >= 10 ** 17, F.floor(c / 1000)).when(F.abs(c) >= 10 ** 14, c).otherwise(c * 1000)
    return F.timestamp_micros(micros.cast("long"))


def epoch_or_text(name: str, dtype: T.DataType) -> Column:
    """A time column as timestamp_ntz in UTC; whole numbers count from 1970."""
    c = F.col(name)
    if isinstance(dtype, T.IntegralType):
        return _epoch(c.cast("long")).cast("timestamp_ntz")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return _epoch(c.cast("long")).cast("timestamp_ntz")
    if isinstance(dtype, T.StringType):
        return F.try_to_timestamp(c).cast("timestamp_ntz")
    return c.cast("timestamp_ntz")


def with_time(df: DataFrame) -> DataFrame:
    """Replace the known time columns by ``ts``: in each row the first of them that is set."""
    named = ["ts"] if "ts" in df.columns else [c for c in TIME_COLUMNS if c in df.columns]
    if not named:
        raise ValueError(f"no time column among {df.columns}")
    ts = F.coalesce(*[epoch_or_text(c, df.schema[c].dataType) for c in named])
    return df.withColumn("ts", ts).drop(*[c for c in named if c != "ts"])


def clean_bars(df: DataFrame, first_year: int = 2018) -> DataFrame:
    """bars(symbol, ts, OHLCV) from a raw table: names, time, missing values, broken epochs."""
    df = with_time(lower_names(df))
    missing = [c for c in ("symbol", *PRICE_COLUMNS) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    df = df.select("symbol", "ts", *[finite(F.col(c).cast("double")).alias(c) for c in PRICE_COLUMNS])
    stated = F.coalesce("ts", F.raise_error(F.concat(F.lit("a row without time of symbol "), "symbol")).cast("timestamp_ntz"))
    return drop_stale_epochs(df.withColumn("ts", stated), first_year)


def read_symbol_files(spark: SparkSession, folder: str, first_year: int = 2018) -> DataFrame:
    """One parquet file per symbol; the symbol is the file name without its ending.

    Files may name their time column differently; a row without any is an error, and so is a missing
    or empty folder. Nanosecond times are read as numbers, which Spark does only under the setting
    that ``build_session`` makes.
    """
    raw = lower_names(spark.read.option("mergeSchema", "true").parquet(folder))
    name = F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)\.parquet$", 1)
    return clean_bars(raw.withColumn("symbol", name), first_year)


def symbol_metadata(df: DataFrame, required: Sequence[str] = (), min_rows: int = MIN_SYMBOL_ROWS) -> DataFrame:
    """(symbol, first, last, n) of the symbols with more than ``min_rows`` rows.

    Required columns are checked against the schema: no row is read for that.
    """
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.groupBy("symbol").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")
    ).where(F.col("n") > min_rows)


def coverage(raw: DataFrame, feats: DataFrame, min_rows: int = MIN_SYMBOL_ROWS,
             rebuild_below: float = REBUILD_BELOW) -> DataFrame:
    """One row: raw symbols, symbols with a usable feature series, invalid ones, rebuild advice."""
    have = symbol_metadata(feats, min_rows=min_rows).select("symbol", F.lit(1).alias("ok"))
    cached = feats.select("symbol").distinct().withColumn("cached", F.lit(1))
    both = raw.select("symbol").distinct().withColumn("raw", F.lit(1)).join(
        cached.join(have, "symbol", "left"), "symbol", "full_outer")
    out = both.agg(F.count("raw").alias("n_raw"), F.count("cached").alias("n_cached"),
                   F.count("ok").alias("n_valid"))
    ratio = F.col("n_valid") / F.greatest(F.col("n_raw"), F.lit(1))
    return out.withColumns({"n_invalid": F.col("n_cached") - F.col("n_valid"),
                            "rebuild": ratio < rebuild_below})


def load_columns(df: DataFrame, columns: Sequence[str], symbols: Sequence[str] | None = None) -> DataFrame:
    """Requested columns once each; symbol and column pruning reach the scan."""
    have = [c for c in dict.fromkeys(["symbol", "ts", *columns]) if c in df.columns]
    return (df.where(F.col("symbol").isin(list(symbols))) if symbols else df).select(*have)


def pending_symbols(bars: DataFrame, built: DataFrame | None, overwrite: bool = False) -> DataFrame:
    """Bars of symbols that have no features yet."""
    if built is None or overwrite:
        return bars
    return bars.join(built.select("symbol").distinct(), "symbol", "left_anti")


def feature_table(bars: DataFrame, spec: BarSpec = BarSpec(), features: Sequence[str] = FEATURES,
                  **options) -> DataFrame:
    """Features, close and forward returns side by side, computed from one scan of the bars."""
    horizons = ["future_ret", *spec.horizons]
    with_targets = cache_targets(bars, spec)
    return build_features(with_targets, spec, features, keep=("close", *horizons), **options)


def storable(df: DataFrame, features: Sequence[str] = FEATURES,
             min_share: float = MIN_FEATURE_SHARE) -> DataFrame:
    """Rows with enough non-null features, numbers as float32."""
    filled = sum((F.col(f).isNotNull().cast("int") for f in features), F.lit(0))
    kept = df.where(filled >= int(min_share * len(features)))
    numbers = [c for c, t in df.dtypes if t == "double"]
    return kept.withColumns({c: F.col(c).cast("float") for c in numbers})


def storable_any(df: DataFrame, features: Sequence[str] = FEATURES, min_rows: int = 20) -> DataFrame:
    """Rows with at least one feature, of symbols with at least ``min_rows`` such rows."""
    kept = df.na.drop(how="all", subset=list(features))
    long_enough = kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") >= min_rows).select("symbol")
    return kept.join(long_enough, "symbol", "left_semi")


def write_features(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by symbol. The rebalance hint gathers a symbol's rows and splits the large ones.

    Overwriting replaces only the symbols present in ``df``.
    """
    (df.hint("rebalance", "symbol").write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .option("compression", "snappy").partitionBy("symbol").parquet(path))


def read_features(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


KLINE_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("open_time", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in PRICE_COLUMNS])


def parse_klines(df: DataFrame) -> DataFrame:
    """Feed rows to bars: text to numbers, unusable rows out, each (symbol, open_time) once."""
    numbers = [F.col(c).try_cast("double").alias(c) for c in PRICE_COLUMNS]
    bars = df.select("symbol", F.timestamp_millis("open_time").cast("timestamp_ntz").alias("ts"), *numbers)
    values = F.struct(*PRICE_COLUMNS)  # of several rows for one time the largest, whatever their order
    return bars.na.drop(how="any").groupBy("symbol", "ts").agg(F.max(values).alias("_v")).select("symbol", "ts", "_v.*")


def live_features(bars: DataFrame, spec: BarSpec, model_features: Sequence[str], min_bars: int = 500,
                  **options) -> DataFrame:
    """Model features, close and rvol_1d of symbols with enough bars, without all-null rows."""
    from ..operators.universe import enough_history

    wanted = list(dict.fromkeys([*model_features, "rvol_1d"]))
    feats = build_features(enough_history(bars, min_bars), spec, wanted, **options)
    return feats.na.drop(how="all", subset=list(model_features))
