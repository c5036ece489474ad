"""Sources, sinks, run store, models and streams over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import models, reports, targets
from ..operators.features import FAMILIES
from ..operators.moments import ElasticPath
from ..operators.targets import forward_returns
from ..operators.weekly import last_rows
from ..session import shared_folder, stage
from ..spec import ENGINE_HORIZONS, target_plan
from ..sources import bars as source
from ..sources import runs as store
from ..sources.fixtures import HOURLY_SPEC, daily_bars, hourly_bars, table
from ..streaming import live
from .sql import BARS_D, BARS_H, W, lag, r
from .weekly_queries import FEAT_D, FEATS, MATRIX_H, _complete_matrix, daily_features


def _scratch(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks -------------------------------------------------------------------------

def normalised_times(spark, sf):
    """Epoch milliseconds, text and native times of the same events must agree."""
    ev = table(spark, sf, "events").select("event_id", F.date_trunc("second", "ts").alias("t"))
    as_ms = ev.select("event_id", F.unix_millis("t").alias("Open_Time"))
    as_text = ev.select("event_id", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("Time"))
    native = ev.select("event_id", F.col("t").cast("timestamp_ntz").alias("Timestamp"))
    parts = [source.with_time(source.lower_names(d)).select("event_id", "ts") for d in (as_ms, as_text, native)]
    both = parts[0].join(parts[1].withColumnRenamed("ts", "ts_text"), "event_id").join(
        parts[2].withColumnRenamed("ts", "ts_native"), "event_id")
    return both


def symbol_metadata(spark, sf):
    return source.symbol_metadata(hourly_bars(spark, sf), ["close", "volume"], 590)


def store_coverage(spark, sf):
    bars = hourly_bars(spark, sf)
    feats = bars.where(~F.col("symbol").isin("S1", "S2") & (F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-25 00:00:00"))))
    short = feats.where((F.col("symbol") != "S3") | (F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-02 00:00:00"))))
    return source.coverage(bars, short)


def pending_symbols(spark, sf):
    bars = hourly_bars(spark, sf)
    built = bars.where(F.col("symbol").isin("S0", "S5"))
    return source.pending_symbols(bars, built).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


def feature_store_roundtrip(spark, sf):
    """Write a feature table by symbol, read three columns of two symbols back."""
    names = FAMILIES["returns"]
    wide = source.feature_table(hourly_bars(spark, sf), HOURLY_SPEC, names)
    path = _scratch(spark, "features")
    source.write_features(source.storable(wide, names, 0.8), path)
    back = source.load_columns(source.read_features(spark, path), ["ret_1d", "future_ret_1h", "ret_1d"], ["S1", "S6"])
    return back.select("symbol", "ts", r6("ret_1d", 4).alias("ret_1d"), r6("future_ret_1h", 4).alias("future_ret_1h"))


def feature_store_loose(spark, sf):
    names = ["ret_1h", "ret_1w"]
    wide = source.feature_table(hourly_bars(spark, sf), HOURLY_SPEC, names)
    return source.storable_any(wide, names).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count("ret_1w").alias("n_long"), F.min("ts").alias("first"))


def parsed_klines(spark, sf):
    """Events as feed rows: numbers as text, every tenth broken, each twice."""
    ev = table(spark, sf, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
        F.unix_millis(F.date_trunc("hour", "ts")).alias("open_time"), "event_id", "value")
    firsts = ev.groupBy("symbol", "open_time").agg(F.min("event_id").alias("event_id"), F.sum("value").alias("v"))
    text = F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.round("v", 2).cast("string"))
    feed = firsts.select("symbol", "open_time", *[text.alias(c) for c in source.PRICE_COLUMNS])
    return source.parse_klines(feed.unionByName(feed)).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def live_features(spark, sf):
    out = source.live_features(hourly_bars(spark, sf), HOURLY_SPEC, ["ret_1h", "vol_ratio"], 590)
    return out.select("symbol", "ts", *[r6(c).alias(c) for c in ("ret_1h", "vol_ratio", "rvol_1d")])


def symbol_files(spark, sf):
    """Bars written as one folder of files whose time columns differ in name and kind."""
    folder = _scratch(spark, "files")
    bars = hourly_bars(spark, sf)
    parts = {"timestamp": F.unix_millis(F.col("ts").cast("timestamp")), "time": F.col("ts"),
             "Open_Time": F.unix_micros(F.col("ts").cast("timestamp")) * 1000}
    out = None
    for i, (name, value) in enumerate(parts.items()):
        own = bars.where(F.substring("symbol", 2, 9).cast("int") % 3 == i)
        own.select(value.alias(name), "symbol", *[F.col(c).alias(c.upper() if i else c) for c in source.PRICE_COLUMNS]) \
            .write.parquet(f"{folder}/{i}")
        back = source.clean_bars(spark.read.parquet(f"{folder}/{i}"))
        out = back if out is None else out.unionByName(back)
    return out


def merged_symbol_files(spark, sf):
    """One folder with several time columns: a row takes the one that is set; the file names the symbol."""
    folder = _scratch(spark, "files")
    bars = hourly_bars(spark, sf)
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    for i, name in enumerate(("timestamp", "open_time")):
        bars.where(F.substring("symbol", 2, 9).cast("int") % 2 == i).select(millis.alias(name), *source.PRICE_COLUMNS) \
            .repartition(1).write.mode("append").parquet(folder)
    back = source.read_symbol_files(spark, folder)
    return back.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("close")).alias("close"))


def engine_targets(spark, sf):
    out = targets.engine_targets(daily_bars(spark, sf))
    return out.select("symbol", "ts", *[r6(c).alias(c) for c in ENGINE_HORIZONS])


def chosen_target(spark, sf):
    """The target a plan picks: the day-long one is there, the five-day one falls back."""
    bars = targets.forward_returns(hourly_bars(spark, sf), {"future_ret": 4, "future_ret_1d": 24})
    parts = []
    for choice in ("1d", "5d"):
        plan = target_plan(choice, bars.columns, HOURLY_SPEC)
        parts.append(bars.select(F.lit(choice).alias("choice"), "symbol", "ts", r6(plan["column"]).alias("y"),
                                 F.lit(plan["horizon"]).alias("horizon"), F.lit(plan["cv_gap"]).alias("cv_gap")))
    return parts[0].unionByName(parts[1])


def csv_roundtrip(spark, sf):
    """A report table written as one file and read back."""
    path = _scratch(spark, "report")
    by = table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"))
    store.write_csv(by, path)
    return store.read_result(spark, path, "o_orderpriority string, n long, low double")


def json_roundtrip(spark, sf):
    path = _scratch(spark, "report")
    by = table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("high"))
    store.write_json_report(by, path)
    return store.read_result(spark, path, "n long, high double", "json")


def appended_log(spark, sf):
    """Three appends to one log, one of them empty."""
    path = _scratch(spark, "log")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    for status in ("F", "X", "O"):
        store.append_log(orders.where(F.col("o_orderstatus") == status), path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def resolved_return(spark, sf):
    """Overall return of three runs: by its key, by the newest running return, compounded."""
    weekly = table(spark, sf, "events").groupBy(F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week")).agg(
        (F.avg("value") / 100).alias("week_return_pct")).withColumn("cum_return_pct", F.col("week_return_pct") * 3)
    row = weekly.agg(F.max("week_return_pct").alias("total_return"), F.lit(None).cast("double").alias("overall_return_pct"))
    keys = ("overall_return_pct", "total_return_pct", "overall_return", "total_return")
    parts = {"key": reports.overall_return(row, keys, weekly),
             "cumulative": reports.overall_return(row, keys[:3], weekly),
             "compounded": reports.overall_return(row, keys[:3], weekly.drop("cum_return_pct"))}
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("run"), r6("overall_return_pct").alias("overall_return_pct"))
        out = one if out is None else out.unionByName(one)
    return out


def latest_per_key(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return store.latest_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", r6("o_totalprice", 2).alias("o_totalprice"))


def feature_ic_last_weeks(spark, sf):
    from .portfolio_queries import _history
    hist = _history(spark, sf).withColumn("week_no", F.datediff("week", F.lit("1995-01-02")).cast("long"))
    return store.last_weeks(hist, 56, "week_no").select("week", "feature", r6("ic").alias("ic"))


def _filled_store(spark, sf):
    """One run per order status: its months are the weeks, its customers the traded names."""
    db = store.RunStore(spark, _scratch(spark, "runs"))
    orders = table(spark, sf, "orders")
    sign = F.when(F.col("o_custkey") % 2 == 0, 1.0).otherwise(-1.0)
    months = F.months_between(F.date_trunc("month", "o_orderdate"), F.lit("1995-01-01")).cast("long")
    base = orders.select(F.col("o_orderstatus").alias("run_id"), months.alias("week"),
                         F.concat(F.lit("C"), (F.col("o_custkey") % 50).cast("string")).alias("symbol"),
                         (sign * F.col("o_totalprice") / 1e7).alias("pnl"))
    trades = base.groupBy("run_id", "week", "symbol").agg(F.sum("pnl").alias("pnl_pct")).withColumn(
        "signal", F.when(F.col("pnl_pct") > 0, "BUY").otherwise("SELL"))
    for run in ("F", "O", "P"):
        db.start_run(run, '{"top_n": 5}')
    db.insert("trades", trades)
    weekly = trades.groupBy("run_id", "week").agg(
        F.avg("pnl_pct").alias("week_return_pct"), F.count(F.lit(1)).alias("n_trades"))
    db.insert("weekly_metrics", weekly)
    perf = weekly.groupBy("run_id").agg(
        F.sum("week_return_pct").alias("total_return_pct"), F.count(F.lit(1)).alias("total_weeks"),
        F.max("week_return_pct").alias("max_drawdown_pct"))
    db.insert("performance_summary", perf)
    # A later write of one run replaces its summary.
    db.insert("performance_summary", perf.where(F.col("run_id") == "F").withColumn("total_weeks", F.lit(1).cast("long")))
    db.finish_run("F")
    return db


def run_list(spark, sf):
    return _filled_store(spark, sf).list_runs().join(
        _filled_store(spark, sf).performance().select("run_id", "total_weeks"), "run_id", "left").select(
        "run_id", "status", r6("total_return_pct", 4).alias("total_return_pct"), "total_weeks")


def run_trades(spark, sf):
    return _filled_store(spark, sf).trades("O", 30).select("symbol", "signal", r6("pnl_pct", 4).alias("pnl_pct"))


def run_weekly_metrics(spark, sf):
    return _filled_store(spark, sf).weekly_metrics("O").select(
        "week", "n_trades", r6("week_return_pct", 4).alias("week_return_pct"))


def run_compare(spark, sf):
    return _filled_store(spark, sf).compare(["F", "P"]).select(
        "run_id", "total_weeks", r6("total_return_pct", 4).alias("total_return_pct"))


def resume_weeks(spark, sf):
    db = _filled_store(spark, sf)
    done = db.done_weeks("O").where(F.col("week") < 60)
    return store.pending_weeks(db.done_weeks("O"), done)


# --- models ------------------------------------------------------------------------------------

_SMALL = models.TreeParams(trees=5, rate=0.3, min_leaf=20)


def model_scaled(spark, sf):
    names, rows = _complete_matrix(spark, sf)
    return models.scaled(models.robust_scaler(rows, names), rows, names)


def model_folds(spark, sf):
    """Rows of every purged fold: training and validation counts and time ranges."""
    names, rows = _complete_matrix(spark, sf)
    ordered = models.ordered_rows(rows)
    out = None
    for i, (train, val) in enumerate(models.folds(ordered, 4, 24), 1):
        for part, df in (("train", train), ("val", val)):
            one = df.agg(F.lit(i).alias("fold"), F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"),
                         F.min("ts").alias("first"), F.max("ts").alias("last"))
            out = one if out is None else out.unionByName(one)
    return out


def model_trees(spark, sf):
    names, rows = _complete_matrix(spark, sf)
    model, cv = models.train_trees(rows, names, "future_ret_1h", _SMALL, 2, 24)
    return models.importances(model, names)


def model_elastic_net(spark, sf):
    names, rows = _complete_matrix(spark, sf)
    model, best = models.train_elastic_net(rows, names, "future_ret_1h")
    return models.importances(model, names)


def model_elastic_path(spark, sf):
    """Errors on the held-out parts of the default 5 x 20 penalties over 5 folds, and which point is chosen."""
    names, rows = _complete_matrix(spark, sf)
    ordered = models.ordered_rows(rows)
    path = ElasticPath(ordered, names, "future_ret_1h", models.fold_bounds(ordered.count(), 5, 48),
                       (0.5, 0.7, 0.9, 0.95, 0.99), models.alpha_grid(0.1))
    return spark.createDataFrame([(s, a, e, (s, a) == path.best()) for (s, a), e in path.errors.items()],
                                 "l1_share double, alpha double, mse double, chosen boolean")


def model_moment_fits(spark, sf):
    """Unpenalised lines of two features on each fold, and their errors on its held-out rows, from moments."""
    bars, feats = daily_features(spark, sf)
    rows = forward_returns(feats, {"y": 5}).na.drop(how="any", subset=["rev_1d", "rvol_1d", "y"])
    ordered = models.ordered_rows(rows.select("symbol", "ts", "rev_1d", "rvol_1d", "y"))
    path = ElasticPath(ordered, ["rev_1d", "rvol_1d"], "y", models.fold_bounds(ordered.count(), 5, 48), (0.5,), (0.0,))
    out = []
    for f in range(5):
        b, a = path.fits[0.5, 0.0, f]
        out.append((f, float(a - b @ path.shift[:-1]), *b.tolist()))
    lines = spark.createDataFrame(out, "fold int, a double, b1 double, b2 double")
    mse = path.held_out(ordered, (0.5, 0.0)).groupBy("fold").agg(F.count(F.lit(1)).alias("n_held"), F.avg(F.pow(F.col("y") - F.col("pred"), F.lit(2))).alias("mse"))
    return lines.join(mse, "fold").select("fold", "n_held", *[r6(c).alias(c) for c in ("a", "b1", "b2", "mse")])


def model_confidence(spark, sf):
    names, rows = _complete_matrix(spark, sf)
    base = models.fit_trees(rows, names, "future_ret_1h", _SMALL)
    conf = models.train_confidence(rows, names, "future_ret_1h", _SMALL, _SMALL, 2, 24)
    scored = models.predict(conf, models.predict(base, rows), "confidence")
    return scored.select("symbol", "ts", "pred", "confidence")


def model_permutation_importance(spark, sf):
    names, rows = _complete_matrix(spark, sf)
    model = models.fit_elastic_net(rows, names, "future_ret_1h", 0.001, 0.5)
    return models.permutation_importance(model, rows, names, "future_ret_1h")


def model_weekly_scores(spark, sf):
    bars, feats = daily_features(spark, sf)
    feats = stage(forward_returns(feats, {"future_ret": 5}))
    train = feats.na.drop(how="any", subset=[*FEATS, "future_ret"])
    model = models.fit_elastic_net(train, FEATS, "future_ret", 0.001, 0.5)
    return models.weekly_predictions(model, last_rows(feats, FEATS, 12), FEATS)


# --- streams -----------------------------------------------------------------------------------

def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    return raw.select(F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("symbol"),
                      F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "event_id")


def _landed(spark, stream, mode="append"):
    path = _scratch(spark, "stream")
    live.run_available(stream, path, _scratch(spark, "checkpoint"), mode)
    return spark.read.schema(stream.schema).parquet(path)


def _newest(spark, stream, keys):
    """What a windowed aggregate says in the end: in update mode each batch hands over the windows it
    changed, and the newest row of a window counts. So the windows still open when the input ends
    come out too."""
    path = _scratch(spark, "windows")
    live.run_batches(stream, _scratch(spark, "checkpoint"),
                     lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(path))
    return store.latest_per_key(spark.read.parquet(path), keys, "batch").drop("batch")


def stream_bars(spark, sf):
    """Hourly bars from the event stream."""
    out = _newest(spark, live.tumbling_bars(_event_stream(spark, sf), "1 hour", "2 hours", tie="event_id"), ["symbol", "ts"])
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def stream_deduplicated(spark, sf):
    hours = _event_stream(spark, sf).select("symbol", F.date_trunc("hour", "ts").alias("ts"))
    return _landed(spark, live.deduplicated(hours, "1 hour")).select(
        "symbol", F.col("ts").cast("timestamp_ntz").alias("ts"))


def _hourly_stream(spark, sf):
    """The hourly bars landed as files, streamed back."""
    path = _scratch(spark, "bars")
    bars = hourly_bars(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    bars.write.parquet(path)
    return spark.readStream.schema(bars.schema).parquet(path)


def stream_volume_alerts(spark, sf):
    out = _newest(spark, live.volume_alerts(_hourly_stream(spark, sf), "1 day", "6 hours", "1 hour", 2.0), ["symbol", "at"])
    return out.select("symbol", F.col("at").cast("timestamp_ntz").alias("at"), "n",
                      r6("volume_z").alias("volume_z"), "alert")


def stream_online_averages(spark, sf):
    out = _landed(spark, live.online_averages(_hourly_stream(spark, sf)))
    return out.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"),
                      r6("ema").alias("ema"), r6("rsi").alias("rsi"))


def stream_marked_positions(spark, sf):
    from .portfolio_queries import _book
    pos, _ = _book(spark, sf)
    out = _landed(spark, live.marked_positions(_hourly_stream(spark, sf), pos))
    return out.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "side",
                      r6("unrealised").alias("unrealised"))


def stream_pause(spark, sf):
    equity = _hourly_stream(spark, sf).select(
        F.col("symbol").alias("account"), "ts", F.col("close").alias("equity"))
    out = _landed(spark, live.pause_stream(equity, -0.6, -0.3))
    return out.select(F.col("account").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"),
                      r6("drawdown").alias("drawdown"), "paused")


def stream_latest_prices(spark, sf):
    """Update mode: every batch hands over the changed symbols; the newest row per symbol counts."""
    path = _scratch(spark, "prices")
    live.run_batches(
        live.latest_prices(_hourly_stream(spark, sf)), _scratch(spark, "checkpoint"),
        lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(path))
    return store.latest_per_key(spark.read.parquet(path), ["symbol"], "batch").select(
        "symbol", "price", F.col("as_of").cast("timestamp_ntz").alias("as_of"))


QUERIES = {
    "source_times": normalised_times,
    "source_symbol_metadata": symbol_metadata,
    "source_coverage": store_coverage,
    "source_pending_symbols": pending_symbols,
    "feature_store_roundtrip": feature_store_roundtrip,
    "feature_store_loose": feature_store_loose,
    "source_klines": parsed_klines,
    "live_features": live_features,
    "source_symbol_files": symbol_files,
    "source_merged_files": merged_symbol_files,
    "targets_engine": engine_targets,
    "targets_chosen": chosen_target,
    "sink_csv": csv_roundtrip,
    "sink_json": json_roundtrip,
    "sink_log": appended_log,
    "overall_return": resolved_return,
    "latest_per_key": latest_per_key,
    "feature_ic_last_weeks": feature_ic_last_weeks,
    "run_list": run_list,
    "run_trades": run_trades,
    "run_weekly_metrics": run_weekly_metrics,
    "run_compare": run_compare,
    "resume_weeks": resume_weeks,
    "model_scaled": model_scaled,
    "model_folds": model_folds,
    "model_trees": model_trees,
    "model_elastic_net": model_elastic_net,
    "model_elastic_path": model_elastic_path,
    "model_moment_fits": model_moment_fits,
    "model_confidence": model_confidence,
    "model_permutation_importance": model_permutation_importance,
    "model_weekly_scores": model_weekly_scores,
    "stream_bars": stream_bars,
    "stream_deduplicated": stream_deduplicated,
    "stream_volume_alerts": stream_volume_alerts,
    "stream_online_averages": stream_online_averages,
    "stream_marked_positions": stream_marked_positions,
    "stream_pause": stream_pause,
    "stream_latest_prices": stream_latest_prices,
}

# --- check SQL ---------------------------------------------------------------------------------

from .feature_queries import ORACLES as _FEATURE_ORACLES  # noqa: E402
from .portfolio_queries import _BOOK, _HIST, ORACLES as _PORTFOLIO_ORACLES  # noqa: E402
from .sql import ema  # noqa: E402

_RUNS = """with b as (select o_orderstatus as run_id, date_diff('month', date '1995-01-01', date_trunc('month', o_orderdate)::date) as week,
   concat('C', cast(o_custkey % 50 as varchar)) as symbol,
   (case when o_custkey % 2 = 0 then 1.0 else -1.0 end) * o_totalprice / 1e7 as pnl from orders),
 tr as (select run_id, week, symbol, sum(pnl) as pnl_pct from b group by 1, 2, 3),
 wk as (select run_id, week, avg(pnl_pct) as week_return_pct, count(*) as n_trades from tr group by 1, 2),
 pf as (select run_id, sum(week_return_pct) as total, case when run_id = 'F' then 1 else count(*) end as total_weeks from wk group by 1)"""
_BPH, _BPD = HOURLY_SPEC.bars_per_hour, HOURLY_SPEC.bars_per_day

ORACLES = {
    "source_times": """select event_id, date_trunc('second', ts)::timestamp as ts, date_trunc('second', ts)::timestamp as ts_text,
      date_trunc('second', ts)::timestamp as ts_native from events""",
    "source_symbol_metadata": f"""with {BARS_H} select symbol, min(ts) as first, max(ts) as last, count(*) as n from bars_h
      group by 1 having count(*) > 590""",
    "source_coverage": f"""with {BARS_H}, f as (select symbol, count(*) as n from bars_h where symbol not in ('S1', 'S2')
        and ts < timestamp '2024-01-25' and (symbol <> 'S3' or ts < timestamp '2024-01-02') group by 1)
      select (select count(distinct symbol) from bars_h) as n_raw, count(*) as n_cached, count(*) filter (where n > 50) as n_valid,
        count(*) - count(*) filter (where n > 50) as n_invalid,
        count(*) filter (where n > 50) / (select count(distinct symbol) from bars_h) < 0.8 as rebuild from f""",
    "source_pending_symbols": f"with {BARS_H} select symbol, count(*) as n from bars_h where symbol not in ('S0', 'S5') group by 1",
    "feature_store_roundtrip": f"""with {BARS_H}, a as (select symbol, ts, """ + ", ".join(
        f"ln(close / {lag('close', k)}) as x{i}" for i, k in enumerate(
            [1, _BPH, 4 * _BPH, _BPD, 2 * _BPD, 3 * _BPD, 5 * _BPD])) + f""",
        ln(lead(close, {_BPH}) over ({W}) / close) as y from bars_h),
      b as (select symbol, ts, y, """ + ", ".join(f"lag(x{i}) over ({W}) as x{i}" for i in range(7)) + f""" from a)
      select symbol, ts, {r('x3::real::double', 'ret_1d', 4)}, {r('y::real::double', 'future_ret_1h', 4)} from b
      where symbol in ('S1', 'S6') and """ + " + ".join(f"(x{i} is not null)::int" for i in range(7)) + """ >= 5""",
    "feature_store_loose": f"""with {BARS_H}, f as (select symbol, ts, lag(lag_h) over ({W}) as a, lag(lag_w) over ({W}) as b from (
        select symbol, ts, {lag('close', _BPH)} as lag_h, {lag('close', 5 * _BPD)} as lag_w from bars_h))
      select symbol, count(*) as n, count(b) as n_long, min(ts) as first from f where a is not null or b is not null
      group by 1 having count(*) >= 20""",
    "source_klines": """with g as (select concat('U', cast(user_id as varchar)) as symbol, date_trunc('hour', ts)::timestamp as ts,
        min(event_id) as e from events group by 1, 2)
      select symbol, count(*) as n, min(ts) as first, max(ts) as last from g where e % 10 <> 0 group by 1""",
    "live_features": f"""with {MATRIX_H} select symbol, ts, {r('ret_1h', 'ret_1h')}, {r('vol_ratio', 'vol_ratio')}, {r('rvol_1d', 'rvol_1d')}
      from mx where symbol in (select symbol from bars_h group by 1 having count(*) >= 590) and (ret_1h is not null or vol_ratio is not null)""",
    "latest_per_key": """select o_custkey, o_orderkey, round(o_totalprice, 2) as o_totalprice from orders
      qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""",
    "feature_ic_last_weeks": f"""{_HIST} select week, feature, {r('ic', 'ic')} from hs
      where date_diff('day', timestamp '1995-01-02', week) >= (select max(date_diff('day', timestamp '1995-01-02', week)) from hs) - 56""",
    "run_list": f"""{_RUNS} select run_id, case when run_id = 'F' then 'completed' else 'running' end as status,
      {r('total', 'total_return_pct', 4)}, total_weeks from pf""",
    "run_trades": f"""{_RUNS} select symbol, case when pnl_pct > 0 then 'BUY' else 'SELL' end as signal, {r('pnl_pct', 'pnl_pct', 4)}
      from tr where run_id = 'O' and week = 30""",
    "run_weekly_metrics": f"{_RUNS} select week, n_trades, {r('week_return_pct', 'week_return_pct', 4)} from wk where run_id = 'O'",
    "run_compare": f"{_RUNS} select run_id, total_weeks, {r('total', 'total_return_pct', 4)} from pf where run_id in ('F', 'P')",
    "resume_weeks": f"{_RUNS} select week from wk where run_id = 'O' and week >= 60",
    "model_folds": f"""with {MATRIX_H}, o as (select *, row_number() over (order by ts, symbol) - 1 as i from mc),
      s as (select (count(*) - 2 * 24 * 4) // 5 as z, count(*) as n from mc),
      f as (select unnest(range(1, 5)) as fold),
      b as (select fold::int as fold, 'train' as part, 0 as lo, fold * z as hi, n, fold * z + 24 + z as last_needed from f, s
        union all select fold::int, 'val', fold * z + 24, fold * z + 24 + z, n, fold * z + 24 + z from f, s)
      select fold, part, count(*) as n, min(ts) as first, max(ts) as last from b join o on o.i >= b.lo and o.i < b.hi
      where last_needed <= b.n group by 1, 2""",
    "model_moment_fits": f"""with {FEAT_D}, t as (select *, ln(lead(close, 5) over (partition by symbol order by ts) / close) as y from feat_d),
      o as materialized (select symbol, ts, rev_1d as x1, rvol_1d as x2, y, row_number() over (order by ts, symbol) - 1 as i from t
        where rev_1d is not null and rvol_1d is not null and y is not null),
      z as (select (count(*) - 480) // 6 as z from o),
      f as (select fold, (fold + 1) * z as hi, (fold + 1) * z + 48 as lo, (fold + 2) * z + 48 as last from z, (select unnest(range(5))::int as fold)),
      m as (select fold, avg(x1) as m1, avg(x2) as m2, avg(y) as my, var_pop(x1) as s11, var_pop(x2) as s22, covar_pop(x1, x2) as s12,
        covar_pop(x1, y) as s1, covar_pop(x2, y) as s2 from f join o on o.i < f.hi group by 1),
      b as (select *, (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) as b1, (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) as b2 from m)
      select fold, count(*) as n_held, {r('any_value(my - b1 * m1 - b2 * m2)', 'a')}, {r('any_value(b1)', 'b1')}, {r('any_value(b2)', 'b2')},
        {r('avg(pow(y - (my + b1 * (x1 - m1) + b2 * (x2 - m2)), 2))', 'mse')} from f join b using (fold) join o on o.i >= f.lo and o.i < f.last group by 1""",
    "source_symbol_files": f"with {BARS_H} select * from bars_h",
    "source_merged_files": f"with {BARS_H} select ts, count(*) as n, {r('sum(close)', 'close')} from bars_h group by 1",
    "targets_engine": f"with {BARS_D} select symbol, ts, " + ", ".join(
        r(f"ln(lead(close, {k}) over ({W}) / close)", n) for n, k in ENGINE_HORIZONS.items()) + " from bars_d",
    "targets_chosen": f"""with {BARS_H} select '1d' as choice, symbol, ts, {r(f'ln(lead(close, 24) over ({W}) / close)', 'y')}, 24 as horizon, 24 as cv_gap from bars_h
      union all select '5d', symbol, ts, {r(f'ln(lead(close, 4) over ({W}) / close)')}, 120, 120 from bars_h""",
    "sink_csv": "select o_orderpriority, count(*) as n, min(o_totalprice) as low from orders group by 1",
    "sink_json": "select count(*) as n, max(o_totalprice) as high from orders",
    "sink_log": "select o_orderstatus, count(*) as n from orders where o_orderstatus in ('F', 'O') group by 1",
    "overall_return": f"""with w as (select date_trunc('week', ts) as week, avg(value) / 100 as ret from events group by 1)
      select 'key' as run, {r('max(ret)', 'overall_return_pct')} from w
      union all select 'cumulative', {r('max_by(ret, week) * 3')} from w
      union all select 'compounded', {r('(product(1 + ret / 100) - 1) * 100')} from w""",
    "stream_bars": f"with {BARS_H} select * from bars_h",
    "stream_deduplicated": """select distinct concat('S', cast(user_id % 8 as varchar)) as symbol, date_trunc('hour', ts)::timestamp as ts from events""",
    "stream_volume_alerts": f"""with {BARS_H},
      w as (select symbol, ts, volume, unnest([0, 6, 12, 18]) as k, time_bucket(interval 6 hour, ts, timestamp '2000-01-01') as b from bars_h),
      g as (select symbol, b - to_hours(k) + interval 24 hour as "at", count(*) as n, avg(volume) as m, stddev_samp(volume) as s,
        max_by(volume, ts) as v from w group by 1, 2)
      select symbol, "at", n, {r('(v - m) / nullif(s, 0)', 'volume_z')}, coalesce((v - m) / nullif(s, 0) > 2.0, false) as alert from g
      where n >= 6""",
    "stream_online_averages": f"""with {BARS_H}, b0 as (select *, row_number() over ({W}) - 1 as pos, {lag('close')} as c1 from bars_h),
      b1 as (select *, case when c1 is not null then greatest(close - c1, 0) end as gain,
        case when c1 is not null then greatest(c1 - close, 0) end as loss from b0),
      e as ({ema('b1', {'e': ('close', 2 / 13), 'g': ('gain', 1 / 14), 'l': ('loss', 1 / 14)})})
      select symbol, ts, {r('e', 'ema')}, {r('1 - 1 / (1 + g / nullif(l, 0))', 'rsi')} from e""",
    "stream_marked_positions": f"""{_BOOK} select b.symbol, b.ts, side, {r('''size_usd * case when side = 'LONG' then close / entry_price - 1
      else 1 - close / entry_price end''', 'unrealised')} from bars_h b join pos using (symbol)""",
    "stream_pause": _PORTFOLIO_ORACLES["pause_states"],
    "stream_latest_prices": f"with {BARS_H} select symbol, max_by(close, ts) as price, max(ts) as as_of from bars_h group by 1",
}
