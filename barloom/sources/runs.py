"""Run store: seven append-only tables in one folder, plus result files.

Nothing is updated in place. A changed row is appended with a newer ``written_at`` and readers keep
the newest row per key.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tables, columns and types of the store.
TABLES = {
    "runs": "run_id string, started_at timestamp, finished_at timestamp, config_json string, status string",
    "trades": "run_id string, week long, week_start string, symbol string, signal string, pred_prob double, "
              "pnl_pct double, raw_ret_pct double, meta_size double",
    "weekly_metrics": "run_id string, week long, week_start string, week_end string, n_symbols long, "
                      "n_trades long, week_return_pct double, annualised_pct double, ic double, "
                      "turnover_pct double, on_track boolean, cum_return_pct double, "
                      "max_drawdown_pct double, regime string",
    "model_artifacts": "run_id string, label string, week long, model_path string, scaler_path string, "
                       "auc double, ic double, icir double, n_features long, created_at timestamp",
    "shap_values": "run_id string, label string, feature string, mean_abs_shap double, rank long",
    "feature_ic": "run_id string, week long, feature string, ic double, selected boolean",
    "performance_summary": "run_id string, total_weeks long, total_trades long, retrains long, "
                           "total_return_pct double, annualised_pct double, sharpe double, "
                           "max_drawdown_pct double, ic_mean double, icir double, ic_positive_pct double, "
                           "var_95 double, cvar_95 double, kill_switch_hit boolean, config_json string",
}


def latest_per_key(df: DataFrame, keys: Sequence[str], newest: str | Sequence[str]) -> DataFrame:
    """Newest row per key: a map-side combined max_by, no sort of a key's whole history."""
    order = [newest] if isinstance(newest, str) else list(newest)
    rest = [c for c in df.columns if c not in keys]
    by = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_r"))
    return kept.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def last_weeks(df: DataFrame, n: int, week: str = "week") -> DataFrame:
    """Rows of the last ``n`` weeks; the newest week is a scalar subquery."""
    return df.where(F.col(week) >= df.agg(F.max(week)).scalar() - n)


class RunStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _append(self, table: str, df: DataFrame) -> None:
        schema = T._parse_datatype_string(TABLES[table])
        cols = [
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
        now = F.lit(datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp")
        df.select(*cols, now.alias("written_at")).write.mode("append").parquet(f"{self.folder}/{table}")

    def table(self, table: str) -> DataFrame:
        """The table, empty when nothing was written yet."""
        schema = T._parse_datatype_string(TABLES[table] + ", written_at timestamp")
        path = f"{self.folder}/{table}"
        jvm = self.spark._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def start_run(self, run_id: str, config_json: str = "{}") -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        self._append("runs", self.spark.createDataFrame(
            [(run_id, now, config_json, "running")],
            "run_id string, started_at timestamp, config_json string, status string"))

    def finish_run(self, run_id: str, status: str = "completed") -> None:
        row = self.runs().where(F.col("run_id") == run_id).withColumns({
            "finished_at": F.current_timestamp(), "status": F.lit(status)})
        self._append("runs", row)

    def insert(self, table: str, rows: DataFrame) -> None:
        self._append(table, rows)

    def runs(self) -> DataFrame:
        return latest_per_key(self.table("runs"), ["run_id"], "written_at").drop("written_at")

    def performance(self, run_id: str | None = None) -> DataFrame:
        df = latest_per_key(self.table("performance_summary"), ["run_id"], "written_at").drop("written_at")
        return df.where(F.col("run_id") == run_id) if run_id else df

    def trades(self, run_id: str, week: int | None = None) -> DataFrame:
        df = self.table("trades").where(F.col("run_id") == run_id)
        return df.where(F.col("week") == week) if week is not None else df

    def weekly_metrics(self, run_id: str) -> DataFrame:
        return self.table("weekly_metrics").where(F.col("run_id") == run_id).orderBy("week")

    def shap(self, run_id: str, label: str | None = None) -> DataFrame:
        df = self.table("shap_values").where(F.col("run_id") == run_id)
        return (df.where(F.col("label") == label) if label else df).orderBy("rank")

    def feature_ic(self, run_id: str, last: int) -> DataFrame:
        return last_weeks(self.table("feature_ic").where(F.col("run_id") == run_id), last)

    def list_runs(self) -> DataFrame:
        perf = self.performance().select("run_id", "total_return_pct", "sharpe", "max_drawdown_pct", "ic_mean")
        return self.runs().join(perf, "run_id", "left").orderBy(F.desc("started_at"))

    def compare(self, run_ids: Sequence[str]) -> DataFrame:
        return self.performance().where(F.col("run_id").isin(list(run_ids)))

    def done_weeks(self, run_id: str) -> DataFrame:
        return self.table("weekly_metrics").where(F.col("run_id") == run_id).select("week").distinct()


def pending_weeks(weeks: DataFrame, done: DataFrame) -> DataFrame:
    """Weeks a resumed run still has to do."""
    return weeks.join(done.select("week").distinct(), "week", "left_anti")


def write_csv(df: DataFrame, path: str) -> None:
    """Report-sized table as one CSV file with a header."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def write_json_report(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).repartition(1).write.mode("overwrite").text(path)


def read_result(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    """CSV or JSON result; an absent path gives an empty table, unreadable numbers give NULL."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop)
    if found is None or len(found) == 0:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE")
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.option("multiLine", True).json(path)


def latest_file_rows(df: DataFrame) -> DataFrame:
    """Rows of the file whose name sorts last (names carry a zero-padded week)."""
    newest = df.select(F.col("_metadata.file_name").alias("f")).agg(F.max("f")).scalar()
    return df.where(F.col("_metadata.file_name") == newest)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
