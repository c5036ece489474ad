"""Tables of a run that is written in blocks and becomes visible block by block.

A block writes its tables into folders of its own attempt and then one manifest row. Readers go by the
manifest alone, so what a lost attempt left behind is never seen, and a block that is done again after a
crash does not double its rows. Of two attempts that both committed a block the earlier one counts.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "run_id string, block int, attempt string, tables array<string>, state string, committed_at timestamp"


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def commits(self, run_id: str) -> DataFrame:
        """(block, attempt, tables, state), one row for each committed block."""
        path = f"{self.folder}/commits"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], COMMITS).select("block", "attempt", "tables", "state")
        rows = self.spark.read.schema(COMMITS).parquet(path).where(F.col("run_id") == run_id)
        first = F.min_by(F.struct("attempt", "tables", "state"), F.struct("committed_at", "attempt"))
        return rows.groupBy("block").agg(first.alias("c")).select("block", "c.*")

    def last(self, run_id: str) -> tuple[int, dict | None]:
        """Number of blocks done without a gap, and the state the last of them left."""
        rows = {r.block: r.state for r in self.commits(run_id).select("block", "state").collect()}  # one row a block
        n = next(i for i in range(len(rows) + 1) if i not in rows)
        return n, json.loads(rows[n - 1]) if n else None

    def attempt(self, run_id: str, block: int) -> "Attempt":
        return Attempt(self, run_id, block)

    def read(self, run_id: str, table: str, before: int | None = None) -> DataFrame | None:
        """Rows of the table in all committed blocks (those before ``before``), with ``block``; None without any."""
        rows = self.commits(run_id).where(F.array_contains("tables", table)).select("block", "attempt").collect()
        paths = [f"{self.folder}/{table}/run={run_id}/block={r.block}/attempt={r.attempt}" for r in rows
                 if before is None or r.block < before]
        if not paths:
            return None
        return self.spark.read.option("basePath", f"{self.folder}/{table}/run={run_id}").parquet(*paths).drop("attempt")


class Attempt:
    """What one try at a block writes; nothing of it counts before ``commit``."""

    def __init__(self, ledger: Ledger, run_id: str, block: int):
        self.ledger, self.run_id, self.block, self.name = ledger, run_id, block, uuid.uuid4().hex
        self.tables: list[str] = []

    def path(self, table: str) -> str:
        return f"{self.ledger.folder}/{table}/run={self.run_id}/block={self.block}/attempt={self.name}"

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """Write rows and return them as written."""
        rows.write.parquet(self.path(table))
        self.tables.append(table)
        return self.ledger.spark.read.schema(rows.schema).parquet(self.path(table))

    def commit(self, state: dict) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        self.ledger.spark.createDataFrame(
            [(self.run_id, self.block, self.name, self.tables, json.dumps(state), now)], COMMITS,
        ).coalesce(1).write.mode("append").parquet(f"{self.ledger.folder}/commits")
