"""Session settings and the reliable place to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, name: str = "barloom", partitions: int | None = None,
                  **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.legacy.parquet.nanosAsLong", "true")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"


def favour_compiled_code(spark: SparkSession) -> None:
    """Lower the fused-method limit to what the JVM still compiles (8000 bytes), unless it was set.

    A wide projection fused into one larger method would run interpreted; beyond the limit Spark
    evaluates it through split, compiled projections instead.
    """
    if spark.conf.get(_HUGE_METHOD) == "65535":
        spark.conf.set(_HUGE_METHOD, "8000")


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Send whole texts to Python in Arrow batches of about 4 MB, unless a size was set.

    Spark's 64 MB are held several times over for each running function: as vectors and as a direct
    buffer beside the executor's heap, and once more in the Python worker, and neither gives them back.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, "4m")


def shared_folder(spark: SparkSession) -> str:
    """Folder named in spark.checkpoint.dir; a temporary one only in local mode without the setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if spark not in _local_folders:
        _local_folders[spark] = tempfile.mkdtemp(prefix="spark-")
    return _local_folders[spark]


_local_folders: dict[SparkSession, str] = {}


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate table that several passes read, and return the table.

    Unlike a cache it survives lost executors, and later passes still prune columns and push filters.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(staged: DataFrame) -> None:
    """Delete the files of a staged table once everything that reads it has been written elsewhere."""
    spark = staged.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("stage-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
