"""Session helpers.

``get_spark`` is for tests, the bench and local runs. On a cluster the session
comes from the launcher; the jobs only read settings from it.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Settings that matter for every job in this package:
# - AQE re-plans joins and coalesces shuffle partitions at runtime and splits
#   skewed join partitions (one geography may hold a third of all rows).
# - ANSI stays on (Spark's default); the jobs use try_divide / try_cast where
#   the analyses expect null instead of an error.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "inkwell", extra: dict | None = None) -> SparkSession:
    """The given master, else the launcher's (``spark-submit``), else local."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or SparkConf().get("spark.master", None) or os.environ.get("MASTER") or f"local[{cpus}]"
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf.setdefault("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster's ``spark.checkpoint.dir`` always wins. Only when it is unset
    (a local test session) do we create one under the local temp folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError(f"master {sc.master}: set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="inkwell-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def _stage_root(spark: SparkSession) -> str:
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/inkwell-stage"
    if root not in _STAGED:
        _STAGED[root] = spark
        atexit.register(clean_staged, root)
    return root


_STAGED: dict[str, SparkSession] = {}


def clean_staged(root: str) -> None:
    """Delete this application's staged files (also run when the driver ends).
    Results of jobs that read them must have been written by then."""
    spark = _STAGED.pop(root, None)
    if spark is not None:
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for staged files, inside the shared checkpoint folder."""
    return f"{_stage_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` once as Parquet to the shared checkpoint
    folder and read it back. Used for aggregates that several branches of one
    job reuse; column pruning and pushed filters go on behind it, and the
    files survive the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Identifies the present contents of source paths: sizes, file counts and change times."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = hashlib.sha256()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(conf)
        total, status = fs.getContentSummary(path), fs.getFileStatus(path)
        seen.update(f"{name}|{total.getLength()}|{total.getFileCount()}|{status.getModificationTime()}\n".encode())
    return seen.hexdigest()[:16]


def stored_once(spark: SparkSession, name: str, sources: list[str], build: Callable[[], DataFrame],
                partition_by: list[str] | None = None) -> DataFrame:
    """A table derived from ``sources`` that many jobs read: written once per application to the
    shared folder, and again only if a source has changed. An unfinished write is never read."""
    path = f"{_stage_root(spark)}/{name}-{_fingerprint(spark, sources)}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        df = build()
        _SCHEMAS[path] = df.schema
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    schema = _SCHEMAS.get(path)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


_SCHEMAS: dict[str, StructType] = {}


def spread(df: DataFrame, path: str) -> DataFrame:
    """``df`` dealt out over the cluster's cores where its file has too few splits to feed them (a
    shuffle of at most ``maxPartitionBytes`` a core); as it is otherwise."""
    spark = df.sparkSession
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    total = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(name)
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    cores = spark.sparkContext.defaultParallelism
    if total.getLength() < SMALL_INPUT or total.getFileCount() >= cores or total.getLength() >= cores * split:
        return df
    return df.repartition(cores)


#: Bytes under which dealing rows out costs more than it gains.
SMALL_INPUT = 1 << 22


def broadcast_threshold(spark: SparkSession) -> int:
    """The session's ``autoBroadcastJoinThreshold`` in bytes (-1: never)."""
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
