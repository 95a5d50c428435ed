"""Resumable enrichment with Structured Streaming.

Rows arrive as files in a source folder; a file-source stream with
``trigger(availableNow=True)`` picks up only files it has not seen (tracked in
the checkpoint). Every (key, model) pair that it has admitted is held in keyed
state (RocksDB, changelog checkpoints), so a pair is admitted once however
often its row arrives, and a batch costs what its own rows cost: the target is
not read. Admitted pairs are classified and written to a folder of their own,
``writer=<checkpoint>/batch=<n>``, which a replayed micro-batch overwrites.

A new checkpoint starts without state. Its batches look up what other writers
have finished, and only that: their successes are not run again, their failures
are. ``retry_failed`` runs the failed pairs again from the source. Null keys
match each other; of rows that repeat a key one is classified for each model.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RETRIES = "retries"
STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def writer_of(checkpoint_dir: str) -> str:
    """The name under which a checkpoint's stream writes to the target."""
    return hashlib.sha256(checkpoint_dir.rstrip("/").encode()).hexdigest()[:16]


def _writers(spark: SparkSession, target_dir: str) -> list[str]:
    """Entries of the target folder with any data; hidden ones (an unfinished write) don't count.
    Errors of the file system rise."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(target_dir)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []

    def has_data(status) -> bool:
        name = status.getPath().getName()
        if name[0] in "_.":
            return False
        return not status.isDirectory() or any(map(has_data, fs.listStatus(status.getPath())))

    return [s.getPath().getName() for s in fs.listStatus(root) if has_data(s)]


@contextmanager
def _state_store(spark: SparkSession):
    """State on local disk with changelogs in the checkpoint, unless the session says otherwise."""
    mine = {k: v for k, v in STATE.items() if spark.conf.get(k, None) in (None, _DEFAULTS.get(k))}
    before = {k: spark.conf.get(k, None) for k in mine}
    for k, v in mine.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_DEFAULTS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "false",
}


def current_results(spark: SparkSession, target_dir: str, key: str = "doc_id") -> DataFrame:
    """One row of each (key, model): a success if there is one, else the last failure."""
    df = spark.read.parquet(target_dir)
    w = Window.partitionBy(key, "model").orderBy(F.col("ok").desc(), F.col("run").desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "run", "writer", "batch")


def _write(pairs: DataFrame, folder: str, enrich: Callable[[DataFrame], DataFrame]) -> int:
    """Classify pairs into ``folder``, anew if it exists; returns how many were written."""
    obs = Observation()       # counted while the write runs
    out = enrich(pairs).withColumn("run", F.lit(time.time_ns()))
    out.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(folder)
    return int(obs.get["rows"])


def _unfinished(pairs: DataFrame, target_dir: str, writer: str, key: str) -> DataFrame:
    """Pairs without a success by any other writer."""
    done = pairs.sparkSession.read.parquet(target_dir).where(F.col("ok") & (F.col("writer") != writer)).select(
        F.col(key).alias("_k"), F.col("model").alias("_m"))
    return pairs.join(done, F.col(key).eqNullSafe(F.col("_k")) & (F.col("wanted") == F.col("_m")), "left_anti")


def incremental_enrich(spark: SparkSession, source_dir: str, source_schema: T.StructType,
                       target_dir: str, checkpoint_dir: str, models: Sequence[str],
                       enrich: Callable[[DataFrame], DataFrame], key: str = "doc_id",
                       max_files_per_trigger: int | None = None) -> int:
    """Run one availableNow pass; returns the number of rows appended.

    ``enrich`` gets the source's rows with the model to run in ``wanted`` and
    returns (key, model, ok, ...) rows."""
    added, writer = {"rows": 0}, writer_of(checkpoint_dir)
    others = [w for w in _writers(spark, target_dir) if w != f"writer={writer}"]

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        pairs = _unfinished(batch, target_dir, writer, key) if others else batch
        added["rows"] += _write(pairs, f"{target_dir}/writer={writer}/batch={batch_id}", enrich)

    reader = spark.readStream.schema(source_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    pairs = reader.parquet(source_dir).withColumn("wanted", F.explode(F.array(*[F.lit(m) for m in models])))
    with _state_store(spark):
        q = (pairs.dropDuplicates([key, "wanted"]).writeStream
             .foreachBatch(write_batch)
             .option("checkpointLocation", checkpoint_dir)
             .trigger(availableNow=True)
             .start())
        q.awaitTermination()
    return added["rows"]


def retry_failed(spark: SparkSession, source_dir: str, target_dir: str, models: Sequence[str],
                 enrich: Callable[[DataFrame], DataFrame], key: str = "doc_id") -> int:
    """Classify again the pairs of ``models`` that have failed so far; returns the rows appended."""
    failed = current_results(spark, target_dir, key).where(~F.col("ok") & F.col("model").isin(list(models))).select(
        F.col(key).alias("_k"), F.col("model").alias("wanted"))
    rows = spark.read.parquet(source_dir).dropDuplicates([key])
    pairs = rows.join(failed, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
    return _write(pairs, f"{target_dir}/writer={RETRIES}/batch={time.time_ns()}", enrich)
