"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyspark.sql.functions as F
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession

import inkwell.llm as _pkg

# Task functions travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(_pkg)

#: Words are runs of anything but space and \x09-\x0D (what ``bytes.split()`` splits on, too).
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"
WORD_CLASS = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; where that is unset, a local test
    session gets a temporary one and any other master is an error."""
    sc = spark.sparkContext
    given = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not given:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="inkwell-llm-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(given)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back: cuts the lineage,
    survives lost executors, and keeps column pruning and pushed filters."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = shared_dir(spark).rstrip("/") + "/llm/"
    for df in frames:
        for f in {os.path.dirname(x) for x in df.inputFiles()}:
            if "/llm/" in f and f.split("://")[-1].lstrip("/").startswith(
                    root.split("://")[-1].replace("file:", "").lstrip("/")):
                path = jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(conf).delete(path, True)


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def smallest(df: DataFrame, key: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows with the smallest ``key``, a hash in [0, 2^63). Rows that can't be among them
    are left out first (by a share of the hash range that holds about 2n), so that tasks don't each
    send n rows to the driver."""
    rows = df.count()
    if rows > 4 * n:
        df = df.where(F.col(key) < int((1 << 63) * (2 * n / rows)))
    return df.orderBy(key, *ties).limit(n)


def count_threshold(df: DataFrame, column: str, most: int) -> int:
    """A count such that at most ``most`` rows have it or more, from a histogram of eighths of
    powers of two (512 rows at most)."""
    sizes = df.groupBy(F.floor(8 * F.log2(column)).cast("int").alias("b")).count().collect()
    total = 0
    for b, n in sorted(((r["b"], r["count"]) for r in sizes), reverse=True):
        total += n
        if total > most:
            return int(2 ** ((b + 1) / 8)) + 1
    return 1


def words(text: Column) -> Column:
    """The words of a text as an array; null and wordless texts give an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, without building the filtered array: only the first and last piece of
    the split can be empty."""
    return F.coalesce(F.size(F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), SPACE_CLASS))
                      - F.when(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")) == "", 1).otherwise(0),
                      F.lit(0)).cast("long")
