"""Query registry: key -> Spark job (spark, sf_dir) -> DataFrame, plus the
DuckDB oracle SQL where the job is SQL-expressible."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def finish(df: DataFrame) -> DataFrame:
    """Round reported doubles to 6 digits (the oracle does the same)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (F.round(c, 6) + F.lit(0.0)).alias(f.name)
        cols.append(c)
    return df.select(*cols)
