"""Training-data pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the rows that
go on. Each stage's result is written to the shared folder and read again. All but the last return
the columns of ``documents``; the last adds ``shard`` and ``slot``. The mix repeats a document as
often as it draws it. The stages' cases (nulls, empty and long texts, ties, repeated rows, empty
tables, extra columns) are stated in the modules of ``inkwell.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import decontaminate, minhash, mixing, quality, shards
from inkwell.llm.common import drop_staged, stage, table

N_SHARDS = 40


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return minhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of sources takes them."""
    return mixing.draw(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    return shards.place(docs, N_SHARDS)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("source mix", source_mix),
    ("sharding", sharding),
]

#: MinHash components and suffix arrays have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, function) in enumerate(STAGES):
        done = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
        if i:
            drop_staged(spark, docs)
        docs = done
    return docs
