"""Verification jobs: claims against computed numbers, guards, consistency
(SURVEY §2.12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.shares import component_sum


def one_row_guard(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Uniqueness of ``keys`` before a pivot: key count, duplicated keys and
    the largest multiplicity (one row; 0 duplicates means the pivot is safe)."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.count(F.lit(1)).cast("bigint").alias("n_keys"),
                       F.count_if(F.col("n") > 1).cast("bigint").alias("n_duplicate_keys"),
                       F.max("n").cast("bigint").alias("max_rows_per_key"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The offending keys with their row counts."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") > 1))


def subtotal_consistency(df: DataFrame, keys: Sequence[str], parts: Sequence[str], whole: str,
                         tol: float = 1e-9) -> DataFrame:
    """sum(parts) == whole, per row."""
    p = component_sum(parts)
    return df.select(*keys, p.alias("parts"), F.col(whole).alias("whole"),
                     (F.abs(p - F.col(whole)) < tol).alias("consistent"))


#: A double has no more decimal digits before or after the point that a claim could state.
MAX_DIGITS = 18


def fact_check(claims: DataFrame, metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join published claims to computed metrics; pass when the computed value
    rounded (half-even) to the claim's digits (negative: tens, hundreds, ...)
    equals the claimed value. Digits beyond +-18 are an error.

    claims: keys + claim, value, digits. metrics: keys + computed."""
    j = claims.join(metrics, list(keys), "left")
    digits = F.col("digits")
    rounded = F.when(digits.isNull(), F.lit(None).cast("double"))
    for d in range(-MAX_DIGITS, MAX_DIGITS + 1):       # bround needs a constant scale
        rounded = rounded.when(digits == d, F.bround(F.col("computed").cast("double"), d))
    rounded = rounded.otherwise(F.raise_error(F.format_string("digits %s is out of range", digits.cast("string")))
                                .cast("double"))
    j = j.withColumn("computed_rounded", rounded)
    return j.select(*keys, "claim", "value", "digits", "computed", "computed_rounded",
                    F.coalesce(F.col("computed_rounded") == F.col("value"), F.lit(False)).alias("pass"))
