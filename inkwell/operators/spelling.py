"""Misspelt category names, found from the list of right ones.

Two strings within two edits share a string that is left of each after deleting at most two
characters. So the unknown values and the right names meet by an equi-join on such rests, over
distinct values only, and the pairs found are confirmed by edit distance. A value is corrected if one
right name is nearer than all others; a tie is left open and reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edits allowed, and in values of up to ``SHORT`` characters.
EDITS, SHORT_EDITS, SHORT = 2, 1, 4


def _without_one(s: Column) -> Column:
    """The string without each of its characters in turn."""
    places = F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)))
    return F.transform(places, lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))


def rests(s: Column) -> Column:
    """The string, and what is left after deleting one or two characters."""
    one = _without_one(s)
    return F.array_distinct(F.concat(F.array(s), one, F.flatten(F.transform(one, _without_one))))


def corrections(values: DataFrame, names: DataFrame, value: str = "value", name: str = "name") -> DataFrame:
    """(value, fix, distance, n_nearest) of every distinct value that is no right name: ``fix`` and
    ``distance`` are null where none is near, ``fix`` also where several are equally near. Null and
    empty values are left out."""
    right = names.select(F.col(name).alias("_name")).where("_name is not null and _name <> ''").distinct()
    unknown = values.select(F.col(value).alias("value")).where("value is not null and value <> ''").distinct().join(
        right, F.col("value") == F.col("_name"), "left_anti")
    near = unknown.select("value", F.explode(rests(F.col("value"))).alias("_rest")).join(
        right.select("_name", F.explode(rests(F.col("_name"))).alias("_rest")), "_rest").select("value", "_name").distinct()
    edits = F.when(F.length("value") <= SHORT, SHORT_EDITS).otherwise(EDITS)
    near = near.withColumn("distance", F.levenshtein("value", "_name")).where(F.col("distance") <= edits)
    # Distances are 1 or 2, so a value has two counts and two least names.
    at = {d: F.col("distance") == d for d in range(1, EDITS + 1)}
    best = near.groupBy("value").agg(F.min("distance").alias("distance"),
                                     *[F.count_if(c).alias(f"_n{d}") for d, c in at.items()],
                                     *[F.min(F.when(c, F.col("_name"))).alias(f"_f{d}") for d, c in at.items()])
    n = F.when(F.col("distance") == 1, F.col("_n1")).otherwise(F.col("_n2"))
    fix = F.when(n == 1, F.when(F.col("distance") == 1, F.col("_f1")).otherwise(F.col("_f2")))
    return unknown.join(best.select("value", fix.alias("fix"), "distance", n.alias("n_nearest")), "value", "left").withColumn(
        "n_nearest", F.coalesce("n_nearest", F.lit(0)))


def respell(df: DataFrame, column: str, found: DataFrame) -> DataFrame:
    """``df`` with the corrections of ``found`` applied to a column; everything else stays."""
    fixes = found.where("fix is not null").select(F.col("value").alias("_value"), "fix")
    fixed = df.join(fixes, F.col(column) == F.col("_value"), "left").withColumn(column, F.coalesce("fix", F.col(column)))
    return fixed.select(*df.columns)
