"""Windows, ranks, changes, streaks, top-k and sampling.

Windows are partitioned by the unit of analysis wherever the question allows.
Questions over all units of a group (rank, gap to the next, median) collapse
rows to distinct values with multiplicities and range-partition these by
(group, value): the same plan at every size and for every orderable type. The
only other windows run over at most one row per group and range or are bounded
top-k limits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.numeric import mix64, safe_div
from inkwell.session import materialize


def slice_positions(df: DataFrame, positions: Sequence[int], ordinal: str = "ordinal") -> DataFrame:
    """Rows at the given positions (single, range or list with gaps).

    Row position is an explicit ``ordinal`` column, so this is a filter on the
    decoded rows, not a window."""
    return df.where(F.col(ordinal).isin(list(positions)))


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``on`` where null keys match (a null group is a group)."""
    r = right.select(*[F.col(c).alias("_r_" + c) if c in on else F.col(c) for c in right.columns])
    cond = [left[c].eqNullSafe(r["_r_" + c]) for c in on]
    return left.join(r, cond, how).drop(*["_r_" + c for c in on])


def _ranged(vc: DataFrame, keys: Sequence[str], value: str, ascending: bool) -> DataFrame:
    """Distinct (group, value) rows cut into ranges: one range partitioning by
    (group, null flag, value), written once, with ``_p`` numbering the ranges
    in that order. Works for any orderable type; a group of any size, and
    values however close together, spread over as many ranges as their rows
    need. Nulls come last in the requested order."""
    v = F.col(value)
    n = int(vc.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = vc.repartitionByRange(n, *keys, v.isNull() if ascending else v.isNotNull(), v)
    return materialize(ranged.withColumn("_p", F.spark_partition_id()))


def _prefix_counts(vc: DataFrame, keys: Sequence[str], value: str, ascending: bool) -> DataFrame:
    """Distinct (group, value) counts ``_n`` with ``_before`` (rows of the
    group strictly before the value) and ``_total`` (rows of the group).

    Rows before a range come from per-(group, range) totals, at most as many
    rows per group as there are ranges; rows before a value inside its range
    from a running sum over that range only."""
    ranged = _ranged(vc, keys, value, ascending)
    v, p = F.col(value), F.col("_p")
    past = Window.unboundedPreceding, -1
    per = ranged.groupBy(*keys, "_p").agg(F.sum("_n").alias("_pn"))
    ranges = Window.partitionBy(*keys)
    per = per.select(*keys, "_p", F.sum("_pn").over(ranges).alias("_total"), F.coalesce(
        F.sum("_pn").over(ranges.orderBy(p if ascending else p.desc()).rowsBetween(*past)), F.lit(0)).alias("_ahead"))
    inside = F.coalesce(F.sum("_n").over(
        Window.partitionBy(*keys, "_p").orderBy(v.asc_nulls_last() if ascending else v.desc_nulls_last())
        .rowsBetween(*past)), F.lit(0))
    return (join_null_safe(ranged.withColumn("_inside", inside), per, [*keys, "_p"])
            .withColumn("_before", F.col("_ahead") + F.col("_inside")).drop("_ahead", "_inside", "_p"))


def distributed_rank(df: DataFrame, value: str, partition: Sequence[str] = (), ascending: bool = False,
                     materialize_input: bool = True) -> DataFrame:
    """Exact SQL ``rank()`` by ``value`` (any orderable type, nulls last) plus
    the group size, without putting a whole group's rows into one task.

    1. Collapse to distinct (group, value) with multiplicities: a value held
       by a third of all rows becomes one row.
    2. Range-partition these by (group, value) and count what lies before each
       (``_prefix_counts``); rank = 1 + that count.
    3. Join back to the rows on (group, value), null-safe.

    The input (a per-unit aggregate) is read twice, so it is materialized once
    in the shared checkpoint folder first.
    """
    if materialize_input:
        df = materialize(df)
    return _join_ranks(df, _rank_table(df, value, list(partition), ascending), value, list(partition))


def distributed_ranks(df: DataFrame, specs: Sequence[tuple[str, Sequence[str], bool, str]]) -> DataFrame:
    """Several ``distributed_rank`` columns over one input, materialized once.

    ``specs``: (value, partition, ascending, name); adds ``name`` (the rank)
    for each. Every rank table is built from the same staged input and
    joined back in turn, so the input is not recomputed per rank."""
    df = materialize(df)
    out = df
    for value, partition, ascending, name in specs:
        ranked = _rank_table(df, value, list(partition), ascending).drop("n_total").withColumnRenamed("rank", name)
        out = _join_ranks(out, ranked, value, list(partition))
    return out


def _rank_table(df: DataFrame, value: str, keys: list[str], ascending: bool) -> DataFrame:
    """(``_k_<key>``..., ``_v``, rank, n_total): one row per distinct (group, value)."""
    vc = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return _prefix_counts(vc, keys, value, ascending).select(
        *[F.col(k).alias("_k_" + k) for k in keys], F.col(value).alias("_v"),
        (F.lit(1) + F.col("_before")).cast("bigint").alias("rank"), F.col("_total").cast("bigint").alias("n_total"))


def _join_ranks(df: DataFrame, ranked: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Rows joined to their (group, value) rank row, null-safe."""
    cond = [df[k].eqNullSafe(ranked["_k_" + k]) for k in keys] + [df[value].eqNullSafe(ranked["_v"])]
    return df.join(ranked, cond).drop(*["_k_" + k for k in keys], "_v")


def distributed_gap_to_next(df: DataFrame, partition: Sequence[str], value: str, tie: str) -> DataFrame:
    """``value - lead(value) over (partition order by value desc nulls last, tie)``
    without a partition-sized window.

    Inside a group of equal values the next row has the same value (gap 0),
    except the group's last row by ``tie``, whose next row carries the next
    lower distinct value; of rows that also share the tie, one is the last. So
    the lead is only needed over distinct values: inside a range by a window
    over the range's distinct values, and across ranges from the next
    non-empty range's highest value."""
    df = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    keys = list(partition)
    v = F.col(value)
    vc = df.groupBy(*keys, value).agg(F.max(F.struct(F.col(tie).alias("t"), F.col("_row").alias("r"))).alias("_last"))
    ranged = _ranged(vc, keys, value, False)
    firsts = ranged.groupBy(*keys, "_p").agg(F.max(value).alias("_first"))
    firsts = firsts.withColumn("_next_first", F.lead("_first").over(
        Window.partitionBy(*keys).orderBy(F.col("_p").desc()))).drop("_first")
    inside = Window.partitionBy(*keys, "_p").orderBy(v.desc_nulls_last())
    nxt = join_null_safe(ranged.withColumn("_in", F.lead(value).over(inside))
                         .withColumn("_end", F.lead(F.lit(True)).over(inside).isNull()), firsts, [*keys, "_p"])
    nxt = nxt.select(*[F.col(k).alias("_k_" + k) for k in keys], F.col(value).alias("_v"), F.col("_last.r").alias("_r"),
                     F.when(F.col("_end"), F.col("_next_first")).otherwise(F.col("_in")).alias("_next"))
    cond = [df[k].eqNullSafe(nxt["_k_" + k]) for k in keys] + [df[value].eqNullSafe(nxt["_v"])]
    gap = F.when(F.col("_row") == F.col("_r"), v - F.col("_next")).otherwise(v - v)
    return df.join(nxt, cond).withColumn("gap_to_next", gap).drop(*["_k_" + k for k in keys], "_v", "_r", "_next", "_row")


def distributed_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group (nulls skipped; mean of the two middle values
    when the count is even), without holding a group's values in one task.
    Output: one row per group with at least one non-null value."""
    vc = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return median_from_counts(vc, keys, value, name)


def median_from_counts(vc: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """``distributed_median`` on distinct (group, value) counts ``_n``: prefix
    counts give each distinct value's position range, and the values covering
    the middle position(s) are averaged."""
    k = list(keys)
    pos = _prefix_counts(vc.where(F.col(value).isNotNull()), k, value, True)
    pos = pos.withColumn("_lo", F.col("_before") + 1).withColumn("_hi", F.col("_before") + F.col("_n"))
    m1 = F.floor((F.col("_total") + 1) / 2)       # lower middle position (1-based)
    m2 = F.ceil((F.col("_total") + 1) / 2)        # upper middle position
    hit1 = (F.col("_lo") <= m1) & (m1 <= F.col("_hi"))
    hit2 = (F.col("_lo") <= m2) & (m2 <= F.col("_hi"))
    mids = pos.where(hit1 | hit2).select(*k, F.when(hit1, F.col(value)).alias("_a"),
                                         F.when(hit2, F.col(value)).alias("_b"))
    return mids.groupBy(*k).agg(((F.max("_a") + F.max("_b")) / 2.0).alias(name))


def rank_with_total(df: DataFrame, value: str, partition: Sequence[str] = (),
                    ascending: bool = False) -> DataFrame:
    """rank() by value plus the population size ("15th of 841"), distributed."""
    return distributed_rank(df, value, partition, ascending)


def sort_desc_share(df: DataFrame, partition: Sequence[str], value: str, tie: str) -> DataFrame:
    """Position by value descending (nulls last), key as tie-breaker."""
    w = Window.partitionBy(*partition).orderBy(F.col(value).desc_nulls_last(), F.col(tie))
    return df.withColumn("pos", F.row_number().over(w))


def rank_range(df: DataFrame, value: str, key: str, lo: int, hi: int) -> DataFrame:
    """Rows ranked lo..hi by value descending (key breaks ties); ranks past
    the end are simply absent. Spark plans the bound as a top-``hi`` limit."""
    w = Window.orderBy(F.col(value).desc(), F.col(key))
    return df.withColumn("pos", F.row_number().over(w)).where(F.col("pos").between(lo, hi))


def topk_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Top k rows per group; ``row_number <= k`` is planned as WindowGroupLimit,
    so each task keeps at most k rows per group before the shuffle sort."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n pseudo-random rows, repeatable: order by a seeded scramble
    of the whole key (``mix64``) and take n. Planned as a distributed top-n (each
    task keeps n rows), no full sort."""
    return df.orderBy(*mix64(F.col(key), seed), F.col(key)).limit(n)


def yoy_point_change(df: DataFrame, unit: Sequence[str], value: str, year: str = "year") -> DataFrame:
    """Change to the previous *available* year (a skipped year is bridged)."""
    w = Window.partitionBy(*unit).orderBy(year)
    return (df.withColumn("prev_year", F.lag(year).over(w))
            .withColumn("prev_value", F.lag(value).over(w))
            .withColumn("change", F.col(value) - F.col("prev_value")))


def change_since_base(df: DataFrame, unit: Sequence[str], value: str, base_year: int,
                      year: str = "year") -> DataFrame:
    w = Window.partitionBy(*unit)
    base = F.max(F.when(F.col(year) == base_year, F.col(value))).over(w)
    return df.withColumn("base_value", base).withColumn("change_since_base", F.col(value) - F.col("base_value"))


def gap_to_next(df: DataFrame, partition: Sequence[str], value: str, tie: str) -> DataFrame:
    """Lead over the next-highest row (distributed; see ``distributed_gap_to_next``)."""
    return distributed_gap_to_next(df, partition, value, tie)


def gain_streak(df: DataFrame, unit: Sequence[str], change: str, year: str = "year") -> DataFrame:
    """Consecutive years of gains (change > 0); a non-gain or null resets to 0.

    Gaps and islands: a running count of non-gains numbers the islands, and
    the running count of gains inside an island is the streak."""
    w = Window.partitionBy(*unit).orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    gain = F.coalesce(F.col(change) > 0, F.lit(False))
    island = F.sum(F.when(gain, 0).otherwise(1)).over(w)
    wi = Window.partitionBy(*unit, "_island").orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    return (df.withColumn("_gain", gain).withColumn("_island", island)
            .withColumn("streak", F.when(F.col("_gain"), F.sum(F.col("_gain").cast("int")).over(wi))
                        .otherwise(0).cast("int"))
            .drop("_gain", "_island"))


def rate(passed: str, tested: str) -> Column:
    """Percent from raw counts (never a mean of rates)."""
    return safe_div(F.col(passed) * 100.0, F.col(tested))
