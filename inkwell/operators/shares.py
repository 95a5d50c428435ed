"""Shares, totals and group statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.numeric import safe_div, strict_sum


def component_sum(columns: Sequence[str]) -> Column:
    """c1 + c2 + ... ; null if any component is null."""
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns])


def rowwise_component_sum(df: DataFrame, columns: Sequence[str], name: str = "total") -> DataFrame:
    return df.withColumn(name, component_sum(columns))


def share_of_universe(df: DataFrame, parts: Sequence[str], universe: str,
                      name: str = "prop") -> DataFrame:
    """(sum of parts) / universe for every geography in one projection."""
    return df.withColumn(name, safe_div(component_sum(parts), F.col(universe)))


def difference_column(df: DataFrame, a: str, b: str, name: str = "diff") -> DataFrame:
    return df.withColumn(name, F.col(a) - F.col(b))


def percent_columns(df: DataFrame, groups: Sequence[str], universe: str,
                    suffix: str = "_percent") -> DataFrame:
    """group / universe for each group (0-1 scale, as the source)."""
    return df.withColumns({g + suffix: safe_div(F.col(g), F.col(universe)) for g in groups})


def margin_bounds(df: DataFrame, groups: Sequence[str], margin_suffix: str = "_margin") -> DataFrame:
    cols = {}
    for g in groups:
        cols[g + "_lower"] = F.col(g) - F.col(g + margin_suffix)
        cols[g + "_upper"] = F.col(g) + F.col(g + margin_suffix)
    return df.withColumns(cols)


def total_margins(df: DataFrame, keys: Sequence[str], groups: Sequence[str], universe: str,
                  margin_suffix: str = "_margin", share_suffix: str = "_percent") -> DataFrame:
    """Totals of small areas with their margins of error: the margin of a sum is the root of the
    summed squares; that of a share p = e / u is the root of m_e^2 - p^2 m_u^2 over u, with a plus where
    that is negative (the rule for ratios). Strict: a null estimate or margin leaves its total null."""
    cols = [universe, *groups]
    agg = df.groupBy(*keys).agg(*[strict_sum(c).alias(c) for c in cols], *[
        F.sqrt(strict_sum(F.col(c + margin_suffix) * F.col(c + margin_suffix))).alias(c + margin_suffix) for c in cols])
    u, mu = F.col(universe), F.col(universe + margin_suffix)
    out = {}
    for g in groups:
        m, p = F.col(g + margin_suffix), safe_div(F.col(g), u)
        under = m * m - p * p * mu * mu
        out[g + share_suffix] = p
        out[g + share_suffix + margin_suffix] = safe_div(
            F.sqrt(F.when(under < 0, m * m + p * p * mu * mu).otherwise(under)), u)
    return agg.withColumns(out)


def fixed_denominator_share(long_df: DataFrame, universe_var: str, partition: Sequence[str] = ("geo_id",),
                            value: str = "e", var: str = "var", name: str = "share") -> DataFrame:
    """value / the universe row's value in the same geography, read from the data.

    The universe is a windowed conditional max over the geography's rows; a
    geography holds one row per variable, so the window partitions are small
    however many geographies there are."""
    w = Window.partitionBy(*partition)
    uni = F.max(F.when(F.col(var) == universe_var, F.col(value))).over(w)
    return long_df.withColumn("universe", uni).withColumn(name, safe_div(F.col(value), F.col("universe")))


def yearly_totals(df: DataFrame, keys: Sequence[str], groups: Sequence[str], universe: str,
                  suffix: str = "_percent") -> DataFrame:
    """Sum small areas to the parent per key (strict: any null -> null total),
    then shares of the universe. Partial aggregation runs map-side."""
    agg = df.groupBy(*keys).agg(*[strict_sum(c).alias(c) for c in list(groups) + [universe]])
    return percent_columns(agg, groups, universe, suffix)


def band_totals(long_df: DataFrame, band_map: DataFrame, keys: Sequence[str],
                values: Sequence[str], on: str = "variable") -> DataFrame:
    """Fold detailed rows into named bands and sum: one ``groupBy(band)``.

    ``band_map`` (variable -> band) may map non-contiguous rows to one band.
    It lists survey variables; Spark broadcasts it after its own size check
    (plan-time estimate, then AQE on the actual size), else shuffles.
    """
    joined = long_df.join(band_map, on)
    return joined.groupBy(*keys, "band").agg(*[F.sum(v).alias(v) for v in values])


def group_total_of_selected(long_df: DataFrame, groups: Mapping[str, Sequence[str]],
                            keys: Sequence[str] = ("geo_id",), var: str = "var",
                            value: str = "e") -> DataFrame:
    """Sum of selected rows per named group (e.g. men 65+ and women 65+)."""
    label = None
    for g, members in groups.items():
        cond = F.col(var).isin(list(members))
        label = F.when(cond, g) if label is None else label.when(cond, g)
    return (long_df.where(label.isNotNull()).withColumn("group", label)
            .groupBy(*keys, "group").agg(F.sum(value).alias(value)))


def share_of_group_total(df: DataFrame, group: Sequence[str], value: str,
                         name: str = "share") -> DataFrame:
    """value / sum(value) over the group (a null group is a group).

    Group totals come from one partial aggregation (a group holding a third
    of the rows collapses map-side) and are joined back on the group key, so
    no task ever holds a whole group; the totals side is broadcast when
    Spark's size check allows, else AQE splits a hot key's partition."""
    from inkwell.operators.ranking import join_null_safe
    totals = df.groupBy(*group).agg(F.sum(value).alias("_group_total"))
    out = join_null_safe(df, totals, list(group))
    return out.select(*df.columns, safe_div(F.col(value), F.col("_group_total")).alias(name))


def stats_by_category(df: DataFrame, keys: Sequence[str], value: str,
                      accuracy: int | None = None) -> DataFrame:
    """count, mean and median per group; nulls skipped in mean/median, a null
    key is its own group.

    Exact by default, and no group is held in one task: rows collapse once to
    distinct (group, value) counts (materialized, so the input is read once);
    count and mean follow from the counts, and ``median_from_counts`` finds
    the middle value(s) from prefix counts over ranges. ``accuracy`` switches
    the median to ``percentile_approx`` (bounded sketch per group) in a single
    aggregation."""
    from inkwell.operators.ranking import join_null_safe, median_from_counts
    from inkwell.session import materialize
    if accuracy is not None:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.avg(value).alias("avg_rating"),
                                     F.percentile_approx(value, 0.5, accuracy).alias("med_rating"))
    vc = materialize(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    v, n = F.col(value), F.col("_n")
    base = vc.groupBy(*keys).agg(F.sum(n).alias("count"), F.try_divide(
        F.sum(v * n), F.sum(F.when(v.isNotNull(), n))).alias("avg_rating"))
    med = median_from_counts(vc, keys, value, "med_rating")
    return join_null_safe(base, med, list(keys), "left")


def site_range_summary(df: DataFrame, site: str, value: str) -> DataFrame:
    return df.groupBy(site).agg(F.min(value).alias("min_reading"), F.max(value).alias("max_reading"),
                                F.count(F.lit(1)).alias("n_readings"))


def threshold_exceedance(df: DataFrame, site: str, value: str, limit: float) -> DataFrame:
    over = F.col(value) >= limit
    return df.groupBy(site).agg(F.count_if(over).alias("n_over"),
                                F.count(F.lit(1)).alias("n_readings"),
                                F.avg(over.cast("double")).alias("share_over"))
