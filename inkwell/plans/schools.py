"""School-score jobs on F4: changes, benchmarks, ranks, streaks, top-k
(SURVEY §2.6). Rates are always computed from raw counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators import ranking
from inkwell.plans import oracle_fixtures as O
from inkwell.plans.registry import finish, query
from inkwell.sources.fixtures import F1_YEARS, f4_scores
from inkwell.sources.tables import Tables

r6 = O.r6
BASE_YEAR = F1_YEARS[0]
TOPK = 10
MAX_SIZE = 15


def _scores(spark, sf_dir) -> DataFrame:
    return f4_scores(Tables(spark, sf_dir))


def _rollup(df: DataFrame, keys) -> DataFrame:
    """Counts summed to ``keys`` and the percent passing from those counts."""
    return (df.groupBy(*keys).agg(F.sum("tested").alias("tested"), F.sum("passed").alias("passed"))
            .withColumn("rate", ranking.rate("passed", "tested")))


def _school_year(spark, sf_dir) -> DataFrame:
    return _rollup(_scores(spark, sf_dir), ["district", "school", "year"])


def _school_change(spark, sf_dir) -> DataFrame:
    return ranking.yoy_point_change(_school_year(spark, sf_dir), ["school"], "rate")


F4 = O.with_(O.f4())
SY = F4.rstrip() + """,
sy AS (SELECT district, school, year, sum(tested) AS tested, sum(passed) AS passed,
              sum(passed) * 100.0 / nullif(sum(tested), 0) AS rate FROM f4 GROUP BY district, school, year),
sc AS (SELECT *, lag(year) OVER (PARTITION BY school ORDER BY year) AS prev_year,
              rate - lag(rate) OVER (PARTITION BY school ORDER BY year) AS change FROM sy)
"""
SGY = F4.rstrip() + """,
sg AS (SELECT district, school, grade, year, sum(tested) AS tested, sum(passed) AS passed,
              sum(passed) * 100.0 / nullif(sum(tested), 0) AS rate FROM f4 GROUP BY district, school, grade, year),
sgc AS (SELECT *, lag(year) OVER (PARTITION BY school, grade ORDER BY year) AS prev_year,
               rate - lag(rate) OVER (PARTITION BY school, grade ORDER BY year) AS change FROM sg)
"""


@query("yoy_point_change", sql=SGY + f"""
SELECT district, school, grade, year, {r6('rate', 'rate')}, prev_year, {r6('change', 'change')} FROM sgc""")
def yoy_point_change(spark, sf_dir):
    """Pass-rate change in points to the previous available year per school and grade."""
    sg = _rollup(_scores(spark, sf_dir), ["district", "school", "grade", "year"])
    df = ranking.yoy_point_change(sg, ["school", "grade"], "rate")
    return finish(df.select("district", "school", "grade", "year", "rate", "prev_year", "change"))


@query("change_since_base", sql=SY + f"""
SELECT school, year, {r6('rate', 'rate')}, {r6(f'max(CASE WHEN year = {BASE_YEAR} THEN rate END) OVER (PARTITION BY school)', 'base_value')},
       {r6(f'rate - max(CASE WHEN year = {BASE_YEAR} THEN rate END) OVER (PARTITION BY school)', 'change_since_base')}
FROM sy""")
def change_since_base(spark, sf_dir):
    """Each school's pass rate beside its base-year rate and the change since then."""
    df = ranking.change_since_base(_school_year(spark, sf_dir), ["school"], "rate", BASE_YEAR)
    return finish(df.select("school", "year", "rate", "base_value", "change_since_base"))


@query("vs_parent_benchmark", sql=SY + f"""
, dy AS (SELECT district, year, sum(passed) * 100.0 / nullif(sum(tested), 0) AS d_rate FROM f4 GROUP BY district, year),
dc AS (SELECT *, d_rate - lag(d_rate) OVER (PARTITION BY district ORDER BY year) AS d_change FROM dy)
SELECT sc.district, sc.school, sc.year, {r6('sc.rate', 'school_rate')}, {r6('dc.d_rate', 'district_rate')},
       {r6('sc.change', 'school_change')}, {r6('dc.d_change', 'district_change')},
       {r6('sc.change / nullif(dc.d_change, 0)', 'ratio')}
FROM sc JOIN dc ON sc.district = dc.district AND sc.year = dc.year""")
def vs_parent_benchmark(spark, sf_dir):
    """A school's change beside its district's change (district rate from the
    summed counts, never a mean of school rates), and their ratio."""
    scores = _scores(spark, sf_dir)
    school = ranking.yoy_point_change(_rollup(scores, ["district", "school", "year"]), ["school"], "rate")
    district = ranking.yoy_point_change(_rollup(scores, ["district", "year"]), ["district"], "rate")
    j = school.join(district.select("district", "year", F.col("rate").alias("district_rate"),
                                    F.col("change").alias("district_change")), ["district", "year"])
    return finish(j.select("district", "school", "year", F.col("rate").alias("school_rate"), "district_rate",
                           F.col("change").alias("school_change"), "district_change",
                           F.try_divide(F.col("change"), F.col("district_change")).alias("ratio")))


@query("rank_improvement", sql=SY + f"""
SELECT school, year, {r6('rate', 'rate')}, {r6('change', 'change')},
       CAST(rank() OVER (PARTITION BY year ORDER BY change DESC NULLS LAST) AS BIGINT) AS rank_change,
       CAST(rank() OVER (PARTITION BY year ORDER BY rate DESC NULLS LAST) AS BIGINT) AS rank_level_high,
       CAST(rank() OVER (PARTITION BY year ORDER BY rate ASC NULLS LAST) AS BIGINT) AS rank_level_low
FROM sc""")
def rank_improvement(spark, sf_dir):
    """Rank by change and by level (both directions) among each year's units,
    with the distributed rank (no year-sized window group)."""
    df = _school_change(spark, sf_dir).select("school", "year", "rate", "change")
    df = ranking.distributed_ranks(df, [("change", ["year"], False, "rank_change"),
                                        ("rate", ["year"], False, "rank_level_high"),
                                        ("rate", ["year"], True, "rank_level_low")])
    return finish(df.select("school", "year", "rate", "change", "rank_change", "rank_level_high", "rank_level_low"))


@query("rank_within_cohort", sql=SGY + f"""
SELECT school, grade, year, {r6('change', 'change')},
       CAST(rank() OVER (PARTITION BY year, grade ORDER BY change DESC NULLS LAST) AS BIGINT) AS rank_in_grade,
       CAST(rank() OVER (PARTITION BY year ORDER BY change DESC NULLS LAST) AS BIGINT) AS rank_any_grade
FROM sgc""")
def rank_within_cohort(spark, sf_dir):
    """Rank by change among the same grade, and among all grades, per year."""
    sg = ranking.yoy_point_change(_rollup(_scores(spark, sf_dir), ["district", "school", "grade", "year"]),
                                  ["school", "grade"], "rate").select("school", "grade", "year", "change")
    df = ranking.distributed_ranks(sg, [("change", ["year", "grade"], False, "rank_in_grade"),
                                        ("change", ["year"], False, "rank_any_grade")])
    return finish(df.select("school", "grade", "year", "change", "rank_in_grade", "rank_any_grade"))


@query("gap_to_next", sql=SY + f"""
SELECT school, year, {r6('rate', 'rate')},
       {r6('rate - lead(rate) OVER (PARTITION BY year ORDER BY rate DESC NULLS LAST, school)', 'gap_to_next')}
FROM sy""")
def gap_to_next(spark, sf_dir):
    """Each school's lead over the next-highest school in the same year."""
    df = ranking.gap_to_next(_school_year(spark, sf_dir), ["year"], "rate", "school")
    return finish(df.select("school", "year", "rate", "gap_to_next"))


@query("count_decliners", sql=SY + """
SELECT year, CAST(coalesce(count_if(change < 0), 0) AS BIGINT) AS n_decliners,
       CAST(coalesce(count_if(change > 0), 0) AS BIGINT) AS n_gainers,
       CAST(count(change) AS BIGINT) AS n_units
FROM sc GROUP BY year""")
def count_decliners(spark, sf_dir):
    """Per year, how many schools fell, rose, and had a change at all."""
    df = _school_change(spark, sf_dir)
    return df.groupBy("year").agg(F.count_if(F.col("change") < 0).cast("bigint").alias("n_decliners"),
                                  F.count_if(F.col("change") > 0).cast("bigint").alias("n_gainers"),
                                  F.count("change").cast("bigint").alias("n_units"))


@query("gain_streak", sql=SY + f"""
, g AS (SELECT *, coalesce(change > 0, false) AS gain,
        sum(CASE WHEN coalesce(change > 0, false) THEN 0 ELSE 1 END)
          OVER (PARTITION BY school ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM sc)
SELECT school, year, {r6('change', 'change')},
       CAST(CASE WHEN gain THEN sum(CAST(gain AS INTEGER)) OVER (PARTITION BY school, island ORDER BY year
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE 0 END AS INTEGER) AS streak
FROM g""")
def gain_streak(spark, sf_dir):
    """Consecutive years of pass-rate gains per school."""
    df = ranking.gain_streak(_school_change(spark, sf_dir), ["school"], "change")
    return finish(df.select("school", "year", "change", "streak"))


@query("topk_membership", sql=SY + f"""
SELECT year, district, CAST(count(*) AS BIGINT) AS n_in_top
FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY rate DESC NULLS LAST, school) AS pos FROM sy)
WHERE pos <= {TOPK} GROUP BY year, district""")
def topk_membership(spark, sf_dir):
    """How many of each year's top-10 schools each district has ("7 of 10")."""
    top = ranking.topk_per_group(_school_year(spark, sf_dir), ["year"],
                                 [F.col("rate").desc_nulls_last(), F.col("school")], TOPK)
    return top.groupBy("year", "district").agg(F.count(F.lit(1)).cast("bigint").alias("n_in_top"))


@query("small_unit_volatility", sql=SGY + f"""
SELECT year, CAST(count(*) AS BIGINT) AS n_top, CAST(count_if(tested <= {MAX_SIZE}) AS BIGINT) AS n_small
FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY abs(change) DESC, school, grade) AS pos
      FROM sgc WHERE change IS NOT NULL)
WHERE pos <= {TOPK} GROUP BY year""")
def small_unit_volatility(spark, sf_dir):
    """Of the k largest absolute changes per year, how many are in small units."""
    sg = ranking.yoy_point_change(_rollup(_scores(spark, sf_dir), ["district", "school", "grade", "year"]),
                                  ["school", "grade"], "rate").where(F.col("change").isNotNull())
    top = ranking.topk_per_group(sg, ["year"], [F.abs("change").desc(), F.col("school"), F.col("grade")], TOPK)
    return top.groupBy("year").agg(F.count(F.lit(1)).cast("bigint").alias("n_top"),
                                   F.count_if(F.col("tested") <= MAX_SIZE).cast("bigint").alias("n_small"))
