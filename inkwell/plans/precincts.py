"""Precinct jobs on F5 and noise-reading jobs on F6 (SURVEY §2.1, §2.2, §2.4,
§2.5, §2.10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.bins import legend_class
from inkwell.operators import elections, ranking, shares
from inkwell.plans import oracle_fixtures as O
from inkwell.plans.registry import finish, query
from inkwell.session import materialize, scratch_path
from inkwell.sources.fixtures import (
    f5_demographics, f5_first_round, f5_runoff, f5_vote_counts, f6_readings, precinct_votes,
)
from inkwell.sources.tables import Tables

r6 = O.r6
P = O.with_(O.f5())
LIMIT_DB = 70.0


def _sources(spark, sf_dir):
    """Runoff, first-round and demographic views. The runoff and first-round
    views come from one per-precinct vote aggregate of lineitem, materialized
    once: each view prunes that aggregate differently, so without it every
    view would rescan lineitem."""
    t = Tables(spark, sf_dir)
    votes = materialize(precinct_votes(t))
    return f5_runoff(t, votes), f5_first_round(t, votes), f5_demographics(t)


def _features(spark, sf_dir) -> DataFrame:
    return elections.precinct_enrich_join(*_sources(spark, sf_dir))


def _normalized(spark, sf_dir) -> DataFrame:
    return elections.normalize_precinct_attrs(_features(spark, sf_dir))


def _votes(spark, sf_dir) -> DataFrame:
    """Parsed runoff numbers of every precinct with its first-round leader, from
    one projection of the vote aggregate: jobs that need no demographics join
    nothing."""
    t = Tables(spark, sf_dir)
    return elections.parse_votes(f5_runoff(t, first_round=True))


@query("precinct_enrich_join", sql=P + "SELECT * FROM f5")
def precinct_enrich_join(spark, sf_dir):
    """Runoff results joined with the first-round leader and demographics per precinct."""
    return _features(spark, sf_dir)


@query("scan_precincts", sql=P + f"""
SELECT precinct_geo, {r6('TRY_CAST(gonzalez AS DOUBLE)', 'gonzalez')}, {r6('TRY_CAST(higgins AS DOUBLE)', 'higgins')},
       TRY_CAST(precinct_total AS BIGINT) AS precinct_total, winner, race, immigrant_prop FROM f5""")
def scan_precincts(spark, sf_dir):
    """Staged precinct features (string properties) read back, numbers via try_cast."""
    path = scratch_path(spark, "precincts")
    _features(spark, sf_dir).write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    return finish(df.select("precinct_geo", F.col("gonzalez").try_cast("double").alias("gonzalez"),
                            F.col("higgins").try_cast("double").alias("higgins"),
                            F.col("precinct_total").try_cast("bigint").alias("precinct_total"),
                            "winner", "race", "immigrant_prop"))


@query("normalize_precinct_attrs", sql=P + f"""
SELECT precinct_geo, {r6('gonzalez', 'gonzalez')}, {r6('higgins', 'higgins')}, {r6('total_votes', 'total_votes')},
       first_round_winner, race, immigrant_label, {r6('immigrant_pct', 'immigrant_pct')} FROM f5_norm""")
def normalize_precinct_attrs(spark, sf_dir):
    """Precinct properties normalized: numbers parsed (bad text -> 0), '?' -> empty, capitalised group, percent label."""
    return finish(_normalized(spark, sf_dir))


WINNER_SQL = """
, w AS (SELECT precinct_geo, total_votes, CAST(floor(gonzalez + 0.5) AS BIGINT) AS g, CAST(floor(higgins + 0.5) AS BIGINT) AS h
        FROM f5_norm),
win AS (SELECT precinct_geo, total_votes, g AS gonzalez_rounded, h AS higgins_rounded,
        CASE WHEN total_votes <> 0 THEN CASE WHEN g > h THEN 'Gonzalez' ELSE 'Higgins' END END AS winner,
        CASE WHEN total_votes <> 0 THEN abs(g - h) END AS margin,
        CASE WHEN total_votes <> 0 THEN CASE WHEN g > h THEN g ELSE h END END AS winner_share FROM w)
"""


@query("precinct_winner", sql=P.rstrip() + WINNER_SQL + f"""
SELECT precinct_geo, {r6('total_votes', 'total_votes')}, gonzalez_rounded, higgins_rounded, winner, margin, winner_share
FROM win""")
def precinct_winner(spark, sf_dir):
    """Winner, margin and winner's share on shares rounded half-up (ties to the second-listed)."""
    return finish(elections.precinct_winner(_votes(spark, sf_dir)))


@query("no_vote_flag", sql=P + f"""
SELECT precinct_geo, {r6('total_votes', 'total_votes')},
       CASE WHEN total_votes = 0 THEN 'no voters' ELSE 'voters' END AS state FROM f5_norm""")
def no_vote_flag(spark, sf_dir):
    """Precincts without any vote flagged as 'no voters'."""
    return finish(elections.no_vote_flag(_votes(spark, sf_dir)))


@query("winner_flip", sql=P.rstrip() + WINNER_SQL + """
SELECT win.precinct_geo, win.winner AS runoff_winner, f.winner AS first_round_winner,
       coalesce(f.winner <> '?' AND win.winner IS NOT NULL AND f.winner <> win.winner, false) AS flipped
FROM win LEFT JOIN f5_first f ON f.precinct_geo = win.precinct_geo""")
def winner_flip(spark, sf_dir):
    """First-round leader beside the runoff winner, flagged when they differ."""
    return elections.flag_flips(elections.precinct_winner(_votes(spark, sf_dir), keep=["first_round_winner"]))


@query("precinct_shares", sql=P + f"""
, v AS (SELECT p_partkey AS precinct_geo, CAST(a AS BIGINT) AS votes, CAST(a + r AS BIGINT) AS total_votes FROM f5_votes)
SELECT 'precinct' AS scope, precinct_geo, votes, total_votes, {r6('votes * 100.0 / nullif(total_votes, 0)', 'share')} FROM v
UNION ALL
SELECT 'city', NULL, CAST(sum(votes) AS BIGINT), CAST(sum(total_votes) AS BIGINT),
       {r6('sum(votes) * 100.0 / nullif(sum(total_votes), 0)', 'share')} FROM v""")
def precinct_shares(spark, sf_dir):
    """First candidate's vote share per precinct plus one citywide row from summed counts."""
    votes = materialize(f5_vote_counts(Tables(spark, sf_dir)))      # precinct rows and the city's
    return finish(elections.precinct_shares(votes, "precinct_geo", "votes_a", "votes_total"))


@query("legend_classes", sql=P + f"""
SELECT precinct_geo, {r6('gonzalez', 'gonzalez')},
       CASE WHEN gonzalez >= 0 AND gonzalez < 12.5 THEN '0-12.5' WHEN gonzalez >= 12.5 AND gonzalez < 25 THEN '12.5-25'
            WHEN gonzalez >= 25 AND gonzalez < 50 THEN '25-50' WHEN gonzalez >= 50 AND gonzalez < 75 THEN '50-75'
            WHEN gonzalez >= 75 AND gonzalez <= 100 THEN '75-100' END AS class
FROM f5_norm WHERE total_votes > 0""")
def legend_classes(spark, sf_dir):
    """First candidate's share per voting precinct and its legend class."""
    df = _votes(spark, sf_dir).where(F.col("total_votes") > 0)
    return finish(df.select("precinct_geo", "gonzalez", legend_class("gonzalez").alias("class")))


# ------------------------------------------------------------- noise readings (F6)
N = O.with_(O.f6())


@query("site_range_summary", sql=N + f"""
SELECT site, {r6('min(reading)', 'min_reading')}, {r6('max(reading)', 'max_reading')},
       CAST(count(*) AS BIGINT) AS n_readings,
       CAST(rank() OVER (ORDER BY max(reading) DESC) AS BIGINT) AS loudness_rank
FROM f6 GROUP BY site""")
def site_range_summary(spark, sf_dir):
    """min-max reading per site, loudest first (rank over one row per site)."""
    df = shares.site_range_summary(f6_readings(Tables(spark, sf_dir)), "site", "reading")
    ranked = ranking.rank_with_total(df, "max_reading").withColumnRenamed("rank", "loudness_rank").drop("n_total")
    return finish(ranked)


@query("threshold_exceedance", sql=N + f"""
SELECT site, CAST(count_if(reading >= {LIMIT_DB}) AS BIGINT) AS n_over, CAST(count(*) AS BIGINT) AS n_readings,
       {r6(f'avg(CASE WHEN reading >= {LIMIT_DB} THEN 1.0 ELSE 0.0 END)', 'share_over')}
FROM f6 GROUP BY site""")
def threshold_exceedance(spark, sf_dir):
    """Readings at or above 70 per site: count and share."""
    df = shares.threshold_exceedance(f6_readings(Tables(spark, sf_dir)), "site", "reading", LIMIT_DB)
    return finish(df.select("site", F.col("n_over").cast("bigint"), F.col("n_readings").cast("bigint"), "share_over"))
