"""Precinct jobs: attribute normalisation, winners, margins, no-vote state,
flips and shares (SURVEY §2.2, §2.4, §2.10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.numeric import js_round, safe_div
from inkwell.functions.text import capitalize_first

NO_VOTERS = "no voters"


def number_or_zero(c) -> Column:
    """Number parsed from text; unparseable, empty or NaN -> 0 (the map's intent)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nanvl(c.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def precinct_enrich_join(runoff: DataFrame, first_round: DataFrame, demographics: DataFrame,
                         key: str = "precinct_geo") -> DataFrame:
    """Runoff precincts with the first-round leader and demographics (left joins
    on the precinct key; all three sides are keyed by precinct, so Spark
    co-partitions them with one shuffle per side at most)."""
    return runoff.join(first_round, key, "left").join(demographics, key, "left")


def parse_votes(runoff: DataFrame) -> DataFrame:
    """Runoff numbers parsed (non-numeric -> 0), with the first-round leader."""
    return runoff.select("precinct_geo", number_or_zero("gonzalez").alias("gonzalez"),
                         number_or_zero("higgins").alias("higgins"), number_or_zero("precinct_total").alias("total_votes"),
                         F.col("winner").alias("first_round_winner"))


def normalize_precinct_attrs(df: DataFrame) -> DataFrame:
    """'?' -> empty text, percent suffix, first letter upper-case, numbers
    parsed with non-numeric -> 0."""
    unknown_race = F.col("race") == "?"
    unknown_imm = F.col("immigrant_prop") == "?"
    return df.select(
        "precinct_geo",
        number_or_zero("gonzalez").alias("gonzalez"),
        number_or_zero("higgins").alias("higgins"),
        number_or_zero("precinct_total").alias("total_votes"),
        F.col("winner").alias("first_round_winner"),
        F.when(unknown_race, "").otherwise(capitalize_first(F.col("race"))).alias("race"),
        F.when(unknown_imm, "").otherwise(F.concat(F.col("immigrant_prop"), F.lit("%"))).alias("immigrant_label"),
        F.when(unknown_imm, F.lit(None).cast("double"))
         .otherwise(F.col("immigrant_prop").try_cast("double")).alias("immigrant_pct"))


def precinct_winner(df: DataFrame, a: str = "gonzalez", b: str = "higgins",
                    names: tuple[str, str] = ("Gonzalez", "Higgins"), raw: bool = False,
                    keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Winner and margin on shares rounded half-up to integers (``raw=True``
    compares unrounded shares). A tie goes to the second-listed candidate,
    because the comparison is a strict ``>``. No votes -> no winner."""
    ra = F.col(a) if raw else js_round(a)
    rb = F.col(b) if raw else js_round(b)
    voted = F.col("total_votes") != 0
    a_wins = ra > rb
    return df.select(
        "precinct_geo", "total_votes",
        ra.alias(a + "_rounded"), rb.alias(b + "_rounded"),
        F.when(voted, F.when(a_wins, names[0]).otherwise(names[1])).alias("winner"),
        F.when(voted, F.abs(ra - rb)).alias("margin"),
        F.when(voted, F.when(a_wins, ra).otherwise(rb)).alias("winner_share"), *keep)


def no_vote_flag(df: DataFrame) -> DataFrame:
    return df.select("precinct_geo", "total_votes",
                     F.when(F.col("total_votes") == 0, NO_VOTERS).otherwise("voters").alias("state"))


def flag_flips(winners: DataFrame) -> DataFrame:
    """First-round leader beside the runoff winner; flipped when both exist and differ."""
    j = winners.select("precinct_geo", F.col("winner").alias("runoff_winner"), "first_round_winner")
    known = (F.col("first_round_winner") != "?") & F.col("runoff_winner").isNotNull()
    return j.withColumn("flipped", F.coalesce(known & (F.col("first_round_winner") != F.col("runoff_winner")),
                                              F.lit(False)))


def precinct_shares(votes: DataFrame, key: str, cand: str, total: str) -> DataFrame:
    """Candidate share per precinct and one citywide row (``scope = 'city'``).

    The citywide share is a global aggregate of the counts (a sum of sums,
    never a mean of shares) appended as its own row, so no precinct row waits
    on a global window."""
    per = votes.select(F.lit("precinct").alias("scope"), F.col(key).alias("precinct_geo"),
                       F.col(cand).alias("votes"), F.col(total).alias("total_votes"),
                       safe_div(F.col(cand) * 100.0, F.col(total)).alias("share"))
    city = votes.agg(F.sum(cand).alias("votes"), F.sum(total).alias("total_votes")).select(
        F.lit("city").alias("scope"), F.lit(None).cast(votes.schema[key].dataType).alias("precinct_geo"),
        "votes", "total_votes", safe_div(F.col("votes") * 100.0, F.col("total_votes")).alias("share"))
    return per.unionByName(city)
