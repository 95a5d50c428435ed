"""Title-list jobs on F3: cleaning, statistics, ranks, top-k, sampling
(SURVEY §2.1, §2.2, §2.5, §2.7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.numeric import mix64_sql, safe_div
from inkwell.functions.text import trim_all
from inkwell.operators import ranking, shares, spelling
from inkwell.plans import oracle_fixtures as O
from inkwell.plans.registry import finish, query
from inkwell.session import materialize, scratch_path
from inkwell.sources import io
from inkwell.sources.fixtures import clean_titles, f3_raw, f3_titles
from inkwell.sources.tables import Tables

r6 = O.r6
T3 = O.with_(O.f3())
GENRE = "ECONOMY"
TOPK = 15
LO, HI = 20, 54
SAMPLE_N, SAMPLE_SEED = 10, 42

RAW_SCHEMA = T.StructType([
    T.StructField("title_id", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("state", T.StringType()), T.StructField("rating", T.DoubleType()),
    T.StructField("multiple_locations", T.StringType()), T.StructField("description", T.StringType())])


def _titles(spark, sf_dir) -> DataFrame:
    return f3_titles(Tables(spark, sf_dir))


def _staged_raw(spark, sf_dir) -> DataFrame:
    """F3 written as a headerless CSV (whitespace kept) and read back by position."""
    path = scratch_path(spark, "titles")
    (f3_raw(Tables(spark, sf_dir)).write.mode("overwrite").option("header", False)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return (spark.read.option("header", False).option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False).schema(RAW_SCHEMA).csv(path))


@query("scan_headerless_csv", sql=T3 + f"""
SELECT title_id, title, state, {r6('rating', 'rating')}, multiple_locations, description FROM f3_raw""")
def scan_headerless_csv(spark, sf_dir):
    """Title list written as a headerless CSV (whitespace kept) and read back by position."""
    return finish(_staged_raw(spark, sf_dir))


# The list with flaws: some lines lack their last field, have one too many or a rating that is none.
FLAWED = "title_id % 11"


@query("scan_rejects", sql=T3 + f"""
, r AS (SELECT *, CASE {FLAWED} WHEN 3 THEN 'short' WHEN 5 THEN 'long' WHEN 7 THEN 'unparsable value' END AS flaw FROM f3_raw)
SELECT coalesce(flaw, 'good') AS flaw, count(*) AS n_rows, {r6("sum(CASE WHEN flaw IS NULL THEN rating END)", 'rating_sum')},
  count(DISTINCT CASE WHEN flaw IS NULL THEN title_id END) AS n_titles FROM r GROUP BY ALL""")
def scan_rejects(spark, sf_dir):
    """The title list with flawed lines, read with a reject channel: rows and rating sum by flaw."""
    raw, kind = f3_raw(Tables(spark, sf_dir)), F.expr(FLAWED)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("title_id").cast("string"), quoted("title"), quoted("state"),
                       F.when(kind == 7, "n/a").otherwise(F.coalesce(F.col("rating").cast("string"), F.lit(""))),
                       F.col("multiple_locations"), F.when(kind != 3, F.col("description")), F.when(kind == 5, "extra"))
    path = scratch_path(spark, "flawed-titles")
    raw.select(line.alias("value")).write.text(path)
    df = io.scan_delimited_checked(spark, path, RAW_SCHEMA)
    good = F.col("flaw").isNull()
    return finish(df.select(F.coalesce("flaw", F.lit("good")).alias("flaw"), F.when(good, F.col("rating")).alias("rating"),
                            F.when(good, F.col("title_id")).alias("title_id"), io.REJECT).groupBy("flaw").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("rating").alias("rating_sum"), F.countDistinct("title_id").alias("n_titles")))


@query("misspelt_categories", sql=T3 + f"""
, seen AS (SELECT state_t AS value, count(*) AS n_rows FROM f3_trim GROUP BY ALL),
names AS (SELECT DISTINCT p_brand AS name FROM part),
near AS (SELECT value, name, levenshtein(value, name) AS distance FROM seen, names
         WHERE value NOT IN (SELECT name FROM names)
           AND levenshtein(value, name) <= CASE WHEN length(value) <= {spelling.SHORT} THEN {spelling.SHORT_EDITS} ELSE {spelling.EDITS} END),
best AS (SELECT value, min(distance) AS distance FROM near GROUP BY value),
f AS (SELECT b.value, CAST(b.distance AS INTEGER) AS distance, count(*) AS n_nearest,
             CASE WHEN count(*) = 1 THEN min(n.name) END AS fix
      FROM best b JOIN near n ON n.value = b.value AND n.distance = b.distance GROUP BY ALL)
SELECT s.value, s.n_rows, f.fix, f.distance, coalesce(f.n_nearest, 0) AS n_nearest
FROM seen s LEFT JOIN f ON f.value = s.value WHERE s.value NOT IN (SELECT name FROM names)""")
def misspelt_categories(spark, sf_dir):
    """State names that the list of right names lacks, with the one right name within two edits."""
    t = Tables(spark, sf_dir)
    seen = f3_raw(t).groupBy(trim_all("state").alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    found = spelling.corrections(seen, t.part.select(F.col("p_brand").alias("name")))
    return found.join(seen, "value").select("value", "n_rows", "fix", "distance", "n_nearest")


@query("trim_recode_category", sql=T3 + "SELECT title_id, state FROM f3")
def trim_recode_category(spark, sf_dir):
    """State names trimmed of all edge whitespace and misspellings recoded."""
    return _titles(spark, sf_dir).select("title_id", "state")


@query("title_year_split", sql=T3 + "SELECT title_id, title, year FROM f3")
def title_year_split(spark, sf_dir):
    """Title without its trailing year, and the first year in parentheses."""
    return _titles(spark, sf_dir).select("title_id", "title", "year")


@query("decade_bin", sql=T3 + "SELECT title_id, year, year_bin FROM f3")
def decade_bin(spark, sf_dir):
    """Title year and its decade (null stays null)."""
    return _titles(spark, sf_dir).select("title_id", "year", "year_bin")


STATS_SQL = "CAST(count(*) AS BIGINT) AS count, {}, {}".format(r6("avg(rating)", "avg_rating"),
                                                             r6("median(rating)", "med_rating"))


def _stats(spark, sf_dir, keys) -> DataFrame:
    """F3 ratings have four decimals: as decimals their sums don't depend on the order of partial
    sums, so no reported digit flips."""
    titles = _titles(spark, sf_dir).withColumn("rating", F.col("rating").cast("decimal(14,4)"))
    out = shares.stats_by_category(titles, keys, "rating")
    return finish(out.withColumns({c: F.col(c).cast("double") for c in ("avg_rating", "med_rating")}))


@query("stats_by_category", sql=T3 + f"SELECT state, {STATS_SQL} FROM f3 GROUP BY state")
def stats_by_category(spark, sf_dir):
    """Title count, mean and exact median rating per state."""
    return _stats(spark, sf_dir, ["state"])


@query("stats_by_category_decade", sql=T3 + f"SELECT state, year_bin, {STATS_SQL} FROM f3 GROUP BY state, year_bin")
def stats_by_category_decade(spark, sf_dir):
    """Title count, mean and exact median rating per state and decade."""
    return _stats(spark, sf_dir, ["state", "year_bin"])


RANKED_SQL = f"""
, c AS (SELECT state, CAST(count(*) AS BIGINT) AS count FROM f3 GROUP BY state),
rr AS (SELECT state, count, CAST(row_number() OVER (ORDER BY count DESC, state) AS INTEGER) AS pos FROM c)"""


def _ranked(spark, sf_dir) -> DataFrame:
    counts = _titles(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("count"))
    return ranking.rank_range(counts, "count", "state", LO, HI)


@query("rank_range", sql=T3.rstrip() + RANKED_SQL + f"SELECT * FROM rr WHERE pos BETWEEN {LO} AND {HI}")
def rank_range(spark, sf_dir):
    """States ranked 20 to 54 by number of titles."""
    return _ranked(spark, sf_dir)


@query("semi_join_ranked", sql=T3.rstrip() + RANKED_SQL + f"""
SELECT title_id, title, state FROM f3 WHERE state IN (SELECT state FROM rr WHERE pos BETWEEN {LO} AND {HI})""")
def semi_join_ranked(spark, sf_dir):
    """Titles whose state is in the rank 20-54 tail."""
    tail = _ranked(spark, sf_dir).select("state")
    return _titles(spark, sf_dir).join(tail, "state", "left_semi").select("title_id", "title", "state")


@query("topk_per_group", sql=T3 + f"""
SELECT * FROM (SELECT state, title_id, title, {r6('rating', 'rating')},
  CAST(row_number() OVER (PARTITION BY state ORDER BY rating DESC NULLS LAST, title_id) AS INTEGER) AS pos FROM f3)
WHERE pos <= {TOPK}""")
def topk_per_group(spark, sf_dir):
    """Top 15 titles by rating per state."""
    df = _titles(spark, sf_dir).select("state", "title_id", "title", "rating")
    return finish(ranking.topk_per_group(df, ["state"], [F.col("rating").desc_nulls_last(), F.col("title_id")], TOPK))


@query("sample_n", sql=T3 + f"""
SELECT title_id, title, state FROM f3 ORDER BY {mix64_sql('title_id', SAMPLE_SEED)}, title_id LIMIT {SAMPLE_N}""")
def sample_n(spark, sf_dir):
    """Exactly 10 repeatable pseudo-random titles (seeded integer scramble of the key)."""
    return ranking.sample_n(_titles(spark, sf_dir).select("title_id", "title", "state"), "title_id", SAMPLE_N,
                            SAMPLE_SEED)


@query("leaderboard_count", sql=T3 + f"""
SELECT state, n, CAST(rank() OVER (ORDER BY n DESC) AS BIGINT) AS rank
FROM (SELECT state, CAST(count_if(genre = '{GENRE}') AS BIGINT) AS n FROM f3 GROUP BY state)""")
def leaderboard_count(spark, sf_dir):
    """Titles of one genre per state, ranked."""
    counts = (_titles(spark, sf_dir).groupBy("state")
              .agg(F.count_if(F.col("genre") == GENRE).cast("bigint").alias("n")))
    return ranking.rank_with_total(counts, "n").drop("n_total")


@query("cohort_count_by_period", sql=T3 + f"""
, axis AS (SELECT unnest(range(CAST(min(year_bin) AS BIGINT), CAST(max(year_bin) AS BIGINT) + 1, 10)) AS d FROM f3),
c AS (SELECT year_bin, count_if(genre = '{GENRE}') AS n_genre, count(*) AS n_all FROM f3 GROUP BY year_bin)
SELECT CAST(axis.d AS INTEGER) AS year_bin, CAST(coalesce(n_genre, 0) AS BIGINT) AS n_genre,
       CAST(coalesce(n_all, 0) AS BIGINT) AS n_all, {r6('CAST(n_genre AS DOUBLE) / nullif(n_all, 0)', 'share')}
FROM axis LEFT JOIN c ON c.year_bin = axis.d""")
def cohort_count_by_period(spark, sf_dir):
    """Titles of one genre per decade and their share, on a dense decade axis
    (decades without titles appear with 0)."""
    titles = _titles(spark, sf_dir).where(F.col("year_bin").isNotNull())
    # Per-decade counts are read twice (axis bounds and the join), so they are
    # materialized once rather than re-aggregating the titles for each read.
    counts = materialize(titles.groupBy("year_bin").agg(F.count_if(F.col("genre") == GENRE).alias("n_genre"),
                                                        F.count(F.lit(1)).alias("n_all")))
    axis = counts.agg(F.min("year_bin").alias("lo"), F.max("year_bin").alias("hi")).select(
        F.explode(F.sequence("lo", "hi", F.lit(10))).alias("year_bin"))
    out = axis.join(counts, "year_bin", "left").select(
        F.col("year_bin").cast("int"), F.coalesce("n_genre", F.lit(0)).cast("bigint").alias("n_genre"),
        F.coalesce("n_all", F.lit(0)).cast("bigint").alias("n_all"),
        safe_div(F.col("n_genre").cast("double"), F.col("n_all")).alias("share"))
    return finish(out)


@query("topk_membership_titles", sql=T3 + f"""
SELECT state, CAST(count_if(genre = '{GENRE}') AS BIGINT) AS n_genre_in_top, CAST(count(*) AS BIGINT) AS n_top
FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY rating DESC NULLS LAST, title_id) AS pos FROM f3)
WHERE pos <= {TOPK} GROUP BY state""")
def topk_membership_titles(spark, sf_dir):
    """How many of each state's top 15 titles belong to one genre ("7 of the 15")."""
    top = ranking.topk_per_group(_titles(spark, sf_dir), ["state"],
                                 [F.col("rating").desc_nulls_last(), F.col("title_id")], TOPK)
    return top.groupBy("state").agg(F.count_if(F.col("genre") == GENRE).cast("bigint").alias("n_genre_in_top"),
                                    F.count(F.lit(1)).cast("bigint").alias("n_top"))

