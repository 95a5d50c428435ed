"""Census-table jobs on F2 (wide survey table + dictionary), SURVEY §2.1-2.6."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.operators import ranking, reshape, shares, verify
from inkwell.plans import oracle_fixtures as O
from inkwell.plans.registry import finish, query
from inkwell.session import scratch_path
from inkwell.sources import io
from inkwell.sources.fixtures import F2_BASE, f2_dictionary, f2_wide
from inkwell.sources.tables import Tables

NATION = "050"
E = [f"{F2_BASE}_e{i:03d}" for i in range(1, 7)]
M = [f"{F2_BASE}_m{i:03d}" for i in range(1, 7)]
UNIVERSE_VAR = f"{F2_BASE}_001"
FLAGSHIP_VAR = f"{F2_BASE}_002"


def _wide(spark, sf_dir) -> DataFrame:
    return f2_wide(Tables(spark, sf_dir))


def _decoded(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    return reshape.decode_variables(f2_wide(t), f2_dictionary(t))


F2 = O.with_(O.f2_wide())
F2D = O.with_(O.f2_wide(), O.f2_dictionary(), O.f2_long())
DECODED_SQL = F2D + f"""
SELECT l.geo_id, l.var, l.ordinal, {O.r6('l.e', 'e')}, {O.r6('l.m', 'm')}, d.stub
FROM f2_long l LEFT JOIN f2_dict d ON l.var = d.unique_id"""


def _unpivot_sql() -> str:
    parts = [f"SELECT geo_id, '{c}' AS var, {i + 1} AS ordinal, {c} AS value FROM f2"
             for i, c in enumerate(O.F2_COLS)]
    return "\n, f2_unpivot AS (" + " UNION ALL ".join(parts) + ")\n"


F2U = F2.rstrip() + _unpivot_sql()
SPLIT = "regexp_extract(var, '^(.*)_([em])([0-9]+)$', {})"


# ------------------------------------------------------------- flagship
def flagship(spark, sf_dir, var: str = FLAGSHIP_VAR) -> DataFrame:
    """Which nation has the largest share of a segment, and its rank among all.

    wide table -> nation level -> decode (only the two variables needed) ->
    share of the universe row -> distributed rank with population size."""
    wide = _wide(spark, sf_dir).where(F.col("geo_id").startswith(NATION))
    t = Tables(spark, sf_dir)
    long_df = reshape.decode_variables(wide, f2_dictionary(t), variables=[UNIVERSE_VAR, var])
    shared = shares.fixed_denominator_share(long_df, UNIVERSE_VAR)
    ranked = ranking.rank_with_total(shared.where(F.col("var") == var), "share")
    return finish(ranked.select("geo_id", "var", "stub", "e", "universe", "share", "rank", "n_total"))


query("rank_with_total", sql=F2D + f"""
, s AS (
  SELECT l.geo_id, l.var, d.stub, l.e, u.e AS universe, l.e / nullif(u.e, 0) AS share
  FROM f2_long l JOIN f2_long u ON u.geo_id = l.geo_id AND u.var = '{UNIVERSE_VAR}'
  LEFT JOIN f2_dict d ON l.var = d.unique_id
  WHERE l.var = '{FLAGSHIP_VAR}' AND starts_with(l.geo_id, '{NATION}'))
SELECT geo_id, var, stub, {O.r6('e', 'e')}, {O.r6('universe', 'universe')}, {O.r6('share', 'share')},
       CAST(rank() OVER (ORDER BY share DESC NULLS LAST) AS BIGINT) AS rank,
       CAST(count(*) OVER () AS BIGINT) AS n_total
FROM s""")(flagship)


# ------------------------------------------------------------- scans / sinks
@query("scan_pipe_delimited", sql=F2 + "SELECT * FROM f2")
def scan_pipe_delimited(spark, sf_dir):
    """Round trip: write F2 as an upper-cased pipe file, read it back normalized."""
    wide = _wide(spark, sf_dir)
    shouting = wide.select(F.upper("geo_id").alias("GEO_ID"),
                           *[F.col(c).alias(c.upper()) for c in wide.columns if c != "geo_id"])
    path = io.sink_csv(shouting, scratch_path(spark, "pipe"), sep="|")
    return finish(io.scan_pipe_delimited(spark, path))


DICT_SCHEMA = T.StructType([T.StructField("unique_id", T.StringType()), T.StructField("stub", T.StringType()),
                            T.StructField("is_leaf", T.BooleanType()), T.StructField("line", T.IntegerType()),
                            T.StructField("data_release", T.StringType())])


@query("scan_dictionary", sql=O.with_(O.f2_dictionary()) + "SELECT unique_id, stub, is_leaf FROM f2_dict")
def scan_dictionary(spark, sf_dir):
    """Staged dictionary file -> drop ``line`` and ``data_release``."""
    path = io.sink_csv(f2_dictionary(Tables(spark, sf_dir), as_delivered=True), scratch_path(spark, "dict"))
    return (spark.read.option("header", True).schema(DICT_SCHEMA).csv(path)
            .drop("line", "data_release"))


@query("sink_csv", sql=DECODED_SQL)
def sink_csv(spark, sf_dir):
    """Write the decoded table as CSV and read it back with its schema."""
    dec = _decoded(spark, sf_dir)
    path = io.sink_csv(dec, scratch_path(spark, "decoded"))
    return finish(spark.read.option("header", True).schema(dec.schema).csv(path))


# ------------------------------------------------------------- projections, filters
@query("project_columns", sql=F2 + f"SELECT geo_id, {E[0]}, {E[1]}, {M[1]} FROM f2")
def project_columns(spark, sf_dir):
    """Three columns of the wide table."""
    return finish(_wide(spark, sf_dir).select("geo_id", E[0], E[1], M[1]))


GEO_ONE = "0500000us7"


@query("filter_geo_equals", sql=F2 + f"SELECT * FROM f2 WHERE geo_id = '{GEO_ONE}'")
def filter_geo_equals(spark, sf_dir):
    """The wide row of one geography."""
    return finish(f2_wide(Tables(spark, sf_dir), nations=[int(GEO_ONE.removeprefix("0500000us"))]))


@query("filter_geo_level", sql=F2 + f"SELECT geo_id, {E[0]}, {E[2]} FROM f2 WHERE starts_with(geo_id, '{NATION}')")
def filter_geo_level(spark, sf_dir):
    """Nation-level rows (code prefix 050) of the wide table."""
    return finish(_wide(spark, sf_dir).where(F.col("geo_id").startswith(NATION)).select("geo_id", E[0], E[2]))


@query("rowwise_component_sum", sql=F2 + f"SELECT geo_id, {O.r6(f'{E[1]} + {E[2]} + {E[3]}', 'total')} FROM f2")
def rowwise_component_sum(spark, sf_dir):
    """Sum of three segment columns per geography (null if any is null)."""
    df = shares.rowwise_component_sum(_wide(spark, sf_dir), [E[1], E[2], E[3]])
    return finish(df.select("geo_id", "total"))


@query("share_of_universe", sql=F2 + f"""
SELECT geo_id, {O.r6(f'({E[1]} + {E[2]}) / nullif({E[0]}, 0)', 'prop')},
       {O.r6(f'{E[1]} / nullif({E[0]}, 0)', 'prop_single')}
FROM f2 WHERE starts_with(geo_id, '{NATION}')""")
def share_of_universe(spark, sf_dir):
    """Share of two segments, and of one, in each nation's customers."""
    df = _wide(spark, sf_dir).where(F.col("geo_id").startswith(NATION))
    df = shares.share_of_universe(df, [E[1], E[2]], E[0], "prop")
    df = shares.share_of_universe(df, [E[1]], E[0], "prop_single")
    return finish(df.select("geo_id", "prop", "prop_single"))


@query("difference_column", sql=F2 + f"SELECT geo_id, {O.r6(f'{E[0]} - {M[0]}', 'diff')} FROM f2")
def difference_column(spark, sf_dir):
    """Total customers minus negative-balance customers per geography."""
    return finish(shares.difference_column(_wide(spark, sf_dir), E[0], M[0]).select("geo_id", "diff"))


# ------------------------------------------------------------- reshaping
@query("unpivot_wide", sql=F2U + f"SELECT geo_id, var, ordinal, {O.r6('value', 'value')} FROM f2_unpivot")
def unpivot_wide(spark, sf_dir):
    """Every value column of the wide table as (var, ordinal, value)."""
    return finish(reshape.unpivot_wide(_wide(spark, sf_dir)))


@query("split_code", sql=F2U + f"""
SELECT geo_id, var, {SPLIT.format(1)} AS base, {SPLIT.format(2)} AS type, {SPLIT.format(3)} AS num FROM f2_unpivot""")
def split_code(spark, sf_dir):
    """Unpivoted codes split into base, type and number with an anchored pattern."""
    df = reshape.split_code(reshape.unpivot_wide(_wide(spark, sf_dir)))
    return df.select("geo_id", "var", "base", "type", "num")


@query("pivot_estimate_margin", sql=F2U + f"""
, s AS (SELECT geo_id, ordinal, value, {SPLIT.format(1)} AS base, {SPLIT.format(2)} AS type,
        {SPLIT.format(3)} AS num FROM f2_unpivot)
SELECT geo_id, base, num, min(ordinal) AS ordinal,
       {O.r6("max(CASE WHEN type = 'e' THEN value END)", 'e')},
       {O.r6("max(CASE WHEN type = 'm' THEN value END)", 'm')}
FROM s GROUP BY geo_id, base, num""")
def pivot_estimate_margin(spark, sf_dir):
    """Unpivoted, code-split cells pivoted back to estimate and margin columns."""
    long_df = reshape.split_code(reshape.unpivot_wide(_wide(spark, sf_dir)))
    return finish(reshape.pivot_estimate_margin(long_df))


@query("decode_variables", sql=DECODED_SQL)
def decode_variables(spark, sf_dir):
    """Wide survey table decoded to (geo, var, ordinal, estimate, margin, label) for every geography."""
    return finish(_decoded(spark, sf_dir))


@query("left_join_dictionary", sql=F2D + """
SELECT l.geo_id, l.var, d.stub FROM f2_long l LEFT JOIN f2_dict d ON l.var = d.unique_id""")
def left_join_dictionary(spark, sf_dir):
    """Decoded variables labelled from the dictionary."""
    t = Tables(spark, sf_dir)
    long_df = reshape.decode_variables(f2_wide(t))
    return reshape.left_join_dictionary(long_df.drop("stub"), f2_dictionary(t)).select("geo_id", "var", "stub")


# ------------------------------------------------------------- positional and share jobs
SLICE = [2, 3, 4, 6]   # a list with a gap


@query("slice_positions", sql=F2D + f"""
SELECT geo_id, var, ordinal, {O.r6('e', 'e')} FROM f2_long WHERE ordinal IN ({', '.join(map(str, SLICE))})""")
def slice_positions(spark, sf_dir):
    """Decoded rows at positions 2-4 and 6 (a list with a gap)."""
    return finish(ranking.slice_positions(reshape.decode_variables(_wide(spark, sf_dir)), SLICE).select("geo_id", "var", "ordinal", "e"))


GROUPS = {"first_two": [f"{F2_BASE}_002", f"{F2_BASE}_003"], "last_two": [f"{F2_BASE}_005", f"{F2_BASE}_006"]}


@query("group_total_of_selected", sql=F2D + f"""
SELECT geo_id, CASE WHEN var IN ('{GROUPS['first_two'][0]}', '{GROUPS['first_two'][1]}') THEN 'first_two'
                    ELSE 'last_two' END AS "group", {O.r6('sum(e)', 'e')}
FROM f2_long WHERE var IN ('{"', '".join(GROUPS['first_two'] + GROUPS['last_two'])}')
GROUP BY ALL""")
def group_total_of_selected(spark, sf_dir):
    """Sums of two hand-picked pairs of variables per geography."""
    return finish(shares.group_total_of_selected(reshape.decode_variables(_wide(spark, sf_dir)), GROUPS))


@query("fixed_denominator_share", sql=F2D + f"""
SELECT l.geo_id, l.var, {O.r6('l.e', 'e')}, {O.r6('u.e', 'universe')}, {O.r6('l.e / nullif(u.e, 0)', 'share')},
       {O.r6('100.0 * l.e / nullif(u.e, 0)', 'share_pct')}
FROM f2_long l LEFT JOIN f2_long u ON u.geo_id = l.geo_id AND u.var = '{UNIVERSE_VAR}'
WHERE starts_with(l.geo_id, '{NATION}')""")
def fixed_denominator_share(spark, sf_dir):
    """Each variable's estimate divided by its geography's universe row, also in percent."""
    dec = reshape.decode_variables(_wide(spark, sf_dir).where(F.col("geo_id").startswith(NATION)))
    df = shares.fixed_denominator_share(dec, UNIVERSE_VAR)
    df = df.withColumn("share_pct", F.try_divide(F.col("e") * 100.0, F.col("universe")))
    return finish(df.select("geo_id", "var", "e", "universe", "share", "share_pct"))


@query("sort_desc_share", sql=F2D + f"""
, s AS (SELECT l.geo_id, l.var, d.stub, l.e, l.e / nullif(u.e, 0) AS share
        FROM f2_long l JOIN f2_dict d ON l.var = d.unique_id AND d.is_leaf
        LEFT JOIN f2_long u ON u.geo_id = l.geo_id AND u.var = '{UNIVERSE_VAR}'
        WHERE starts_with(l.var, '{F2_BASE}_'))
SELECT geo_id, var, stub, {O.r6('e', 'e')}, {O.r6('share', 'share')},
       CAST(row_number() OVER (PARTITION BY geo_id ORDER BY e DESC NULLS LAST, var) AS INTEGER) AS pos
FROM s""")
def sort_desc_share(spark, sf_dir):
    """Leaf variables per geography by estimate descending, with share and position."""
    t = Tables(spark, sf_dir)
    # One dictionary join brings both the label and the leaf flag.
    dim = f2_dictionary(t).select(F.col("unique_id").alias("var"), "stub", "is_leaf")
    dec = reshape.decode_variables(f2_wide(t)).drop("stub").join(dim, "var", "left")
    shared = shares.fixed_denominator_share(dec, UNIVERSE_VAR)
    df = shared.where(F.col("is_leaf") & F.col("var").startswith(F2_BASE + "_"))
    return finish(ranking.sort_desc_share(df, ["geo_id"], "e", "var").select("geo_id", "var", "stub", "e", "share", "pos"))


@query("sort_desc_two_shares", sql=F2D + f"""
, s AS (SELECT l.geo_id, l.var, d.stub, l.e, l.e / nullif(u.e, 0) AS share,
               l.e / nullif((SELECT sum(e) FROM f2_long WHERE var = '{UNIVERSE_VAR}' AND starts_with(geo_id, '{NATION}')), 0)
               AS share_of_all
        FROM f2_long l JOIN f2_dict d ON l.var = d.unique_id AND d.is_leaf
        LEFT JOIN f2_long u ON u.geo_id = l.geo_id AND u.var = '{UNIVERSE_VAR}'
        WHERE starts_with(l.var, '{F2_BASE}_') AND starts_with(l.geo_id, '{NATION}'))
SELECT geo_id, var, stub, {O.r6('e', 'e')}, {O.r6('share', 'share')}, {O.r6('share_of_all', 'share_of_all')},
       CAST(row_number() OVER (PARTITION BY geo_id ORDER BY e DESC NULLS LAST, var) AS INTEGER) AS pos
FROM s""")
def sort_desc_two_shares(spark, sf_dir):
    """Leaf variables per nation by estimate descending, as share of the nation and share of everyone."""
    t = Tables(spark, sf_dir)
    dim = f2_dictionary(t).select(F.col("unique_id").alias("var"), "stub", "is_leaf")
    wide = f2_wide(t).where(F.col("geo_id").startswith(NATION))
    everyone = wide.agg(F.sum(E[0])).scalar()       # one number, as a scalar subquery
    shared = shares.fixed_denominator_share(
        reshape.decode_variables(wide).drop("stub").join(dim, "var", "left"), UNIVERSE_VAR)
    df = shared.where(F.col("is_leaf") & F.col("var").startswith(F2_BASE + "_")).withColumn(
        "share_of_all", F.try_divide(F.col("e"), everyone))
    return finish(ranking.sort_desc_share(df, ["geo_id"], "e", "var").select(
        "geo_id", "var", "stub", "e", "share", "share_of_all", "pos"))


@query("share_of_group_total", sql=F2 + f"""
, nat AS (SELECT geo_id, n_regionkey AS region, {E[0]} AS e
          FROM f2 JOIN nation ON geo_id = '0500000us' || CAST(n_nationkey AS VARCHAR))
SELECT geo_id, region, {O.r6('e', 'e')}, {O.r6('e / nullif(sum(e) OVER (PARTITION BY region), 0)', 'share')} FROM nat""")
def share_of_group_total(spark, sf_dir):
    """Each nation's share of its region's customers."""
    t = Tables(spark, sf_dir)
    nat = (f2_wide(t).where(F.col("geo_id").startswith(NATION))
           .join(t.nation.select(F.concat(F.lit("0500000us"), F.col("n_nationkey").cast("string")).alias("geo_id"),
                                 F.col("n_regionkey").alias("region")), "geo_id")
           .select("geo_id", "region", F.col(E[0]).alias("e")))
    return finish(shares.share_of_group_total(nat, ["region"], "e"))


# ------------------------------------------------------------- verification
@query("one_row_guard", sql=F2U + f"""
, k AS (SELECT geo_id, {SPLIT.format(1)} AS base, {SPLIT.format(2)} AS type, {SPLIT.format(3)} AS num, count(*) AS n
        FROM f2_unpivot GROUP BY ALL)
SELECT CAST(count(*) AS BIGINT) AS n_keys, CAST(count_if(n > 1) AS BIGINT) AS n_duplicate_keys,
       CAST(max(n) AS BIGINT) AS max_rows_per_key FROM k""")
def one_row_guard(spark, sf_dir):
    """Uniqueness of (geography, base, type, number) before the estimate/margin pivot."""
    long_df = reshape.split_code(reshape.unpivot_wide(_wide(spark, sf_dir)))
    return verify.one_row_guard(long_df, ["geo_id", "base", "type", "num"])


@query("subtotal_consistency", sql=F2 + f"""
SELECT geo_id, {O.r6(' + '.join(E[1:]), 'parts')}, {O.r6(E[0], 'whole')},
       abs(({' + '.join(E[1:])}) - {E[0]}) < 1e-9 AS consistent FROM f2""")
def subtotal_consistency(spark, sf_dir):
    """Whether the segment counts add up to the total in every geography."""
    return finish(verify.subtotal_consistency(_wide(spark, sf_dir), ["geo_id"], E[1:], E[0]))
