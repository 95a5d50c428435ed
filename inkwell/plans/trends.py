"""Yearly-extract jobs on F1: trend tables, vintages, totals, bins, fact checks
(SURVEY §2.1, §2.3-2.6, §2.10, §2.12)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.bins import choropleth_bin
from inkwell.functions.numeric import percent_round as pct_round, safe_div
from inkwell.operators import reshape, shares, verify
from inkwell.plans import oracle_fixtures as O
from inkwell.plans.registry import finish, query
from inkwell.sources import io
from inkwell.sources.fixtures import COMMON_NAMES, F1_YEARS, VINTAGES, f1_catalogue, f1_variable, f1_wide, yearly_extract
from inkwell.sources.tables import Tables

GROUPS = COMMON_NAMES[1:]            # automobile ... machinery
UNI = f1_variable("total")
CAT_YEAR = 1999
FIRST, LAST = F1_YEARS[0], F1_YEARS[-1]
r6 = O.r6


def _long(spark, sf_dir, **only) -> DataFrame:
    """F1 long from the stored yearly extract. ``only``: years, geos, variables."""
    return yearly_extract(Tables(spark, sf_dir), **only)


def _harm(spark, sf_dir, **only) -> DataFrame:
    long_df = _long(spark, sf_dir, **only)
    frames = {v: f1_wide(long_df, v) for v, *_ in VINTAGES}
    codes = {v: c for v, _, _, c in VINTAGES}
    return reshape.vintage_harmonize(frames, codes, COMMON_NAMES)


def _yearly(spark, sf_dir, **only) -> DataFrame:
    return shares.yearly_totals(_harm(spark, sf_dir, **only), ["parent", "year"], GROUPS, "total")


L = O.with_(O.f1_long())
LC = O.with_(O.f1_long(), O.f1_catalogue())
H = O.with_(O.f1_all())
YT_CTE = ",\nyt AS (SELECT parent, year, " + ", ".join(
    f"CASE WHEN count(*) = count({c}) THEN sum({c}) END AS {c}" for c in COMMON_NAMES) + \
    " FROM f1_harm GROUP BY parent, year)\n"
YT = H.rstrip() + YT_CTE
YT_PCT = ", ".join(f"{g} / nullif(total, 0) AS {g}_percent" for g in GROUPS)


def _cols(names):
    return ", ".join(r6(n, n) for n in names)


# ------------------------------------------------------------- scans
SCAN_VARS = [UNI, f1_variable("automobile"), f1_variable("furniture")]
SCAN_YEARS = [y for y in F1_YEARS if y != 1998]      # one year skipped, as the source skips 2020


@query("scan_vintages_long", sql=L + f"""
SELECT geo, parent, year, variable, {_cols(['estimate', 'moe'])} FROM f1_long
WHERE year IN ({', '.join(map(str, SCAN_YEARS))}) AND variable IN ('{"', '".join(SCAN_VARS)}')""")
def scan_vintages_long(spark, sf_dir):
    """Yearly extract restricted to listed years (one skipped) and variables."""
    df = _long(spark, sf_dir, years=SCAN_YEARS, variables=SCAN_VARS)
    return finish(df.select("geo", "parent", "year", "variable", "estimate", "moe"))


V3_CODES = next(c for v, _, _, c in VINTAGES if v == "v3")
V3_COLS = [c + s for c in V3_CODES for s in ("E", "M")]


@query("scan_vintages_wide", sql=H + "SELECT geo, parent, year, " +
       ", ".join(f'round("{c}", 6) + 0.0 AS "{c}"' for c in V3_COLS) + " FROM f1_v3")
def scan_vintages_wide(spark, sf_dir):
    """The last vintage of the yearly extract in wide code form."""
    return finish(f1_wide(_long(spark, sf_dir), "v3"))


@query("scan_catalogue_by_year", sql=LC + "SELECT name, label, year FROM f1_catalogue")
def scan_catalogue_by_year(spark, sf_dir):
    """Per-year catalogues stacked with their year: the catalogue has it as a column."""
    return f1_catalogue(_long(spark, sf_dir)).select("name", "label", "year")


# ------------------------------------------------------------- pivots and trend tables
def _pivot_sql(years, prefix="x", src="f1_long", keys="geo, variable"):
    cols = ", ".join(r6(f"max(CASE WHEN year = {y} THEN estimate END)", f"{prefix}{y}") for y in years)
    return f"SELECT {keys}, {cols} FROM {src} GROUP BY {keys}"


@query("pivot_years", sql=L + _pivot_sql(F1_YEARS))
def pivot_years(spark, sf_dir):
    """Yearly estimates pivoted to one column per year."""
    return finish(reshape.pivot_years(_long(spark, sf_dir), ["geo", "variable"], F1_YEARS))


@query("normalize_names_values", sql=L + _pivot_sql(F1_YEARS, keys="geo, variable").replace(
    "SELECT geo, variable,", "SELECT geo, lower(variable) AS variable,"))
def normalize_names_values(spark, sf_dir):
    """Raw year names ('1995') and upper-case codes -> x1995 and lower case."""
    raw = (_long(spark, sf_dir).select(F.col("geo").alias("Geo"), F.upper("variable").alias("VARIABLE"),
                                       "year", "estimate"))
    wide = reshape.pivot_years(raw, ["Geo", "VARIABLE"], F1_YEARS, prefix="")
    return finish(io.normalize_names_values(wide))


@query("left_join_catalogue", sql=LC + f"""
SELECT l.geo, l.year, l.variable, {r6('l.estimate', 'estimate')}, c.label
FROM f1_long l LEFT JOIN f1_catalogue c ON c.name = l.variable AND c.year = {CAT_YEAR}""")
def left_join_catalogue(spark, sf_dir):
    """Yearly extract labelled from one catalogue year."""
    long_df = _long(spark, sf_dir)
    df = reshape.left_join_catalogue(long_df.select("geo", "year", "variable", "estimate"),
                                     f1_catalogue(long_df), CAT_YEAR)
    return finish(df)


@query("catalogue_interval_join", sql=LC + f"""
SELECT l.geo, l.year, l.variable, {r6('l.estimate', 'estimate')}, c.label, n.label AS label_now, c.label <> n.label AS reworded
FROM f1_long l LEFT JOIN f1_catalogue c ON c.name = l.variable AND c.year = l.year
LEFT JOIN f1_catalogue n ON n.name = l.variable AND n.year = {LAST}""")
def catalogue_interval_join(spark, sf_dir):
    """Yearly extract with the label that held in each row's year and the newest one, from label intervals."""
    long_df = _long(spark, sf_dir)
    spans = reshape.label_intervals(f1_catalogue(long_df))
    df = reshape.join_label_intervals(long_df.select("geo", "year", "variable", "estimate"), spans)
    return finish(df.withColumn("reworded", F.col("label") != F.col("label_now")))


OLD_YEARS = F1_YEARS[:-1]


@query("left_join_new_vintage", sql=L + f"""
, w AS ({_pivot_sql(OLD_YEARS, src=f'(SELECT * FROM f1_long WHERE year < {LAST})')})
SELECT w.*, {r6('n.estimate', f'x{LAST}')} FROM w
LEFT JOIN f1_long n ON n.geo = w.geo AND n.variable = w.variable AND n.year = {LAST}""")
def left_join_new_vintage(spark, sf_dir):
    """Year pivot of the older years with the newest year joined from a separate extract."""
    long_df = _long(spark, sf_dir)
    wide = reshape.pivot_years(long_df.where(F.col("year") < LAST), ["geo", "variable"], OLD_YEARS)
    newest = long_df.where(F.col("year") == LAST)
    return finish(reshape.left_join_new_vintage(wide, newest, ["geo", "variable"], "estimate", f"x{LAST}"))


_TREND_X = [f"x{y}" for y in F1_YEARS]


@query("trend_table", sql=LC + f"""
, w AS (SELECT l.geo, l.variable, c.label, {', '.join(f'max(CASE WHEN l.year = {y} THEN l.estimate END) AS x{y}' for y in OLD_YEARS)}
        FROM (SELECT * FROM f1_long WHERE year < {LAST}) l
        LEFT JOIN f1_catalogue c ON c.name = l.variable AND c.year = {CAT_YEAR}
        GROUP BY l.geo, l.variable, c.label),
t AS (SELECT w.*, n.estimate AS x{LAST} FROM w
      LEFT JOIN f1_long n ON n.geo = w.geo AND n.variable = w.variable AND n.year = {LAST})
SELECT geo, variable, label, {_cols(_TREND_X)},
       {', '.join(r6(f'{x} / nullif(first_value({x}) OVER (PARTITION BY geo ORDER BY variable ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0)', x + '_scaled') for x in _TREND_X)}
FROM t""")
def trend_table(spark, sf_dir):
    """Labelled year pivot with the newest year joined in and every year indexed to the universe row."""
    long_df = _long(spark, sf_dir)
    old = long_df.where(F.col("year") < LAST)
    newest = long_df.where(F.col("year") == LAST).select("geo", "variable", "estimate")
    return finish(reshape.trend_table(old, f1_catalogue(long_df), CAT_YEAR, OLD_YEARS, newest, LAST))


@query("index_to_first", sql=L + f"""
SELECT geo, year, variable, {r6('estimate', 'estimate')},
       {r6('estimate / nullif(first_value(estimate) OVER (PARTITION BY geo, year ORDER BY variable ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0)', 'estimate_scaled')}
FROM f1_long""")
def index_to_first(spark, sf_dir):
    """Each variable's estimate divided by the universe row of its geography and year."""
    df = _long(spark, sf_dir).select("geo", "year", "variable", "estimate")
    return finish(reshape.index_to_first(df, ["geo", "year"], ["variable"], ["estimate"]))


# Fixed band map: band_a is not contiguous (rows 2, 3 and 6).
BANDS = {f1_variable("automobile"): "band_a", f1_variable("building"): "band_a",
         f1_variable("machinery"): "band_a", f1_variable("furniture"): "band_b",
         f1_variable("household"): "band_b"}


@query("band_totals", sql=L + f"""
, s AS (SELECT geo, year, variable, estimate,
        estimate / nullif(max(CASE WHEN variable = '{UNI}' THEN estimate END) OVER (PARTITION BY geo, year), 0) AS estimate_scaled
        FROM f1_long),
b(variable, band) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in BANDS.items())})
SELECT geo, year, band, {r6('sum(estimate)', 'estimate')}, {r6('sum(estimate_scaled)', 'estimate_scaled')}
FROM s JOIN b USING (variable) GROUP BY geo, year, band""")
def band_totals(spark, sf_dir):
    """Segments folded into named bands (one band non-contiguous), estimates and indexed shares summed per geography and year."""
    long_df = _long(spark, sf_dir).select("geo", "year", "variable", "estimate")
    scaled = reshape.index_to_first(long_df, ["geo", "year"], ["variable"], ["estimate"])
    band_map = io.literal_table(spark, BANDS.items(), "variable string, band string")
    return finish(shares.band_totals(scaled, band_map, ["geo", "year"], ["estimate", "estimate_scaled"]))


# ------------------------------------------------------------- vintages and unions
HARM_COLS = [c for n in COMMON_NAMES for c in (n, n + "_margin")]


@query("vintage_harmonize", sql=H + f"SELECT geo, parent, year, {_cols(HARM_COLS)} FROM f1_harm")
def vintage_harmonize(spark, sf_dir):
    """Three code vintages renamed to common group names and stacked."""
    return finish(_harm(spark, sf_dir))


@query("union_vintages", sql=H + """
SELECT * FROM (SELECT * FROM f1_v1 UNION ALL BY NAME SELECT * FROM f1_v2 UNION ALL BY NAME SELECT * FROM f1_v3)""")
def union_vintages(spark, sf_dir):
    """The three vintage frames stacked by name; missing code columns become null."""
    long_df = _long(spark, sf_dir)
    return finish(reshape.union_vintages([f1_wide(long_df, v) for v, *_ in VINTAGES]))


@query("add_partition_literal", sql=H + " UNION ALL ".join(
    f"SELECT geo, year, {r6(chr(34) + 'B01003_001E' + chr(34), 'total')}, '{v}' AS vintage FROM f1_{v}"
    for v, *_ in VINTAGES))
def add_partition_literal(spark, sf_dir):
    """Each vintage frame with its vintage name as a literal column, stacked."""
    long_df = _long(spark, sf_dir)
    frames = [reshape.add_partition_literal(
        f1_wide(long_df, v).select("geo", "year", F.col("B01003_001E").alias("total")), "vintage", v)
        for v, *_ in VINTAGES]
    return finish(reshape.union_vintages(frames))


@query("union_tagged", sql=L + f"""
SELECT geo, year, variable, {r6('estimate', 'value')}, 'estimate' AS source FROM f1_long
UNION ALL SELECT geo, year, variable, {r6('moe', 'value')}, 'margin' AS source FROM f1_long""")
def union_tagged(spark, sf_dir):
    """Estimates and margins stacked with a source-name column."""
    long_df = _long(spark, sf_dir)
    frames = {"estimate": long_df.select("geo", "year", "variable", F.col("estimate").alias("value")),
              "margin": long_df.select("geo", "year", "variable", F.col("moe").alias("value"))}
    return finish(reshape.union_tagged(frames))


# ------------------------------------------------------------- totals and shares
YT_OUT = COMMON_NAMES + [g + "_percent" for g in GROUPS]


@query("yearly_totals", sql=YT + f", p AS (SELECT *, {YT_PCT} FROM yt) SELECT parent, year, {_cols(YT_OUT)} FROM p")
def yearly_totals(spark, sf_dir):
    """Nations summed to regions per year (strict sum) with group shares."""
    return finish(_yearly(spark, sf_dir))


@query("percent_columns", sql=H + f"""
SELECT geo, year, {_cols([g + '_percent' for g in GROUPS])} FROM (SELECT geo, year, {YT_PCT} FROM f1_harm)""")
def percent_columns(spark, sf_dir):
    """Group shares of the total per nation and year."""
    df = shares.percent_columns(_harm(spark, sf_dir), GROUPS, "total")
    return finish(df.select("geo", "year", *[g + "_percent" for g in GROUPS]))


@query("percent_round", sql=YT + f"""
SELECT parent, year, {', '.join(f'round_even({g} / nullif(total, 0) * 100, 1) + 0.0 AS {g}_pct' for g in GROUPS)} FROM yt""")
def percent_round(spark, sf_dir):
    """Region group shares as percents rounded half-even to one digit."""
    df = _yearly(spark, sf_dir)
    return finish(df.select("parent", "year", *[pct_round(g + "_percent", 1).alias(g + "_pct") for g in GROUPS]))


BAND_GROUPS = ["automobile", "building", "furniture"]


@query("margin_bounds", sql=H + "SELECT geo, year, " + ", ".join(
    f"{r6(f'{g} - {g}_margin', g + '_lower')}, {r6(f'{g} + {g}_margin', g + '_upper')}" for g in BAND_GROUPS)
    + " FROM f1_harm")
def margin_bounds(spark, sf_dir):
    """Estimate minus and plus margin for three groups per nation and year."""
    df = shares.margin_bounds(_harm(spark, sf_dir), BAND_GROUPS)
    return finish(df.select("geo", "year", *[c for g in BAND_GROUPS for c in (g + "_lower", g + "_upper")]))


MARGIN_OUT = [c for g in BAND_GROUPS for c in (g, g + "_margin", g + "_percent", g + "_percent_margin")]


@query("yearly_total_margins", sql=H.rstrip() + f""",
s AS (SELECT parent, year, {', '.join(f"CASE WHEN count(*) = count({c}) THEN sum({c}) END AS {c}, sqrt(CASE WHEN count(*) = count({c}_margin) THEN sum({c}_margin * {c}_margin) END) AS {c}_margin" for c in ['total', *BAND_GROUPS])}
      FROM f1_harm GROUP BY parent, year),
p AS (SELECT *, {', '.join(f"{g} / nullif(total, 0) AS {g}_percent" for g in BAND_GROUPS)} FROM s),
u AS (SELECT *, {', '.join(f"{g}_margin * {g}_margin - {g}_percent * {g}_percent * total_margin * total_margin AS {g}_under" for g in BAND_GROUPS)} FROM p),
q AS (SELECT *, {', '.join(f"sqrt(CASE WHEN {g}_under < 0 THEN {g}_margin * {g}_margin + {g}_percent * {g}_percent * total_margin * total_margin ELSE {g}_under END) / nullif(total, 0) AS {g}_percent_margin" for g in BAND_GROUPS)} FROM u)
SELECT parent, year, {_cols(MARGIN_OUT)} FROM q""")
def yearly_total_margins(spark, sf_dir):
    """Region totals and shares of three groups with the margins of sums and ratios."""
    df = shares.total_margins(_harm(spark, sf_dir), ["parent", "year"], BAND_GROUPS, "total")
    return finish(df.select("parent", "year", *MARGIN_OUT))


@query("ribbon_series", sql=H + " UNION ALL ".join(
    f"SELECT geo, year, '{g}' AS series, {r6(g, 'estimate')}, {r6(f'{g} - {g}_margin', 'lower')}, "
    f"{r6(f'{g} + {g}_margin', 'upper')} FROM f1_harm" for g in BAND_GROUPS))
def ribbon_series(spark, sf_dir):
    """Estimate with lower and upper bound per nation, year and group (error-band table)."""
    return finish(reshape.ribbon_series(_harm(spark, sf_dir), ["geo", "year"], BAND_GROUPS))


@query("unpivot_named", sql=YT + f"""
, u AS ({' UNION ALL '.join(f"SELECT parent, '{g}' AS series, {g} AS count FROM yt WHERE year = {LAST}" for g in BAND_GROUPS)})
SELECT parent, series, {r6('count', 'count')},
       CAST(row_number() OVER (PARTITION BY parent ORDER BY count DESC NULLS LAST, series) AS INTEGER) AS pos FROM u""")
def unpivot_named(spark, sf_dir):
    """Last-year region totals of three groups as (series, count), ordered descending."""
    from inkwell.operators import ranking
    last = _yearly(spark, sf_dir, years=[LAST])
    long_df = reshape.unpivot_named(last, ["parent"], BAND_GROUPS, "series", "count")
    return finish(ranking.sort_desc_share(long_df, ["parent"], "count", "series"))


@query("growth_ratio", sql=YT + f"""
SELECT parent, {', '.join(r6(f'max(CASE WHEN year = {LAST} THEN {g} END) / nullif(max(CASE WHEN year = {FIRST} THEN {g} END), 0)', g + '_growth') for g in GROUPS)}
FROM yt GROUP BY parent""")
def growth_ratio(spark, sf_dir):
    """Last-year over first-year totals per region and group."""
    df = _yearly(spark, sf_dir, years=[FIRST, LAST])
    aggs = [safe_div(F.max(F.when(F.col("year") == LAST, F.col(g))),
                     F.max(F.when(F.col("year") == FIRST, F.col(g)))).alias(g + "_growth") for g in GROUPS]
    return finish(df.groupBy("parent").agg(*aggs))


PAIRS = list(combinations(GROUPS, 2))


@query("order_flip", sql=H + f"""
, p AS (SELECT geo, {', '.join(f'max(CASE WHEN year = {y} THEN {g} / nullif(total, 0) END) AS {g}_{y}' for g in GROUPS for y in (FIRST, LAST))}
        FROM f1_harm GROUP BY geo),
s AS ({' UNION ALL '.join(f"SELECT geo, '{a}' AS group_a, '{b}' AS group_b, CAST(sign({a}_{FIRST} - {b}_{FIRST}) AS INTEGER) AS sign_first, CAST(sign({a}_{LAST} - {b}_{LAST}) AS INTEGER) AS sign_last FROM p" for a, b in PAIRS)})
SELECT *, sign_first * sign_last < 0 AS flipped FROM s""")
def order_flip(spark, sf_dir):
    """Pairs of groups whose order reversed between the first and last year."""
    harm = _harm(spark, sf_dir, years=[FIRST, LAST])
    p = harm.groupBy("geo").agg(*[F.max(F.when(F.col("year") == y, safe_div(F.col(g), F.col("total")))).alias(f"{g}_{y}")
                                  for g in GROUPS for y in (FIRST, LAST)])
    rows = F.array(*[F.struct(F.lit(a).alias("group_a"), F.lit(b).alias("group_b"),
                              F.signum(F.col(f"{a}_{FIRST}") - F.col(f"{b}_{FIRST}")).cast("int").alias("sign_first"),
                              F.signum(F.col(f"{a}_{LAST}") - F.col(f"{b}_{LAST}")).cast("int").alias("sign_last"))
                     for a, b in PAIRS])
    return (p.select("geo", F.inline(rows))
            .withColumn("flipped", (F.col("sign_first") * F.col("sign_last")) < 0))


BIN_GROUPS = ["automobile", "building"]


def _bin_sql(p):
    return (f"CASE WHEN {p} = 0 THEN '0%' WHEN {p} > 0 AND {p} < 3 THEN 'Less than 3%' "
            f"WHEN {p} >= 3 AND {p} < 5 THEN '3% to 5%' WHEN {p} >= 5 AND {p} < 10 THEN '5% to 10%' "
            f"WHEN {p} >= 10 AND {p} < 15 THEN '10% to 15%' WHEN {p} >= 15 THEN 'More than 15%' END")


@query("choropleth_bins", sql=H + f"""
, p AS (SELECT geo, {', '.join(f'round_even({g} / nullif(total, 0) * 100, 2) AS {g}_pct' for g in BIN_GROUPS)}
        FROM f1_harm WHERE year = {LAST})
SELECT geo, {', '.join(f'{g}_pct + 0.0 AS {g}_pct, {_bin_sql(g + "_pct")} AS {g}_bin' for g in BIN_GROUPS)} FROM p""")
def choropleth_bins(spark, sf_dir):
    """Two-digit percent of two groups per nation in the last year and its map class."""
    harm = _harm(spark, sf_dir, years=[LAST])
    cols = []
    for g in BIN_GROUPS:
        pct = pct_round(safe_div(F.col(g), F.col("total")), 2)
        cols += [pct.alias(g + "_pct"), choropleth_bin(pct).alias(g + "_bin")]
    return finish(harm.select("geo", *cols))


# ------------------------------------------------------------- filters and joins
@query("filter_compound", sql=H + f"SELECT geo, parent, year, {_cols(HARM_COLS)} FROM f1_harm WHERE geo = 7 AND year = 1999")
def filter_compound(spark, sf_dir):
    """Harmonized rows of one nation in one year."""
    return finish(_harm(spark, sf_dir, years=[1999], geos=[7]))


@query("filter_in_list", sql=YT + f"SELECT parent, year, {_cols(COMMON_NAMES)} FROM yt WHERE year IN ({FIRST}, {LAST})")
def filter_in_list(spark, sf_dir):
    """Region totals for the first and last year only."""
    return finish(_yearly(spark, sf_dir, years=[FIRST, LAST]).select("parent", "year", *COMMON_NAMES))


@query("semi_join_variables", sql=LC + f"""
SELECT geo, year, variable, {r6('estimate', 'estimate')} FROM f1_long
WHERE variable IN (SELECT name FROM f1_catalogue WHERE year = {CAT_YEAR} AND (label LIKE '%Automobile' OR label LIKE '%Building'))""")
def semi_join_variables(spark, sf_dir):
    """Yearly extract rows whose code is in a catalogue selection (a DataFrame, not a list)."""
    long_df = _long(spark, sf_dir)
    cat = f1_catalogue(long_df)
    wanted = cat.where((F.col("year") == CAT_YEAR) &
                       (F.col("label").endswith("Automobile") | F.col("label").endswith("Building"))
                       ).select(F.col("name").alias("variable"))
    return finish(reshape.semi_join_variables(long_df.select("geo", "year", "variable", "estimate"), wanted))


# Published-style claims about region shares (claim, metric, parent, year, value, digits).
CLAIMS = [
    ("region 0 automobile share", "automobile_percent", 0, FIRST, 20.0, 1),
    ("region 1 building share", "building_percent", 1, LAST, 19.5, 1),
    ("region 2 furniture share", "furniture_percent", 2, 1999, 20.0, 0),
    ("region 3 household share", "household_percent", 3, 1997, 21.3, 1),
    ("region 4 machinery share", "machinery_percent", 4, 2000, 19.87, 2),
]


def _claims_values():
    return ", ".join(f"('{c}', '{m}', {p}, {y}, {v}, {d})" for c, m, p, y, v, d in CLAIMS)


@query("fact_check", sql=YT + f"""
, claims(claim, metric, parent, year, value, digits) AS (VALUES {_claims_values()}),
m AS ({' UNION ALL '.join(f"SELECT parent, year, '{g}_percent' AS metric, {g} / nullif(total, 0) * 100 AS computed FROM yt" for g in GROUPS)}),
j AS (SELECT c.claim, c.metric, CAST(c.parent AS INTEGER) AS parent, CAST(c.year AS INTEGER) AS year,
             CAST(c.value AS DOUBLE) AS value, CAST(c.digits AS INTEGER) AS digits, m.computed,
             round_even(m.computed, CAST(c.digits AS INTEGER)) AS computed_rounded
      FROM claims c LEFT JOIN m ON m.parent = c.parent AND m.year = c.year AND m.metric = c.metric)
SELECT claim, metric, parent, year, value + 0.0 AS value, digits, {r6('computed', 'computed')},
       computed_rounded + 0.0 AS computed_rounded, coalesce(computed_rounded = value, false) AS pass FROM j""")
def fact_check(spark, sf_dir):
    """Published-style claims about region shares joined to the computed shares; pass on rounded equality."""
    yt = _yearly(spark, sf_dir)
    metrics = yt.select("parent", "year", F.inline(F.array(*[
        F.struct(F.lit(g + "_percent").alias("metric"), (F.col(g + "_percent") * 100.0).alias("computed"))
        for g in GROUPS])))
    claims = io.literal_table(spark, CLAIMS, "claim string, metric string, parent int, year int, value double, digits int")
    return finish(verify.fact_check(claims, metrics, ["metric", "parent", "year"]))
