"""F1-F8: the analyses' input shapes, derived from the driver tables.

The reference's own inputs (survey extracts, title lists, precinct files) are
absent, so each input shape is rebuilt from the driver tables (FIXTURES.md §2).
Every builder is a lazy DataFrame over the parquet tables; its cost grows with
the tables. The same definitions are restated in SQL for the oracle
(``inkwell.plans.oracle_fixtures``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.numeric import decade
from inkwell.functions.text import recode, title_strip_year, title_year, trim_all
from inkwell.session import stored_once
from inkwell.sources.geojson import feature_text
from inkwell.sources.io import literal_table
from inkwell.sources.tables import Tables

# The five market segments of the driver tables, in code order.
# Segment k (1-based) is variable number k + 1; number 001 is the universe.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
COMMON_NAMES = ["total"] + [s.lower() for s in SEGMENTS]

F1_BASE = "b90002"     # long yearly extract (F1)
F2_BASE = "b90001"     # wide survey table (F2)
F2_TRAP = "b90001e"    # second base ending in "e": the code-split trap
F1_YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]

# Three code vintages (first year, last year, codes in
# COMMON_NAMES order). The same code means different groups in different
# vintages (B02015_002 and B02015_007), as in the survey's 2015/2022 change.
VINTAGES = [
    ("v1", 1995, 1997, ["B01003_001", "B02006_002", "B02006_005", "B02006_010", "B02006_011", "B02006_012"]),
    ("v2", 1998, 1999, ["B01003_001", "B02015_002", "B02015_007", "B02015_012", "B02015_013", "B02015_014"]),
    ("v3", 2000, 2001, ["B01003_001", "B02015_021", "B02015_002", "B02015_005", "B02015_006", "B02015_007"]),
]

# State-name corrections of the title list (trimmed value -> fix).
STATE_FIXES = {
    "Flordia": "Florida",
    "District of Colombia": "District of Columbia",
    "West Virgina": "West Virginia",
    "New Mexco": "New Mexico",
    "Illlinois": "Illinois",
    "Lousiana": "Louisiana",
    "Oho": "Ohio",
    "Kanasa": "Kansas",
}
# F3 misspells a brand "Brand#n" as "Brnad#n"; its corrections follow by rule.
F3_FIXES = {**STATE_FIXES, **{f"Brnad#{i}": f"Brand#{i}" for i in range(1, 100)}}

# F5 candidates: return flag A votes for the first-listed, R for the second.
CANDIDATES = ("Gonzalez", "Higgins")


def _num(i: int) -> str:
    return f"{i:03d}"


def segment_number(seg: Column) -> Column:
    """'AUTOMOBILE' -> '002' ... 'MACHINERY' -> '006'; an unknown segment is an error."""
    m = F.create_map(*[x for i, s in enumerate(SEGMENTS) for x in (F.lit(s), F.lit(_num(i + 2)))])
    return F.coalesce(F.try_element_at(m, seg), F.raise_error(
        F.concat(F.lit("unknown segment "), F.coalesce(seg, F.lit("null")))).cast("string"))


def in_years(date: Column, years: Sequence[int]) -> Column:
    """``date`` in one of the years, as ranges that reach the Parquet reader."""
    runs: list[list[int]] = []
    for y in sorted(set(years)):
        if runs and y == runs[-1][1] + 1:
            runs[-1][1] = y
        else:
            runs.append([y, y])
    stamp = lambda y: F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz")
    return reduce(lambda a, b: a | b, [(date >= stamp(a)) & (date < stamp(b + 1)) for a, b in runs])


def listed_year(year: Column) -> Column:
    """``year`` if a vintage lists it; any other year (or none) is an error, never a dropped row."""
    return F.when(year.isin(F1_YEARS), year).otherwise(F.raise_error(F.concat(
        F.lit("order year in no vintage: "), F.coalesce(year.cast("string"), F.lit("none")))).cast("int"))


# ---------------------------------------------------------------- F1
def yearly_fact(t: Tables) -> DataFrame:
    """The whole yearly extract on disk, a folder a year: built once from ``orders``, ``customer`` and
    ``nation`` and read by every trend job, so a filter on years reads only those folders and one on
    geographies or variables reaches the Parquet reader. Large years are split over files."""
    sources = [f"{t.sf_dir}/{name}.parquet" for name in ("orders", "customer", "nation")]
    return stored_once(t.spark, "yearly-extract", sources, lambda: f1_long(t).hint("rebalance", "year"), ["year"])


def yearly_extract(t: Tables, years: Sequence[int] | None = None, geos: Sequence[int] | None = None,
                   variables: Sequence[str] | None = None) -> DataFrame:
    """The stored extract for some years, geographies and variables; unknown ones are an error."""
    check_asked(years, variables)
    df = yearly_fact(t)
    for column, values in (("year", years), ("geo", geos), ("variable", variables)):
        if values is not None:
            df = df.where(F.col(column).isin(list(values)))
    return df


def check_asked(years: Sequence[int] | None, variables: Sequence[str] | None) -> None:
    unknown = set(years or ()) - set(F1_YEARS) | set(variables or ()) - {f1_variable(c) for c in COMMON_NAMES}
    if unknown:
        raise ValueError(f"not in the yearly extract: {sorted(map(str, unknown))}")


def f1_long(t: Tables, years: Sequence[int] | None = None, geos: Sequence[int] | None = None,
            variables: Sequence[str] | None = None) -> DataFrame:
    """Yearly extract, long: geo, parent, year, variable, estimate, moe.

    ``years``, ``geos`` and ``variables`` restrict the extract before the
    cube is built: years become date ranges on ``orders``, geographies (and
    segments, unless the universe is asked for) filters on ``customer``. A
    year outside ``F1_YEARS`` or an unknown variable is an error.

    estimate = orders of the geography's customers in the segment and year,
    moe = distinct ordering customers. Orders are pre-aggregated to one row per
    (customer, year) before the join, so the join shuffles at most customers x
    years rows, a hot customer collapses map-side, and "distinct customers" is
    a plain count (a customer has one segment).
    """
    check_asked(years, variables)
    orders, customer = t.orders, t.customer
    if years is not None:
        orders = orders.where(in_years(F.col("o_orderdate"), years))
    if geos is not None:
        customer = customer.where(F.col("c_nationkey").isin(list(geos)))
    if variables is not None and f1_variable("total") not in variables:
        customer = customer.where(F.col("c_mktsegment").isin([s for s in SEGMENTS if f1_variable(s.lower()) in variables]))
    per_cust = (orders
                .groupBy(F.col("o_custkey"), listed_year(F.year("o_orderdate")).alias("year"))
                .agg(F.count(F.lit(1)).alias("n")))
    cust = customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    nat = t.nation.select("n_nationkey", "n_regionkey")
    seg = (per_cust.join(cust, per_cust.o_custkey == cust.c_custkey)
           .join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
           .groupBy(F.col("n_nationkey").alias("geo"), F.col("n_regionkey").alias("parent"),
                    "year", "c_mktsegment")
           .agg(F.sum("n").cast("double").alias("estimate"),
                F.count(F.lit(1)).cast("double").alias("moe"))
           .select("geo", "parent", "year",
                   F.concat(F.lit(F1_BASE + "_"), segment_number(F.col("c_mktsegment"))).alias("variable"),
                   "estimate", "moe"))
    universe = (seg.groupBy("geo", "parent", "year")
                .agg(F.sum("estimate").alias("estimate"), F.sum("moe").alias("moe"))
                .select("geo", "parent", "year", F.lit(F1_BASE + "_001").alias("variable"),
                        "estimate", "moe"))
    if variables is None:
        return seg.unionByName(universe)
    if f1_variable("total") not in variables:
        return seg
    if set(variables) == {f1_variable("total")}:
        return universe
    return seg.where(F.col("variable").isin(list(variables))).unionByName(universe)


def f1_variable(common: str) -> str:
    return f"{F1_BASE}_{_num(COMMON_NAMES.index(common) + 1)}"


def f1_wide(long_df: DataFrame, vintage: str) -> DataFrame:
    """One vintage of the yearly extract in wide API form: ``<code>E``/``<code>M``."""
    _, y0, y1, codes = next(v for v in VINTAGES if v[0] == vintage)
    aggs = []
    for common, code in zip(COMMON_NAMES, codes):
        hit = F.col("variable") == f1_variable(common)
        aggs += [F.max(F.when(hit, F.col("estimate"))).alias(code + "E"),
                 F.max(F.when(hit, F.col("moe"))).alias(code + "M")]
    return (long_df.where(F.col("year").between(y0, y1))
            .groupBy("geo", "parent", "year").agg(*aggs))


def f1_catalogue(long_df: DataFrame) -> DataFrame:
    """Variable catalogue per year (name, label, year); labels are reworded in 1998."""
    seg_label = F.when(F.col("name") == F1_BASE + "_001", F.lit("Total"))
    for i, s in enumerate(SEGMENTS):
        seg_label = seg_label.when(F.col("name") == f"{F1_BASE}_{_num(i + 2)}", F.lit(s.capitalize()))
    prefix = F.when(F.col("year") < 1998, F.lit("Estimate!!")).otherwise(F.lit("Estimate!!Total:!!"))
    return (long_df.select(F.col("variable").alias("name"), "year").distinct()
            .select("name", F.concat(prefix, seg_label).alias("label"), "year"))


# ---------------------------------------------------------------- F2
def _f2_measures() -> list[tuple[str, Column]]:
    """(column, per-customer 0/1 indicator) in survey column order."""
    neg = F.col("c_acctbal") < 0
    seg = F.col("c_mktsegment")
    out = [(f"{F2_BASE}_e001", F.lit(True)), (f"{F2_BASE}_m001", neg)]
    for i, s in enumerate(SEGMENTS):
        out += [(f"{F2_BASE}_e{_num(i + 2)}", seg == s), (f"{F2_BASE}_m{_num(i + 2)}", (seg == s) & neg)]
    bal = F.col("c_acctbal")
    out += [(f"{F2_TRAP}_e001", bal >= 5000), (f"{F2_TRAP}_m001", bal >= 9000),
            (f"{F2_TRAP}_e002", bal < 5000), (f"{F2_TRAP}_m002", bal < 1000)]
    return out


def f2_columns() -> list[str]:
    return [name for name, _ in _f2_measures()]


def f2_wide(t: Tables, nations: Sequence[int] | None = None) -> DataFrame:
    """Wide survey table: one row per nation (050...) and per region (040...);
    with ``nations`` only those nations' rows, from their customers alone.

    Customers are counted once per nation (partial aggregation map-side; the
    shuffle carries at most one row per nation per task); regions are sums of
    their nations, so the customer table is read once.
    """
    meas = _f2_measures()
    customer, nation = t.customer, t.nation
    if nations is not None:
        customer = customer.where(F.col("c_nationkey").isin(list(nations)))
        nation = nation.where(F.col("n_nationkey").isin(list(nations)))
    per_nation = (customer.groupBy("c_nationkey")
                  .agg(*[F.count_if(ind).alias(name) for name, ind in meas]))
    nat = nation.select("n_nationkey", "n_regionkey").join(
        per_nation, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    filled = [F.coalesce(F.col(name), F.lit(0)).cast("double").alias(name) for name, _ in meas]
    nation_rows = nat.select(
        F.concat(F.lit("0500000us"), F.col("n_nationkey").cast("string")).alias("geo_id"), *filled)
    if nations is not None:
        return nation_rows
    reg_sums = nat.groupBy("n_regionkey").agg(*[F.sum(name).alias(name) for name, _ in meas])
    regions = (t.region.select("r_regionkey")
               .join(reg_sums, F.col("r_regionkey") == F.col("n_regionkey"), "left")
               .select(F.concat(F.lit("0400000us"), F.col("r_regionkey").cast("string")).alias("geo_id"),
                       *filled))
    return nation_rows.unionByName(regions)


def f2_dictionary(t: Tables, as_delivered: bool = False) -> DataFrame:
    """Variable dictionary: unique_id, stub, is_leaf, line, data_release;
    ``as_delivered`` lists the segments that ``customer`` holds.

    A small fixed file in the analyses, so jobs that only
    label with it read no table."""
    if as_delivered:
        held = t.customer.select("c_mktsegment").distinct().select(
            F.concat(F.lit(F2_BASE + "_"), segment_number(F.col("c_mktsegment"))).alias("unique_id"), F.lit(True).alias("held"))
        segment = F.col("unique_id").startswith(F2_BASE + "_") & (F.col("line") > 1)
        return f2_dictionary(t).join(held, "unique_id", "left").where(~segment | F.col("held")).drop("held")
    rows = [(f"{F2_BASE}_{_num(i + 2)}", s.capitalize(), True) for i, s in enumerate(SEGMENTS)]
    rows += [(f"{F2_BASE}_001", "Total customers", False), (f"{F2_TRAP}_001", "Balance of 5000 or more", True),
             (f"{F2_TRAP}_002", "Balance under 5000", True)]
    return (literal_table(t.spark, rows, "unique_id string, stub string, is_leaf boolean")
            .withColumn("line", F.substring("unique_id", -3, 3).cast("int"))
            .withColumn("data_release", F.lit("2024")))


# ---------------------------------------------------------------- F3
def f3_raw(t: Tables) -> DataFrame:
    """Title list as delivered: title_id, title, state, rating, multiple_locations, description."""
    k = F.col("p_partkey")
    yr = (F.lit(1950) + k % 74).cast("string")
    return t.part.select(
        k.alias("title_id"),
        F.when(k % 37 == 0, F.col("p_name"))
         .otherwise(F.concat(F.col("p_name"), F.lit(" ("), yr, F.lit(")"))).alias("title"),
        F.when(k % 50 == 0, F.concat(F.regexp_replace("p_brand", "^Brand", "Brnad"), F.lit("\t")))
         .otherwise(F.col("p_brand")).alias("state"),
        F.when(k % 10 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("p_retailprice") / 100).alias("rating"),
        F.when(F.col("p_size") > 25, "yes").otherwise("no").alias("multiple_locations"),
        F.col("p_type").alias("description"))


def clean_titles(raw: DataFrame, fixes: dict[str, str] = F3_FIXES) -> DataFrame:
    """Trim and recode state, split the year off the title, add the decade."""
    year = title_year(F.col("title"))
    return (raw.select(
        "title_id",
        title_strip_year(F.col("title")).alias("title"),
        recode(trim_all(F.col("state")), fixes).alias("state"),
        "rating", "multiple_locations",
        F.col("description").alias("genre"),
        year.alias("year"))
        .withColumn("year_bin", decade(F.col("year"))))


def f3_titles(t: Tables) -> DataFrame:
    return clean_titles(f3_raw(t))


# ---------------------------------------------------------------- F4
def f4_scores(t: Tables) -> DataFrame:
    """School scores: district, school, grade, subject, year, tested, passed."""
    o = (t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("year"),
                          F.col("o_orderpriority").alias("grade"),
                          F.col("o_orderstatus").alias("subject"))
         .agg(F.count(F.lit(1)).alias("tested"),
              F.count_if(F.col("o_totalprice") > 250000).alias("passed")))
    cust = t.customer.select("c_custkey", "c_nationkey")
    nat = t.nation.select("n_nationkey", "n_regionkey")
    return (o.join(cust, F.col("o_custkey") == F.col("c_custkey"))
            .join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy(F.col("n_regionkey").alias("district"), F.col("n_nationkey").alias("school"),
                     "grade", "subject", "year")
            .agg(F.sum("tested").cast("bigint").alias("tested"),
                 F.sum("passed").cast("bigint").alias("passed")))


# ---------------------------------------------------------------- F5
def _precinct_votes(t: Tables) -> DataFrame:
    """Per precinct (part): runoff votes (quantity > 45) and first-round votes
    (status F) for both candidates, from ONE partial aggregation of lineitem.
    Every F5 view projects this same subtree, so Spark shuffles lineitem once
    and reuses that exchange."""
    flag, qty, status = F.col("l_returnflag"), F.col("l_quantity"), F.col("l_linestatus")
    votes = (t.lineitem.groupBy("l_partkey").agg(
        F.count_if((qty > 45) & (flag == "A")).alias("a"),
        F.count_if((qty > 45) & (flag == "R")).alias("r"),
        F.count_if((status == "F") & (flag == "A")).alias("fa"),
        F.count_if((status == "F") & (flag == "R")).alias("fr")))
    v = t.part.select("p_partkey").join(votes, F.col("p_partkey") == F.col("l_partkey"), "left")
    return v.select(F.col("p_partkey").alias("precinct_geo"),
                    *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("a", "r", "fa", "fr")])


def precinct_votes(t: Tables) -> DataFrame:
    return _precinct_votes(t)


def f5_runoff(t: Tables, votes: DataFrame | None = None, first_round: bool = False) -> DataFrame:
    """Runoff results as delivered (strings): precinct_geo, gonzalez, higgins, precinct_total, and
    with ``first_round`` the first-round leader ``winner`` of the same vote row.

    Shares are percents with one decimal; a precinct without votes carries the
    text ``NaN``, as a failed number parse would."""
    a, r = F.col("a"), F.col("r")
    total = a + r

    def share(x):
        return F.when(total > 0, F.bround(x * 100.0 / total, 1).cast("string")).otherwise(F.lit("NaN"))

    votes = _precinct_votes(t) if votes is None else votes
    return votes.select("precinct_geo", share(a).alias("gonzalez"), share(r).alias("higgins"),
                        total.cast("string").alias("precinct_total"), *([first_leader().alias("winner")] if first_round else []))


def first_leader() -> Column:
    """First-round leader of a vote row; '?' if none."""
    a, r = F.col("fa"), F.col("fr")
    return F.when(a > r, CANDIDATES[0]).when(r > a, CANDIDATES[1]).otherwise("?")


def f5_first_round(t: Tables, votes: DataFrame | None = None) -> DataFrame:
    """First-round leader per precinct (status F lines, no quantity filter); '?' if none."""
    votes = _precinct_votes(t) if votes is None else votes
    return votes.select("precinct_geo", first_leader().alias("winner"))


def f5_demographics(t: Tables) -> DataFrame:
    """race (lower-case group) and immigrant_prop (percent text); '?' when unknown."""
    k = F.col("p_partkey")
    unknown = k % 23 == 0
    return t.part.select(k.alias("precinct_geo"),
                         F.when(unknown, "?").otherwise(F.lower("p_type")).alias("race"),
                         F.when(unknown, "?").otherwise(F.col("p_size").cast("string")).alias("immigrant_prop"))


# ---------------------------------------------------------------- F6
def f6_readings(t: Tables) -> DataFrame:
    """Noise readings: site, reading, ts, zone."""
    return t.events.select(F.col("user_id").alias("site"), F.col("value").alias("reading"),
                           "ts", F.col("event_type").alias("zone"))


# ---------------------------------------------------------------- F7
def f7_rows(t: Tables) -> DataFrame:
    """Rows to classify. No join here: the whole texts stay in their scan
    splits; gold labels (``f7_labels``) are joined to the classifier's
    small output where a job needs them."""
    return t.documents.select("doc_id", "text", "lang", "source", "n_chars")


def f7_labels(t: Tables) -> DataFrame:
    """Gold inputs for some rows: doc_id, quality, toxic."""
    return t.labels.select("doc_id", "quality", "toxic")


# ---------------------------------------------------------------- F8
F8_CELL = 5.0          # rectangle width and height
F8_COLS, F8_ROWS = 6, 100
# An L-shaped ring (closed implicitly) overlapping the rectangles.
F8_L_RING = [(2.0, 2.0), (12.0, 2.0), (12.0, 7.0), (7.0, 7.0), (7.0, 22.0), (2.0, 22.0)]


def f8_points(t: Tables) -> DataFrame:
    """Points from events: x = day of month + hour/24, y = value."""
    return t.events.select(F.col("event_id").alias("point_id"),
                           (F.dayofmonth("ts") + F.hour("ts") / 24.0).alias("x"),
                           F.col("value").alias("y"))


def f8_rectangles(spark) -> DataFrame:
    """600 rectangles over [0,30) x [0,500) as 4-vertex rings."""
    ids = spark.range(F8_COLS * F8_ROWS).select(F.col("id").alias("area_id"))
    x0 = (F.floor(F.col("area_id") / F8_ROWS) * F8_CELL).cast("double")
    y0 = ((F.col("area_id") % F8_ROWS) * F8_CELL).cast("double")
    x1, y1 = x0 + F8_CELL, y0 + F8_CELL

    def pt(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    return ids.select("area_id", F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1)).alias("ring"))


def f8_l_ring(spark) -> DataFrame:
    ring = [{"x": x, "y": y} for x, y in F8_L_RING]
    return literal_table(spark, [(100000, ring)], "area_id long, ring array<struct<x:double,y:double>>")


# Side of a precinct square and of the grid that it stands in.
F9_SIDE, F9_STEP, F9_COLS = 3.0, 4.0, 1000


def _square(x0: Column, y0: Column, side: float | Column, high: float | Column | None = None) -> Column:
    """A closed rectangular ring."""
    x1, y1 = x0 + side, y0 + (side if high is None else high)
    return F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
                     for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])


def f9_polygons(k: Column) -> Column:
    """The shape of a precinct: a square, some with a hole or a second part."""
    x0, y0 = k % F9_COLS * F9_STEP, F.floor(k / F9_COLS) * F9_STEP
    outline = _square(x0, y0, F9_SIDE)
    return (F.when(k % 5 == 1, F.array(F.array(outline, _square(x0 + 1, y0 + 1, 1.0))))
            .when(k % 5 == 2, F.array(F.array(outline), F.array(_square(x0 + 3.25, y0, 0.5))))
            .otherwise(F.array(F.array(outline))))


def f9_features(t: Tables) -> DataFrame:
    """Precinct features as delivered, one JSON text a precinct; some have no geometry, an open ring or
    are cut short."""
    k, whole = F.col("precinct_geo"), f9_polygons(F.col("precinct_geo"))
    opened = F.transform(whole, lambda p: F.transform(p, lambda r: F.slice(r, 1, 4)))
    rows = f5_demographics(t).withColumn("polygons", F.when(k % 50 == 20, opened).when(k % 50 != 10, whole))
    text = feature_text(F.struct("precinct_geo", "race", "immigrant_prop"), F.col("polygons"))
    return rows.select(F.when(k % 50 == 30, F.substring(text, 1, 60)).otherwise(text).alias("value"))


# Sides of a district, which cut through precincts.
F9_DISTRICT = (10.0, 7.0)


def f9_precincts(t: Tables) -> DataFrame:
    """Precinct shapes with their votes: precinct_geo, polygons, votes_a, votes_total."""
    return f5_vote_counts(t).withColumn("polygons", f9_polygons(F.col("precinct_geo")))


def f9_districts(precincts: DataFrame) -> DataFrame:
    """The districts that precincts lie in, as polygons of one grid: district = 100000 * column + row."""
    wide, high = F9_DISTRICT
    points = precincts.select(F.explode(F.flatten(F.flatten("polygons"))).alias("p"))
    grid = points.select(F.floor(F.col("p.x") / wide).alias("i"), F.floor(F.col("p.y") / high).alias("j")).distinct()
    return grid.select((F.col("i") * 100_000 + F.col("j")).alias("district"),
                       F.array(F.array(_square(F.col("i") * wide, F.col("j") * high, wide, high))).alias("polygons"))


# Steps of the long staircase ring and their height (exact in binary).
F10_STEPS, F10_RISE = 4000, 0.125


def f10_areas(t: Tables) -> DataFrame:
    """Areas with holes and several parts, one a nation, and a staircase ring of 8,002 positions."""
    k = F.col("n_nationkey")
    x0, y0 = 1 + k % 5 * 6, F.floor(k / 5) * 100
    first = F.when(k % 2 == 0, F.array(_square(x0, y0, 5.5, 90.0), _square(x0 + 1, y0 + 20, 2.0, 40.0))).otherwise(
        F.array(_square(x0, y0, 5.5, 90.0)))
    areas = t.nation.select(k.cast("long").alias("area_id"), F.when(k % 3 == 0, F.array(
        first, F.array(_square(x0 + 5.625, y0, 0.25, 95.0)))).otherwise(F.array(first)).alias("polygons"))

    def corner(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    stairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(F10_STEPS - 1)), lambda j: F.array(
        corner(2 + j % 100 * 0.25, j * F10_RISE), corner(2 + j % 100 * 0.25, (j + 1) * F10_RISE))))
    zero = F.lit(1.0)
    ring = F.concat(F.array(corner(zero, F.lit(0))), stairs, F.array(corner(zero, F.lit(F10_STEPS * F10_RISE)), corner(zero, F.lit(0))))
    long_ring = t.spark.range(1).select(F.lit(1000).cast("long").alias("area_id"), F.array(F.array(ring)).alias("polygons"))
    return areas.unionByName(long_ring)


def f5_vote_counts(t: Tables) -> DataFrame:
    """Runoff vote counts per precinct: precinct_geo, votes_a, votes_total (A + R)."""
    return _precinct_votes(t).select("precinct_geo", F.col("a").cast("bigint").alias("votes_a"),
                                     (F.col("a") + F.col("r")).cast("bigint").alias("votes_total"))
