"""Hand-made edge rows per operator (FIXTURES.md §3)."""

import pytest
from pyspark.sql import functions as F

from inkwell.functions import choropleth_bin, legend_class, percent_round, title_strip_year, title_year, trim_all, recode
from tests.conftest import SF_SMALL
from inkwell.operators import elections, ranking, reshape, shares, spatial, verify
from inkwell.sources.fixtures import STATE_FIXES


def test_share_of_universe_zero_and_null(spark):
    df = spark.createDataFrame([("a", 5.0, 0.0), ("b", 5.0, None), ("c", 5.0, 10.0)], "geo string, part double, uni double")
    out = {r.geo: r.prop for r in shares.share_of_universe(df, ["part"], "uni").collect()}
    assert out == {"a": None, "b": None, "c": 0.5}


def test_yearly_totals_strict_sum(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 10.0), (1, 1, None, 10.0), (2, 1, 3.0, 10.0)],
                               "parent int, year int, g double, total double")
    out = {r.parent: (r.g, r.g_percent) for r in shares.yearly_totals(df, ["parent", "year"], ["g"], "total").collect()}
    assert out[1] == (None, None)
    assert out[2] == (3.0, 0.3)


def test_choropleth_bins(spark):
    vals = [0.0, 0.00004, 0.02995, 0.03, 0.15, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.b for r in df.select(choropleth_bin(percent_round("x", 2)).alias("b")).collect()]
    assert got == ["0%", "0%", "3% to 5%", "3% to 5%", "More than 15%", None]


def test_percent_round_half_even(spark):
    df = spark.createDataFrame([(0.2485,), (0.0015,)], "x double")
    assert [r.p for r in df.select(percent_round("x", 1).alias("p")).collect()] == [24.8, 0.2]
    df2 = spark.createDataFrame([(2.5,)], "x double")
    assert df2.select(F.bround("x", 0).alias("p")).first().p == 2.0


def test_title_year_split(spark):
    df = spark.createDataFrame([("A (1956) (2023)",), ("B",), ("C (2001) x",)], "t string")
    got = [(r.title, r.year) for r in df.select(title_strip_year("t").alias("title"), title_year("t").alias("year")).collect()]
    assert got == [("A (1956)", 1956), ("B", None), ("C (2001) x", 2001)]


def test_trim_recode_category(spark):
    df = spark.createDataFrame([("\tOho\n",), (" Maryland ",), ("Flordia",)], "s string")
    got = [r.s for r in df.select(recode(trim_all("s"), STATE_FIXES).alias("s")).collect()]
    assert got == ["Ohio", "Maryland", "Florida"]


def test_decode_keeps_base_ending_in_e_and_guard_reports_duplicates(spark):
    wide = spark.createDataFrame([("g1", 1.0, 0.1, 2.0, 0.2)],
                                 "geo_id string, b1e_e001 double, b1e_m001 double, b2_e001 double, b2_m001 double")
    got = {r.var: (r.e, r.m) for r in reshape.decode_variables(wide).collect()}
    assert got == {"b1e_001": (1.0, 0.1), "b2_001": (2.0, 0.2)}
    long_df = reshape.split_code(reshape.unpivot_wide(wide.unionByName(wide)))
    guard = verify.one_row_guard(long_df, ["geo_id", "base", "type", "num"]).first()
    assert guard.n_duplicate_keys == 4 and guard.max_rows_per_key == 2


def test_index_to_first_base_zero_and_null(spark):
    df = spark.createDataFrame([("a", "001", 0.0), ("a", "002", 5.0), ("b", "001", None), ("b", "002", 5.0),
                                ("c", "001", 10.0), ("c", "002", 5.0)], "geo string, var string, x double")
    out = {(r.geo, r.var): r.x_scaled for r in reshape.index_to_first(df, ["geo"], ["var"], ["x"]).collect()}
    assert out[("a", "002")] is None and out[("b", "002")] is None and out[("c", "002")] == 0.5


def test_rank_range_past_the_end(spark):
    df = spark.createDataFrame([(f"s{i}", i) for i in range(25)], "state string, n int")
    assert ranking.rank_range(df, "n", "state", 20, 54).count() == 6


def test_slice_positions_with_gap(spark):
    df = spark.range(1, 40).select(F.col("id").cast("int").alias("ordinal"))
    assert ranking.slice_positions(df, list(range(3, 19)) + [27]).count() == 17


def test_precinct_winner_rounding_tie_and_no_votes(spark):
    raw = spark.createDataFrame([(1, "49.6", "50.4", "100"), (2, "NaN", "NaN", "0"), (3, "60", "40", "NaN")],
                                "precinct_geo int, gonzalez string, higgins string, precinct_total string")
    raw = raw.withColumns({"winner": F.lit("?"), "race": F.lit("?"), "immigrant_prop": F.lit("?")})
    out = {r.precinct_geo: r for r in elections.precinct_winner(elections.normalize_precinct_attrs(raw)).collect()}
    assert out[1].winner == "Higgins" and out[1].margin == 0          # both round to 50: second-listed wins
    assert out[2].winner is None                                        # no voters
    assert out[3].total_votes == 0.0 and out[3].winner is None          # text NaN treated as 0


def test_legend_classes(spark):
    df = spark.createDataFrame([(12.5,), (100.0,), (-1.0,), (0.0,)], "p double")
    assert [r.c for r in df.select(legend_class("p").alias("c")).collect()] == ["12.5-25", "75-100", None, "0-12.5"]


def test_gain_streak(spark):
    changes = [1.0, 2.0, 0.0, 1.0, None, 3.0]
    df = spark.createDataFrame([("u", 2000 + i, c) for i, c in enumerate(changes)], "u string, year int, change double")
    got = [r.streak for r in ranking.gain_streak(df, ["u"], "change").orderBy("year").collect()]
    assert got == [1, 2, 0, 1, 0, 1]


def test_point_in_area_corners_and_notch(spark):
    def square(x0, y0):
        return [{"x": x0, "y": y0}, {"x": x0 + 5, "y": y0}, {"x": x0 + 5, "y": y0 + 5}, {"x": x0, "y": y0 + 5}]

    ell = [{"x": x, "y": y} for x, y in [(2.0, 2.0), (12.0, 2.0), (12.0, 7.0), (7.0, 7.0), (7.0, 22.0), (2.0, 22.0)]]
    areas = spark.createDataFrame([(1, square(20.0, 0.0)), (2, ell), (3, square(0.0, 0.0))],
                                  "area_id long, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, 20.0, 0.0), (2, 25.0, 5.0), (3, 10.0, 15.0), (4, 3.0, 3.0), (5, 100.0, 100.0)],
                                "point_id long, x double, y double")
    got = {}
    for r in spatial.point_in_area_join(pts, areas, cell=5.0).collect():
        got.setdefault(r.point_id, set()).add(r.area_id)
    assert got[1] == {1}            # lower-left corner is inside
    assert got[2] == {None}         # upper-right corner is outside
    assert got[3] == {None}         # inside the notch of the L: outside
    assert got[4] == {2, 3}         # overlap: both areas
    assert got[5] == {None}


def test_point_in_area_large_area_uses_coarse_level(spark):
    big = [{"x": 0.0, "y": 0.0}, {"x": 1000.0, "y": 0.0}, {"x": 1000.0, "y": 1000.0}, {"x": 0.0, "y": 1000.0}]
    areas = spark.createDataFrame([(9, big)], "area_id long, ring array<struct<x:double,y:double>>")
    assert spatial.area_cells(areas, 5.0).count() <= 9        # not exploded at the fine level
    pts = spark.createDataFrame([(1, 999.0, 999.0), (2, 1000.0, 10.0)], "point_id long, x double, y double")
    got = {r.point_id: r.area_id for r in spatial.point_in_area_join(pts, areas, cell=5.0).collect()}
    assert got == {1: 9, 2: None}


def test_point_in_area_country_sized_and_crowded_cells(spark):
    """A 1,000 km square (in metres) takes a few cells; 100,000 areas in one cell are all kept."""
    from pyspark.sql import functions as F

    def ring(x0, y0, w):
        return F.array(*[F.struct(F.lit(float(a)).alias("x") if not hasattr(a, "cast") else a.alias("x"), b.alias("y"))
                         for a, b in ((x0, y0), (x0 + w, y0), (x0 + w, y0 + w), (x0, y0 + w))])

    zero = F.lit(0.0)
    big = spark.range(1).select(F.lit(-1).cast("long").alias("area_id"), ring(zero, zero, F.lit(1e6)).alias("ring"))
    assert spatial.area_cells(big, 5.0).count() <= 9
    small = spark.range(100_000).select(F.col("id").alias("area_id"), ring(zero + 1, zero + 1, F.lit(2.0)).alias("ring"))
    pts = spark.createDataFrame([(1, 2.0, 2.0), (2, 9e5, 9e5), (3, -5.0, 1.0)], "point_id long, x double, y double")
    got = spatial.point_in_area_join(pts, big.union(small), cell=5.0).groupBy("point_id").agg(
        F.count("area_id").alias("n")).collect()
    assert {r.point_id: r.n for r in got} == {1: 100_001, 2: 1, 3: 0}


def test_pivot_years_reports_duplicates_and_unlisted_years(spark):
    df = spark.createDataFrame([(1, 1999, 1.0), (1, 2000, 2.0), (2, 1999, None)], "geo int, year int, estimate double")
    got = {r.geo: (r.x1999, r.x2000) for r in reshape.pivot_years(df, ["geo"], [1999, 2000]).collect()}
    assert got == {1: (1.0, 2.0), 2: (None, None)}
    with pytest.raises(Exception, match="several rows"):
        reshape.pivot_years(df.union(df), ["geo"], [1999, 2000]).collect()
    with pytest.raises(Exception, match="not listed"):
        reshape.pivot_years(df, ["geo"], [1999]).collect()


def test_unknown_years_variables_and_segments_are_errors(spark):
    from pyspark.sql import functions as F
    from inkwell.sources import fixtures
    from inkwell.sources.tables import Tables
    t = Tables(spark, SF_SMALL)
    for only in ({"years": [2002]}, {"variables": ["b90002_999"]}):
        with pytest.raises(ValueError, match="not in the yearly extract"):
            fixtures.f1_long(t, **only)
    with pytest.raises(Exception, match="unknown segment"):
        spark.range(1).select(fixtures.segment_number(F.lit("ROCKETS"))).collect()


@pytest.mark.parametrize("day", ["2002-03-01", None])
def test_an_order_of_an_unlisted_year_is_an_error(spark, tmp_path, day):
    from pyspark.sql import functions as F
    from inkwell.plans import QUERIES
    for t in ("customer", "nation"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").write.parquet(f"file://{tmp_path}/{t}.parquet")
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    late = orders.limit(1).withColumn("o_orderdate", F.lit(day).cast(orders.schema["o_orderdate"].dataType))
    orders.unionByName(late).write.parquet(f"file://{tmp_path}/orders.parquet")
    for key in ("vintage_harmonize", "yearly_totals", "pivot_years"):
        with pytest.raises(Exception, match="order year in no vintage: " + (day or "none")[:4]):
            QUERIES[key](spark, f"file://{tmp_path}").collect()


def test_pipe_files_with_other_column_order_are_errors(spark, tmp_path):
    from inkwell.sources import io
    (tmp_path / "a.csv").write_text("GEO_ID|E001|E002\n0500|1|2\n")
    ok = io.scan_pipe_delimited(spark, f"file://{tmp_path}").collect()
    assert (ok[0].geo_id, ok[0].e001, ok[0].e002) == ("0500", 1.0, 2.0)
    (tmp_path / "b.csv").write_text("GEO_ID|E002|E001\n0501|20|2\n")
    with pytest.raises(Exception, match="(?i)header"):
        io.scan_pipe_delimited(spark, f"file://{tmp_path}").collect()


def test_share_of_group_total_null_group_and_hot_key(spark):
    rows = [("a", 1.0)] * 30 + [("b", 2.0), ("b", 6.0), (None, 1.0), (None, 3.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = shares.share_of_group_total(df, ["g"], "v").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(None if r.share is None else round(r.share, 9))
    assert by["a"] == [round(1 / 30, 9)] * 30
    assert sorted(by["b"]) == [0.25, 0.75] and sorted(by[None]) == [0.25, 0.75]
    assert by["c"] == [None]


def test_point_in_area_without_broadcast_gives_the_same_rows(spark):
    """Without any broadcast the lookups are shuffle joins; same result."""
    def square(x0, y0, w):
        return [{"x": x0, "y": y0}, {"x": x0 + w, "y": y0}, {"x": x0 + w, "y": y0 + w}, {"x": x0, "y": y0 + w}]

    areas = spark.createDataFrame([(1, square(0.0, 0.0, 5.0)), (2, square(0.0, 0.0, 400.0)), (3, square(50.0, 50.0, 5.0))],
                                  "area_id long, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 51.0, 52.0), (3, 300.0, 10.0), (4, 500.0, 500.0), (5, None, 1.0)],
                                "point_id long, x double, y double")
    want = sorted(map(tuple, spatial.point_in_area_join(pts, areas, cell=5.0).collect()), key=repr)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spatial.point_in_area_join(pts, areas, cell=5.0)
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, df.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert got == want
    assert sorted((r[0], r[3]) for r in got if r[0] != 5) == [(1, 1), (1, 2), (2, 2), (2, 3), (3, 2), (4, None)]
    assert [r[3] for r in got if r[0] == 5] == [None]


# ----------------------------------------------------------------- features and polygons
FEATURES = [
    '{"type":"Feature","properties":{"name":"a","votes":"12"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4.5],[0,0]],[[1,1],[2,1],[2,2],[1,1]]]}}',
    '\x1e{"type":"Feature","properties":{"name":"b","votes":3.5},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}}',
    "", "  ", "{not json",
    '{"type":"Feature","properties":{"name":"c"},"geometry":null}',
    '{"type":"Feature","properties":null,"geometry":{"type":"Point","coordinates":[1,2]}}',
    '{"type":"Thing","properties":{"name":"d"},"geometry":{"type":"Polygon","coordinates":[]}}',
    '{"type":"Feature","properties":{"name":"e"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,0]]]}}',
    '{"type":"Feature","properties":{"name":"f"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]}}',
    '{"type":"Feature","properties":{"name":"g"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,"x"],[1,1],[0,0]]]}}',
    '{"type":"Feature","properties":{"name":"h"},"geometry":{"type":"Polygon","coordinates":[[[0],[1],[1],[0]]]}}',
    '{"type":"Feature","properties":{"name":"i"},"geometry":{"type":"Polygon","coordinates":[]}}',
]
ERRORS = {"c": "no geometry", None: None, "d": "not a feature", "e": "ring of fewer than 4 positions", "f": "ring not closed",
          "h": "bad position", "i": "no rings"}


def test_feature_sequence_good_and_bad(spark, tmp_path):
    from inkwell.sources import geojson
    (tmp_path / "f.geojsonl").write_text("\n".join(FEATURES))
    rows = geojson.read_feature_sequence(spark, f"file://{tmp_path}", "name string, votes string").withColumn(
        "area", geojson.area(F.col("polygons"))).collect()
    assert len(rows) == 11                         # every line that isn't blank
    by = {r.name: r for r in rows if r.name}
    assert (by["a"].votes, by["a"].area, len(by["a"].polygons[0])) == ("12", 8.5, 2) and by["a"].error is None
    assert (by["b"].votes, by["b"].area, len(by["b"].polygons)) == ("3.5", 1.0, 2)
    assert {n: by[n].error for n in ERRORS if n} == {n: e for n, e in ERRORS.items() if n}
    assert by["g"].error in ("bad coordinates", "bad position") and by["g"].polygons is None
    assert sorted(r.error for r in rows if r.name is None) == ["geometry type Point", "unparsable feature"]
    assert all((r.polygons is None) == (r.error is not None) for r in rows)


def test_feature_collections_and_round_trip(spark, tmp_path):
    from inkwell.sources import geojson
    good = [f.strip("\x1e") for f in FEATURES if f.strip() and "not json" not in f]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"type":"FeatureCollection",\n"features":[' + ",\n".join(good) + "]}")
    (tmp_path / "in" / "b.json").write_text('{"features": []}')
    (tmp_path / "in" / "c.json").write_text('{"features": [')
    df = geojson.read_feature_collections(spark, f"file://{tmp_path}/in", "name string, votes string")
    rows = df.collect()
    assert len(rows) == len(good) + 1 and sum(r.error is None for r in rows) == 2
    kept = df.where("error is null").drop("error")
    geojson.write_feature_sequence(kept, f"file://{tmp_path}/out")
    again = geojson.read_feature_sequence(spark, f"file://{tmp_path}/out", "name string, votes string")
    assert sorted(map(str, again.collect())) == sorted(map(str, df.where("error is null").collect()))


def test_large_ring_with_a_hole_and_many_parts(spark):
    """100,000 positions with a hole of 50,000: a point tests the edges of one slab; none is lost."""
    import numpy as np
    from inkwell.operators.spatial import COPIES, SLAB_EDGES

    def wheel(n, radius, wobble):
        a = np.arange(n) * 2 * np.pi / n
        r = radius * (1 + wobble * np.sin(37 * a))
        return np.append(r * np.cos(a), r[0]), np.append(r * np.sin(a), 0.0)

    rings = [wheel(100_000, 900.0, 0.2), wheel(50_000, 300.0, 0.1)]
    rows = [(7, [[[(float(x), float(y)) for x, y in zip(*ring)] for ring in rings]]),
            (8, [[[(i * 10.0, 0.0), (i * 10.0 + 5, 0.0), (i * 10.0 + 5, 5.0), (i * 10.0, 5.0)]] for i in range(200)])]
    areas = spark.createDataFrame(rows, "area_id long, polygons array<array<array<struct<x:double,y:double>>>>")
    cells = spatial.area_cells(areas, 5.0, polygons="polygons").selectExpr("area_id", "size(_edges) AS n", "_slab", "_cx").collect()
    assert max(r.n for r in cells) <= 20 * SLAB_EDGES
    one = {r._slab: r.n for r in cells if r.area_id == 7}
    assert sum(one.values()) <= 2 * COPIES * 150_002
    r = np.random.default_rng(5)
    pts = np.vstack([r.uniform(-1200, 1200, (1500, 2)), r.uniform(0, 100, (500, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "point_id long, x double, y double")
    got = {}
    for row in spatial.point_in_area_join(df, areas, polygons="polygons").collect():
        got.setdefault(row.point_id, set()).add(row.area_id)

    def inside(px, py):
        n = 0
        for xs, ys in rings:
            x1, y1, x2, y2 = xs[1:], ys[1:], xs[:-1], ys[:-1]
            up = (y1 > py) != (y2 > py)
            n += int((px < x1[up] + (x2[up] - x1[up]) / (y2[up] - y1[up]) * (py - y1[up])).sum())
        return n % 2 == 1

    for i, (x, y) in enumerate(pts):
        want = ({7} if inside(x, y) else set()) | ({8} if 0 <= y < 5 and 0 <= x < 2000 and x % 10 < 5 else set())
        assert got[i] == (want or {None})


# ----------------------------------------------------------------- spelling, intervals, rejects, margins
# The names of the states.
STATES = """Alabama, Alaska, Arizona, Arkansas, California, Colorado, Connecticut, Delaware, District of Columbia, Florida,
Georgia, Hawaii, Idaho, Illinois, Indiana, Iowa, Kansas, Kentucky, Louisiana, Maine, Maryland, Massachusetts, Michigan,
Minnesota, Mississippi, Missouri, Montana, Nebraska, Nevada, New Hampshire, New Jersey, New Mexico, New York,
North Carolina, North Dakota, Ohio, Oklahoma, Oregon, Pennsylvania, Rhode Island, South Carolina, South Dakota,
Tennessee, Texas, Utah, Vermont, Virginia, Washington, West Virginia, Wisconsin, Wyoming""".replace("\n", " ").split(", ")


def test_spelling_finds_the_listed_corrections_and_changes_no_right_name(spark):
    from inkwell.operators import spelling
    names = spark.createDataFrame([(s,) for s in STATES], "name string")
    seen = [*STATES, *STATE_FIXES, *STATE_FIXES, "Nowhere", "", None, "Xhio", "Dakota", "North Dakot", "South Dakotaa"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seen)], "id int, value string")
    found = {r.value: r for r in spelling.corrections(df, names).collect()}
    assert {v: found[v].fix for v in STATE_FIXES} == STATE_FIXES and not set(found) & set(STATES)
    assert (found["Nowhere"].fix, found["Nowhere"].n_nearest, found["Nowhere"].distance) == (None, 0, None)
    assert found["Xhio"].fix == "Ohio" and found["North Dakot"].fix == "North Dakota"
    tie = spelling.corrections(spark.createDataFrame([("cat",)], "value string"),
                               spark.createDataFrame([("bat",), ("rat",), ("horse",)], "name string")).first()
    assert (tie.fix, tie.distance, tie.n_nearest) == (None, 1, 2)
    fixed = {r.id: r.value for r in spelling.respell(df, "value", spelling.corrections(df, names)).collect()}
    assert len(fixed) == len(seen) and [fixed[i] for i in range(len(STATES))] == STATES
    assert all(fixed[i] == STATE_FIXES.get(s, fixed[i]) for i, s in enumerate(seen))


def test_label_intervals_bridge_skipped_years_and_keep_the_pivot_whole(spark):
    cat = spark.createDataFrame([("v1", "Old", 2015), ("v1", "Old", 2016), ("v1", "New", 2018), ("v1", "New", 2021), ("v1", "Old", 2022),
                                 ("v2", "Same", 2015), ("v2", "Same", 2022), ("v3", None, 2015), ("v1", "Old", 2015)],
                                "name string, label string, year int")
    spans = {(r.name, r.from_year): (r.label, r.to_year) for r in reshape.label_intervals(cat).collect()}
    assert spans == {("v1", 2015): ("Old", 2017), ("v1", 2018): ("New", 2021), ("v1", 2022): ("Old", None),
                     ("v2", 2015): ("Same", None), ("v3", 2015): (None, None)}
    facts = spark.createDataFrame([("v1", y, 1.0) for y in (2014, 2015, 2017, 2020, 2023)] + [("v9", 2015, 1.0), ("v2", 2020, 1.0)],
                                  "variable string, year int, estimate double")
    rows = {(r.variable, r.year): (r.label, r.label_now) for r in reshape.join_label_intervals(
        facts, reshape.label_intervals(cat)).collect()}
    assert rows == {("v1", 2014): (None, "Old"), ("v1", 2015): ("Old", "Old"), ("v1", 2017): ("Old", "Old"), ("v1", 2020): ("New", "Old"),
                    ("v1", 2023): ("Old", "Old"), ("v9", 2015): (None, None), ("v2", 2020): ("Same", "Same")}


def test_checked_scan_keeps_every_line(spark, tmp_path):
    from inkwell.sources import io
    lines = ['1,"a,b",2.5', "2,short", '3,"x ""q"" , y",1,extra', "four,b,1", "5,c,nope", "6,d,", "", "7,e,7"]
    (tmp_path / "f.csv").write_text("id,name,v\n" + "\n".join(lines) + "\n")
    schema = "id int, name string, v double"
    df = io.scan_delimited_checked(spark, f"file://{tmp_path}", spark.createDataFrame([], schema).schema, header=True)
    good, bad = io.split_rejects(df)
    assert sorted(map(tuple, good.collect())) == [(1, "a,b", 2.5), (6, "d", None), (7, "e", 7.0)]
    assert sorted(map(tuple, bad.collect())) == sorted([
        ("2,short", "short"), ('3,"x ""q"" , y",1,extra', "long"), ("four,b,1", "unparsable value"), ("5,c,nope", "unparsable value")])
    assert good.count() + bad.count() == len([x for x in lines if x])


def test_margins_of_sums_and_shares(spark):
    df = spark.createDataFrame([(1, 30.0, 3.0, 100.0, 8.0), (1, 20.0, 4.0, 100.0, 6.0), (2, 90.0, 1.0, 100.0, 50.0),
                                (3, 1.0, None, 10.0, 1.0), (4, 0.0, 0.0, 0.0, 0.0)],
                               "p int, a double, a_margin double, total double, total_margin double")
    r = {x.p: x for x in shares.total_margins(df, ["p"], ["a"], "total").collect()}
    assert (r[1].a, r[1].a_margin, r[1].total_margin, r[1].a_percent) == (50.0, 5.0, 10.0, 0.25)
    assert r[1].a_percent_margin == pytest.approx((25 - 0.0625 * 100) ** 0.5 / 200)
    assert r[2].a_percent_margin == pytest.approx((1 + 0.81 * 2500) ** 0.5 / 100)      # the ratio rule
    assert r[3].a_margin is None and r[3].a_percent_margin is None and r[3].a_percent == 0.1
    assert r[4].a_percent is None and r[4].a_percent_margin is None


SHAPE = "array<array<array<struct<x:double,y:double>>>>"


def test_area_weights_of_concave_shapes_sum_to_one(spark):
    """Targets that divide a square: a concave ring with a hole, the hole, the rest in two parts."""
    import numpy as np

    def ring(*points):
        return [(float(x), float(y)) for x, y in (*points, points[0])]

    concave = ring((0, 0), (10, 0), (10, 10), (6, 10), (6, 4), (3, 4), (3, 10), (0, 10))       # a U
    hole = ring((1, 1), (1, 3), (2, 3), (2, 1))                                                # turned the other way
    notch = ring((3, 4), (6, 4), (6, 10), (3, 10))
    targets = spark.createDataFrame([(1, [[concave, hole]]), (2, [[hole]]), (3, [[notch]]),
                                     (4, [[ring((10, 0), (40, 0), (40, 10), (10, 10))], [ring((0, 10), (40, 10), (40, 40), (0, 40))]])],
                                    f"target_id long, polygons {SHAPE}")
    r = np.random.default_rng(2)
    rows = []
    for i in range(60):
        n = int(r.integers(3, 12))
        a = np.sort(r.uniform(0, 2 * np.pi, n))
        d = r.uniform(0.5, 6, n)
        c = r.uniform(7, 13, 2)
        rows.append((i, [[ring(*zip(c[0] + d * np.cos(a), c[1] + d * np.sin(a)))]]))
    rows += [(100, [[ring((2, 2), (7, 2), (7, 8), (2, 8))]]), (101, [[ring((1.2, 1.5), (1.8, 1.5), (1.8, 2.5))]]),
             (102, [[ring((0, 0), (12, 0), (12, 12), (0, 12)), ring((3, 4), (6, 4), (6, 10), (3, 10))]]),
             (103, [[ring((0, 0), (1, 0), (2, 0))]])]
    sources = spark.createDataFrame(rows, f"source_id long, polygons {SHAPE}")
    got = {}
    for x in spatial.area_weights(sources, targets, cell=4.0).collect():
        got.setdefault(x.source_id, {})[x.target_id] = (x.area, x.weight)
    assert set(got) == {*range(60), 100, 101, 102}                  # 103 has no area
    inside = [i for i in range(60) if min(min(p) for p in rows[i][1][0][0]) >= 0]
    assert len(inside) > 40
    assert all(sum(w for _, w in got[i].values()) == pytest.approx(1, abs=1e-9) for i in [*inside, 100, 101, 102])
    assert {t: round(a, 9) for t, (a, _) in got[100].items()} == {1: 18.0, 3: 12.0}
    assert {t: round(a, 9) for t, (a, _) in got[101].items()} == {2: 0.3}
    assert {t: round(a, 9) for t, (a, _) in got[102].items()} == {1: 80.0, 2: 2.0, 4: 44.0}
    values = spark.createDataFrame([(100, 30.0), (102, 126.0)], "source_id long, n double")
    dealt = {x.target_id: round(x.n, 6) for x in spatial.interpolate(
        values, spatial.area_weights(sources, targets, cell=4.0), ["n"]).collect()}
    assert dealt == {1: 98.0, 2: 2.0, 3: 12.0, 4: 44.0}
