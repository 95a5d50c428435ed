"""Point-in-area jobs on F8."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators.spatial import area_weights, interpolate, point_in_area_join
from inkwell.plans import oracle_fixtures as O
from inkwell.plans.registry import finish, query
from inkwell.session import materialize, scratch_path
from inkwell.sources import geojson
from inkwell.sources.fixtures import (
    F8_CELL, F8_L_RING, F9_COLS, F9_DISTRICT, F9_SIDE, F9_STEP, F10_RISE, F10_STEPS, f8_l_ring, f8_points, f8_rectangles,
    f9_districts, f9_features, f9_precincts, f10_areas,
)
from inkwell.sources.tables import Tables

r6 = O.r6
S = O.with_(O.f8())
L_RING_ID = 100000


@query("point_in_area_join", sql=S + f"""
SELECT p.point_id, {r6('p.x', 'x')}, {r6('p.y', 'y')}, r.area_id
FROM f8_points p LEFT JOIN f8_rect r ON p.x >= r.x0 AND p.x < r.x1 AND p.y >= r.y0 AND p.y < r.y1""")
def point_in_area(spark, sf_dir):
    """Every event point with the rectangle under it (null outside all)."""
    points = f8_points(Tables(spark, sf_dir))
    return finish(point_in_area_join(points, f8_rectangles(spark), cell=F8_CELL))


def _ring_parity_sql(px: str = "x", py: str = "y") -> str:
    terms = []
    n = len(F8_L_RING)
    for i in range(n):
        xi, yi = F8_L_RING[i]
        xj, yj = F8_L_RING[(i - 1) % n]
        terms.append(f"CASE WHEN (({yi} > {py}) <> ({yj} > {py})) AND "
                     f"{px} < ({xj} - {xi}) * ({py} - {yi}) / ({yj} - {yi}) + {xi} THEN 1 ELSE 0 END")
    return "(" + " + ".join(terms) + ") % 2 = 1"


@query("point_in_area_join_ring", sql=S + f"""
SELECT point_id, {r6('x', 'x')}, {r6('y', 'y')}, CASE WHEN {_ring_parity_sql()} THEN CAST({L_RING_ID} AS BIGINT) END AS area_id
FROM f8_points""")
def point_in_ring(spark, sf_dir):
    """Every event point tested against a concave (L-shaped) ring."""
    points = f8_points(Tables(spark, sf_dir))
    return finish(point_in_area_join(points, f8_l_ring(spark), cell=F8_CELL))


@query("point_in_multipolygon", sql=S + f"""
, a AS (SELECT n_nationkey AS k, 1 + n_nationkey % 5 * 6 AS x0, n_nationkey // 5 * 100 AS y0 FROM nation),
hit AS (
  SELECT point_id, CAST(k AS BIGINT) AS area_id FROM f8_points JOIN a
    ON (x >= x0 AND x < x0 + 5.5 AND y >= y0 AND y < y0 + 90
        AND NOT (k % 2 = 0 AND x >= x0 + 1 AND x < x0 + 3 AND y >= y0 + 20 AND y < y0 + 60))
    OR (k % 3 = 0 AND x >= x0 + 5.625 AND x < x0 + 5.875 AND y >= y0 AND y < y0 + 95)
  UNION ALL
  SELECT point_id, 1000 FROM f8_points
  WHERE x >= 1 AND y >= 0 AND y < {F10_STEPS * F10_RISE} AND x < 2 + floor(y / {F10_RISE}) % 100 * 0.25)
SELECT p.point_id, {r6('p.x', 'x')}, {r6('p.y', 'y')}, h.area_id FROM f8_points p LEFT JOIN hit h ON h.point_id = p.point_id""")
def point_in_multipolygon(spark, sf_dir):
    """Every event point with the areas under it: holes, several parts and a ring of 8,002 positions."""
    t = Tables(spark, sf_dir)
    return finish(point_in_area_join(f8_points(t), f10_areas(t), cell=F8_CELL, polygons="polygons"))


@query("scan_geojson_features", sql=f"""
WITH f AS (
  SELECT p_partkey AS k, p_partkey % {F9_COLS} * {F9_STEP} AS x0, p_partkey // {F9_COLS} * {F9_STEP} AS y0,
    CASE WHEN p_partkey % 23 = 0 THEN '?' ELSE lower(p_type) END AS race,
    CASE WHEN p_partkey % 50 = 30 THEN 'unparsable feature' WHEN p_partkey % 5 IN (1, 2) THEN NULL
      WHEN p_partkey % 50 = 10 THEN 'no geometry' WHEN p_partkey % 50 = 20 THEN 'ring not closed' END AS error
  FROM part)
SELECT CASE WHEN error = 'unparsable feature' THEN NULL ELSE k END AS precinct_geo,
  CASE WHEN error = 'unparsable feature' THEN NULL ELSE race END AS race, error,
  CASE WHEN error IS NULL THEN CASE WHEN k % 5 = 2 THEN 2 ELSE 1 END END AS n_parts,
  CASE WHEN error IS NULL THEN CASE WHEN k % 5 IN (1, 2) THEN 2 ELSE 1 END END AS n_rings,
  {r6(f"CASE WHEN error IS NULL THEN {F9_SIDE * F9_SIDE} + CASE k % 5 WHEN 1 THEN -1 WHEN 2 THEN 0.25 ELSE 0 END END", 'area')},
  {r6("CASE WHEN error IS NULL THEN x0 END", 'x0')}, {r6("CASE WHEN error IS NULL THEN y0 END", 'y0')}
FROM f""")
def scan_geojson_features(spark, sf_dir):
    """Precinct features read from a feature sequence: properties, parts, rings and area; bad features
    kept apart by their error."""
    path = scratch_path(spark, "features")
    f9_features(Tables(spark, sf_dir)).write.text(path)
    df = geojson.read_feature_sequence(spark, path, "precinct_geo bigint, race string, immigrant_prop string")
    first = F.get(F.get(F.get("polygons", F.lit(0)), F.lit(0)), F.lit(0))
    return finish(df.select("precinct_geo", "race", "error", F.when(F.col("polygons").isNotNull(), F.size("polygons")).alias("n_parts"),
                            F.when(F.col("polygons").isNotNull(), F.size(F.flatten("polygons"))).alias("n_rings"),
                            F.when(F.col("polygons").isNotNull(), geojson.area(F.col("polygons"))).alias("area"),
                            first["x"].alias("x0"), first["y"].alias("y0")))


def _overlap_sql(x: str, y: str, wide: float, high: float) -> str:
    """Area that the rectangle from (x, y) shares with the district from (dx, dy)."""
    dw, dh = F9_DISTRICT
    return (f"greatest(0, least({x} + {wide}, dx + {dw}) - greatest({x}, dx)) * "
            f"greatest(0, least({y} + {high}, dy + {dh}) - greatest({y}, dy))")


@query("area_weighted_join", sql=O.with_(O.f5()) + f"""
, s AS (SELECT p_partkey AS k, a, a + r AS total, p_partkey % {F9_COLS} * {F9_STEP} AS x0, p_partkey // {F9_COLS} * {F9_STEP} AS y0,
          {F9_SIDE * F9_SIDE} + CASE p_partkey % 5 WHEN 1 THEN -1 WHEN 2 THEN 0.25 ELSE 0 END AS whole FROM f5_votes),
d AS (SELECT s.*, floor(x0 / {F9_DISTRICT[0]}) + di AS i, floor(y0 / {F9_DISTRICT[1]}) + dj AS j
      FROM s, (VALUES (0), (1)) g(di), (VALUES (0), (1)) h(dj)),
o AS (SELECT *, i * {F9_DISTRICT[0]} AS dx, j * {F9_DISTRICT[1]} AS dy FROM d),
w AS (SELECT *, ({_overlap_sql('x0', 'y0', F9_SIDE, F9_SIDE)}
          - CASE WHEN k % 5 = 1 THEN {_overlap_sql('(x0 + 1)', '(y0 + 1)', 1.0, 1.0)} ELSE 0 END
          + CASE WHEN k % 5 = 2 THEN {_overlap_sql('(x0 + 3.25)', 'y0', 0.5, 0.5)} ELSE 0 END) / whole AS weight FROM o)
SELECT CAST(i * 100000 + j AS BIGINT) AS district, {r6('sum(a * weight)', 'votes_a')}, {r6('sum(total * weight)', 'votes_total')},
  count(*) AS n_sources FROM w WHERE weight > 0 GROUP BY ALL""")
def area_weighted_join(spark, sf_dir):
    """Precinct votes dealt out to the districts that cut through their shapes, by shared area."""
    precincts = materialize(f9_precincts(Tables(spark, sf_dir)))      # read four times
    weights = area_weights(precincts, f9_districts(precincts), cell=8.0, source_key="precinct_geo", target_key="district")
    return finish(interpolate(precincts, weights, ["votes_a", "votes_total"], "precinct_geo", "district"))
