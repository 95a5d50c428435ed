"""Point-in-area join.

A grid has a level for every power of two of the cell size; an area sits at the
level whose cells are no smaller than its box, so it touches a few cells
however large it is. A point looks up its own cell at each level that any area
uses with one equi-join; a candidate row is one area in one cell, and stays a
plain row, so any number of areas may share a cell. Candidates whose ring
contains the point (ray casting as higher-order expressions, no UDF) are hits;
they meet their points again by row number, so a point in no area keeps one
row with a null area. Spark broadcasts the candidates by its own size check;
otherwise AQE splits a hot cell. Nothing is dropped or capped.

An area may have several parts and holes: inside means inside an odd number of
its rings. A large ring is cut into slabs: its cells are halved in height until
a slab holds about ``SLAB_EDGES`` edges, and a point tests the edges of its own
slab only (an edge counts for every slab it passes; halving stops before the
copies exceed ``COPIES`` times the edges, so a comb of long teeth keeps thicker
slabs, with the same result).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.session import materialize

#: Edges of a slab, about; rows of edges for each edge, at most about.
SLAB_EDGES, COPIES = 64, 8


def ring_edges(ring: Column) -> Column:
    """array<struct<x1, y1, y2, dxdy>>: each vertex with its predecessor (the
    ring closes implicitly, so the first vertex pairs with the last), and
    the edge's inverse slope (null for a horizontal edge, which no
    horizontal ray straddles)."""
    prev = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.size(ring) - 1))
    return F.transform(F.arrays_zip(ring.alias("a"), prev.alias("b")),
                       lambda z: F.struct(z["a"]["x"].alias("x1"), z["a"]["y"].alias("y1"),
                                          z["b"]["y"].alias("y2"),
                                          F.try_divide(z["b"]["x"] - z["a"]["x"],
                                                       z["b"]["y"] - z["a"]["y"]).alias("dxdy")))


def inside_edges(edges: Column, px: Column, py: Column) -> Column:
    """Ray casting with the half-open rule: count the edges that straddle the
    point's horizontal line and cross it to the right of the point; odd means
    inside. Points on a left/bottom edge are in, on a right/top edge out."""
    def crosses(e):
        straddles = (e["y1"] > py) != (e["y2"] > py)
        return F.coalesce(straddles & (px < e["x1"] + e["dxdy"] * (py - e["y1"])), F.lit(False))
    # A running parity (no intermediate array per point).
    return F.aggregate(edges, F.lit(False), lambda inside, e: inside != crosses(e))


def ray_cast(ring: str, px: str, py: str) -> Column:
    """True when (px, py) is inside the ring (array<struct<x, y>>)."""
    return inside_edges(ring_edges(F.col(ring)), F.col(px), F.col(py))


def area_edges(shape: Column, parts: bool) -> Column:
    """The edges of all rings: ``shape`` is a ring or, with ``parts``, polygons of rings."""
    return F.flatten(F.transform(F.flatten(shape), ring_edges)) if parts else ring_edges(shape)


def area_cells(areas: DataFrame, cell: float, area_key: str = "area_id", ring: str = "ring",
               polygons: str | None = None) -> DataFrame:
    """(area key, box, edges, level, cut, cx, cy, slab): one row per grid cell that an area's box
    touches at its level and slab of the cell, which is cut into 2^cut of them."""
    shape = F.col(polygons or ring)
    vertices = F.flatten(F.flatten(shape)) if polygons else shape
    xs, ys = F.transform(vertices, lambda p: p["x"]), F.transform(vertices, lambda p: p["y"])
    b = areas.select(area_key, F.array_min(xs).alias("_xmin"), F.array_max(xs).alias("_xmax"), F.array_min(ys).alias("_ymin"),
                     F.array_max(ys).alias("_ymax"), area_edges(shape, polygons is not None).alias("_edges"))
    side = F.greatest(F.col("_xmax") - F.col("_xmin"), F.col("_ymax") - F.col("_ymin"))
    b = b.withColumn("_level", F.when(side > cell, F.ceil(F.log2(side / cell))).otherwise(0).cast("int"))
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_level"))
    n = F.size("_edges")
    rise = F.aggregate("_edges", F.lit(0.0), lambda s, e: s + F.abs(e["y1"] - e["y2"]))
    most = F.floor(F.log2(F.greatest((COPIES - 1) * n * size / F.nullif(rise, F.lit(0.0)), F.lit(1.0))))
    cut = F.when(n > SLAB_EDGES, F.least(F.ceil(F.log2(n / SLAB_EDGES)), F.coalesce(most, F.lit(0)))).otherwise(0)
    b = b.withColumn("_cut", cut.cast("int"))
    high = size / F.pow(F.lit(2.0), F.col("_cut"))
    columns = [area_key, "_xmin", "_xmax", "_ymin", "_ymax", "_edges", "_level", "_cut", "_slab"]
    plain = b.where("_cut = 0").withColumn("_slab", F.explode(F.sequence(F.floor(F.col("_ymin") / size), F.floor(F.col("_ymax") / size))))
    boxes = b.where("_cut > 0")
    edges = boxes.select(area_key, "_xmin", "_xmax", "_ymin", "_ymax", "_level", "_cut", high.alias("_high"),
                         F.explode("_edges").alias("e")).where("e.y1 <> e.y2")
    edges = edges.withColumn("_slab", F.explode(F.sequence(F.floor(F.least("e.y1", "e.y2") / F.col("_high")),
                                                           F.floor(F.greatest("e.y1", "e.y2") / F.col("_high")))))
    keys = [area_key, "_xmin", "_xmax", "_ymin", "_ymax", "_level", "_cut", "_slab"]
    slabs = edges.groupBy(*keys).agg(F.collect_list("e").alias("_edges"))
    rows = plain.select(*columns).unionByName(slabs.select(*columns))
    span = F.sequence(F.floor(F.col("_xmin") / size), F.floor(F.col("_xmax") / size))
    return rows.select("*", F.explode(span).alias("_cx"))


def point_in_area_join(points: DataFrame, areas: DataFrame, cell: float = 5.0, area_key: str = "area_id",
                       x: str = "x", y: str = "y", ring: str = "ring", polygons: str | None = None) -> DataFrame:
    """Each point with every area containing it; a point in none gets one row
    with a null area. Output: point columns + ``area_key``. Areas have a ``ring``
    or, if named, ``polygons``: parts of rings, the first an outline, the others holes.

    A point is in exactly one cell and slab per level, so each area is a candidate
    of a point at most once. The points are materialized once for their row
    numbers; what is looked up per level is (row, x, y) only."""
    cells = area_cells(areas, cell, area_key, ring, polygons)
    if polygons:
        cells = materialize(cells)          # large rings are cut once
    rows = materialize(points.withColumn("_row", F.monotonically_increasing_id()))
    # At most one entry per power of two of the level and of the cut.
    used = cells.agg(F.sort_array(F.collect_set(F.struct("_level", "_cut")))).scalar()
    px, py = F.col("_px"), F.col("_py")
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_level"))
    look = rows.select("_row", F.col(x).alias("_px"), F.col(y).alias("_py"), F.inline(used))
    look = look.withColumns({"_cx": F.floor(px / size), "_slab": F.floor(py / (size / F.pow(F.lit(2.0), F.col("_cut"))))})
    in_box = (F.col("_xmin") <= px) & (px <= F.col("_xmax")) & (F.col("_ymin") <= py) & (py <= F.col("_ymax"))
    hits = look.join(cells, ["_level", "_cut", "_cx", "_slab"]).where(in_box & inside_edges(F.col("_edges"), px, py))
    return rows.join(hits.select("_row", area_key), "_row", "left").select(*points.columns, area_key)


# ----------------------------------------------------------------- areas against areas
def _side(a: Column, b: Column, p: Column) -> Column:
    """Positive left of a -> b."""
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def _once(x: Column, f) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _closed_pairs(ring: Column) -> Column:
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.arrays_zip(F.slice(ring, 1, n).alias("p"), F.slice(ring, 2, n).alias("q"))


def _clip(ring: Column, edge: Column) -> Column:
    """The closed ring's part left of an edge, closed again (empty if there is none)."""
    def piece(z: Column) -> Column:
        p, q, sp, sq = z["p"]["v"], z["q"]["v"], z["p"]["s"], z["q"]["s"]
        t = F.try_divide(sp, sp - sq)
        cross = F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))
        return (F.when((sp >= 0) & (sq >= 0), F.array(q)).when((sp >= 0) & (sq < 0), F.array(cross))
                .when((sp < 0) & (sq >= 0), F.array(cross, q)).otherwise(F.slice(F.array(q), 1, 0)))

    sided = F.transform(ring, lambda v: F.struct(v.alias("v"), _side(edge["a"], edge["b"], v).alias("s")))
    kept = _once(sided, lambda r: F.flatten(F.transform(_closed_pairs(r), piece)))
    return _once(kept, lambda k: F.concat(F.slice(k, -1, 1), k))


def _ring_area(ring: Column) -> Column:
    return _once(ring, lambda r: F.abs(F.aggregate(
        _closed_pairs(r), F.lit(0.0), lambda s, z: s + z["p"]["x"] * z["q"]["y"] - z["q"]["x"] * z["p"]["y"])) / 2)


def polygons_area(polygons: Column, within: Column | None = None) -> Column:
    """Area of polygons (outlines minus holes), all of it or that inside a convex polygon given by its
    edges, left turns."""
    def ring_area(ring: Column) -> Column:
        return _ring_area(ring if within is None else F.aggregate(within, ring, _clip))

    def one(p: Column) -> Column:
        return ring_area(F.get(p, F.lit(0))) - F.aggregate(F.slice(p, 2, F.size(p)), F.lit(0.0), lambda s, r: s + ring_area(r))

    return F.aggregate(polygons, F.lit(0.0), lambda s, p: s + one(p))


def signed_triangles(areas: DataFrame, key: str, polygons: str = "polygons") -> DataFrame:
    """(key, sign, edges, box): triangles whose signed sum is the area: a fan over each ring, holes
    negative. Triangles turn left; flat ones are left out."""
    rings = areas.select(key, F.posexplode(F.flatten(F.transform(polygons, lambda p: F.transform(
        p, lambda r, i: F.struct(F.when(i == 0, 1).otherwise(-1).alias("sign"), r.alias("r")))))).alias("_i", "_ring"))
    r = F.col("_ring.r")
    twice = F.aggregate(_closed_pairs(r), F.lit(0.0), lambda s, z: s + z["p"]["x"] * z["q"]["y"] - z["q"]["x"] * z["p"]["y"])
    rings = rings.select(key, F.col("_ring.sign").alias("_sign"), r.alias("_r"), F.signum(twice).alias("_turn"))
    fan = rings.select(key, "_sign", "_turn", F.get("_r", F.lit(0)).alias("a"), F.explode(F.slice(
        _closed_pairs(F.col("_r")), 2, F.size("_r"))).alias("_e")).select(key, "_sign", "_turn", "a", F.col("_e.p").alias("b"), F.col("_e.q").alias("c"))
    turn = F.signum(_side(F.col("a"), F.col("b"), F.col("c")))
    fan = fan.withColumn("_t", turn).where("_t <> 0")
    b, c = (F.when(F.col("_t") > 0, F.col(x)).otherwise(F.col(y)) for x, y in (("b", "c"), ("c", "b")))
    fan = fan.select(key, (F.col("_sign") * F.col("_turn") * F.col("_t")).alias("sign"), "a", b.alias("b"), c.alias("c"))
    edge = lambda p, q: F.struct(F.col(p).alias("a"), F.col(q).alias("b"))
    return fan.select(key, "sign", F.array(edge("a", "b"), edge("b", "c"), edge("c", "a")).alias("edges"),
                      *[f("a." + x, "b." + x, "c." + x).alias(n) for f, x, n in (
                          (F.least, "x", "xmin"), (F.greatest, "x", "xmax"), (F.least, "y", "ymin"), (F.greatest, "y", "ymax"))])


BOX = ["xmin", "xmax", "ymin", "ymax"]


def _levelled(boxes: DataFrame, cell: float) -> DataFrame:
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    return boxes.withColumn("_own", F.when(side > cell, F.ceil(F.log2(side / cell))).otherwise(0).cast("int"))


def box_pairs(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Rows of ``left`` and ``right`` (other columns disjoint, each with a box) whose boxes touch, once a
    pair. Boxes sit at the grid level of their own size and meet at the coarser level of the two, where
    each touches four cells at most; the cell of the lower left corner of what they share counts."""
    l, r = _levelled(left, cell), _levelled(right, cell)
    own = F.sort_array(F.collect_set("_own"))
    used = F.array_union(l.agg(own).scalar(), r.agg(own).scalar())      # an entry for each power of two

    def cells(df: DataFrame, tag: str) -> DataFrame:
        df = df.select("*", F.explode(used).alias("_level")).where(F.col("_level") >= F.col("_own"))
        size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_level"))
        for axis in ("x", "y"):
            df = df.withColumn(f"_c{axis}", F.explode(F.sequence(F.floor(F.col(axis + "min") / size), F.floor(F.col(axis + "max") / size))))
        return df.withColumnsRenamed({c: f"{tag}{c}" for c in [*BOX, "_own"]})

    j = cells(l, "l_").join(cells(r, "r_"), ["_level", "_cx", "_cy"])
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_level"))
    j = j.where((F.col("_level") == F.greatest("l__own", "r__own"))
                & (F.col("l_xmin") <= F.col("r_xmax")) & (F.col("r_xmin") <= F.col("l_xmax"))
                & (F.col("l_ymin") <= F.col("r_ymax")) & (F.col("r_ymin") <= F.col("l_ymax"))
                & (F.col("_cx") == F.floor(F.greatest("l_xmin", "r_xmin") / size))
                & (F.col("_cy") == F.floor(F.greatest("l_ymin", "r_ymin") / size)))
    keep = [c for c in left.columns if c not in BOX] + [c for c in right.columns if c not in BOX]
    return j.select(*keep)


def area_weights(sources: DataFrame, targets: DataFrame, cell: float, source_key: str = "source_id",
                 target_key: str = "target_id", polygons: str = "polygons") -> DataFrame:
    """(source, target, area, weight): the area that each pair shares and its part of the source's
    area, for pairs that share any. Where the targets cover a source without overlap, its weights sum to
    one. Both sides may have parts and holes; a source without area has no rows."""
    vertices = F.flatten(F.flatten(F.col(polygons)))
    xs, ys = F.transform(vertices, lambda p: p["x"]), F.transform(vertices, lambda p: p["y"])
    left = sources.select(source_key, F.col(polygons).alias("_shape"), polygons_area(F.col(polygons)).alias("_whole"),
                          F.array_min(xs).alias("xmin"), F.array_max(xs).alias("xmax"), F.array_min(ys).alias("ymin"),
                          F.array_max(ys).alias("ymax")).where("_whole > 0")
    right = signed_triangles(targets, target_key, polygons).withColumnsRenamed({"sign": "_sign", "edges": "_within"})
    pairs = box_pairs(left, right, cell).withColumn("_part", F.col("_sign") * polygons_area(F.col("_shape"), F.col("_within")))
    # A shared border is no shared area; rounding in its triangles is far below this part of the source.
    shared = pairs.groupBy(source_key, target_key).agg(F.sum("_part").alias("area"), F.max("_whole").alias("_whole")).where(
        F.col("area") > F.col("_whole") * 1e-9)
    return shared.select(source_key, target_key, "area", (F.col("area") / F.col("_whole")).alias("weight"))


def interpolate(values: DataFrame, weights: DataFrame, columns: list[str], source_key: str = "source_id",
                target_key: str = "target_id") -> DataFrame:
    """Source counts dealt out to targets by weight and summed (partial per task)."""
    j = values.select(source_key, *columns).join(weights.select(source_key, target_key, "weight"), source_key)
    return j.groupBy(target_key).agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in columns], F.count(F.lit(1)).alias("n_sources"))
