"""GeoJSON features as rows: properties as declared columns, geometry as polygons.

A polygon is an array of rings (the outline, then its holes), an area an array of polygons. Feature
sequences (a feature a line) are read in splits of any file size; a feature collection is one JSON
document, read whole by a task. Every feature gives a row: one that can't be read has no polygons
and an ``error`` that says why, so good rows and bad rows add up to the features in the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = "struct<x:double,y:double>"
POLYGONS = f"array<array<array<{POINT}>>>"
_RAW = "_corrupt_record"


def _feature_type(properties: T.StructType) -> T.StructType:
    geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
    return T.StructType([T.StructField("type", T.StringType()), T.StructField("properties", properties),
                         T.StructField("geometry", geometry)])


def _positions(rings: Column) -> Column:
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(
        F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))


def _flaw(polygons: Column) -> Column:
    """Why polygons are no area; null if they are."""
    rings = F.flatten(polygons)
    short = F.exists(rings, lambda r: F.size(r) < 4)
    odd = F.exists(rings, lambda r: F.exists(r, lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"])
                                             | (F.abs(p["x"]) == float("inf")) | (F.abs(p["y"]) == float("inf"))))
    open_ring = F.exists(rings, lambda r: F.get(r, F.lit(0)) != F.element_at(r, -1))
    empty = (F.size(polygons) == 0) | F.exists(polygons, lambda p: F.size(p) == 0)
    return (F.when(polygons.isNull() | rings.isNull() | F.exists(rings, lambda r: r.isNull()), "bad coordinates").when(empty, "no rings")
            .when(short, "ring of fewer than 4 positions").when(odd, "bad position").when(open_ring, "ring not closed"))


def _rows(features: DataFrame, properties: T.StructType) -> DataFrame:
    """``f`` (feature struct) and ``broken`` (unreadable text) to property columns, polygons, error."""
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    one = F.from_json(text, "array<array<array<double>>>")
    many = F.from_json(text, "array<array<array<array<double>>>>")
    polygons = F.when(kind == "Polygon", F.when(one.isNotNull(), F.array(_positions(one)))).when(
        kind == "MultiPolygon", F.transform(many, _positions)).cast(POLYGONS)
    df = features.withColumn("_polygons", polygons)
    error = (F.when(F.col("broken"), "unparsable feature")
             .when(~F.col("f.type").eqNullSafe(F.lit("Feature")), "not a feature")
             .when(F.col("f.geometry").isNull() | kind.isNull(), "no geometry")
             .when(~kind.isin("Polygon", "MultiPolygon"), F.concat(F.lit("geometry type "), kind))
             .otherwise(_flaw(F.col("_polygons"))))
    df = df.withColumn("error", error)
    return df.select(*[F.col(f"f.properties.{n}").alias(n) for n in properties.fieldNames()],
                     F.when(F.col("error").isNull(), F.col("_polygons")).alias("polygons"), "error")


def read_feature_sequence(spark: SparkSession, path: str, properties: str | T.StructType) -> DataFrame:
    """Features a line (record separators before them are allowed, blank lines are none)."""
    props = T._parse_datatype_string(properties) if isinstance(properties, str) else properties
    schema = _feature_type(props).add(_RAW, T.StringType())
    line = F.btrim(F.col("value"), F.lit("\x1e \t\r"))
    parsed = spark.read.text(path).where(line != "").select(F.from_json(
        line, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW}).alias("f"))
    return _rows(parsed.withColumn("broken", F.col(f"f.{_RAW}").isNotNull()), props)


def read_feature_collections(spark: SparkSession, path: str, properties: str | T.StructType) -> DataFrame:
    """Files that each hold one feature collection; a file that is none gives one bad row."""
    props = T._parse_datatype_string(properties) if isinstance(properties, str) else properties
    schema = T.StructType([T.StructField("features", T.ArrayType(_feature_type(props))), T.StructField(_RAW, T.StringType())])
    files = spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", _RAW).schema(schema).json(path)
    broken = F.col(_RAW).isNotNull() | F.col("features").isNull()
    return _rows(files.select(broken.alias("broken"), F.explode_outer(F.when(~broken, F.col("features"))).alias("f")).where(
        F.col("broken") | F.col("f").isNotNull()), props)


def feature_text(properties: Column, polygons: Column) -> Column:
    """A feature as JSON text: one polygon as such, several as a multipolygon, none as null."""
    rings = F.transform(polygons, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.array(q["x"], q["y"]))))
    several = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), rings.alias("coordinates")))
    single = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(rings, F.lit(0)).alias("coordinates")))
    geometry = F.when(polygons.isNull(), "null").when(F.size(polygons) == 1, single).otherwise(several)
    return F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(properties), F.lit(',"geometry":'), geometry, F.lit("}"))


def write_feature_sequence(features: DataFrame, path: str, polygons: str = "polygons") -> str:
    """Rows as a feature sequence; all other columns become properties."""
    props = F.struct(*[c for c in features.columns if c != polygons])
    features.select(feature_text(props, F.col(polygons)).alias("value")).write.mode("overwrite").text(path)
    return path


def area(polygons: Column) -> Column:
    """Outlines minus holes, by the shoelace rule."""
    def ring_area(ring: Column) -> Column:
        pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))
        twice = F.aggregate(pairs, F.lit(0.0), lambda s, z: s + z["a"]["x"] * z["b"]["y"] - z["b"]["x"] * z["a"]["y"])
        return F.abs(twice) / 2

    def polygon_area(p: Column) -> Column:
        holes = F.aggregate(F.slice(p, 2, F.size(p)), F.lit(0.0), lambda s, r: s + ring_area(r))
        return ring_area(F.get(p, F.lit(0))) - holes

    return F.aggregate(polygons, F.lit(0.0), lambda s, p: s + polygon_area(p))
