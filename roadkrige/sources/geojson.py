"""GeoJSON in and out, with Spark's own readers and JSON functions.

A feature collection of several blocks is read by several tasks (``collections``),
newline-delimited features (``lines``) split like any text.  Property types are
taken from all features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .collections import read_features

_FEATURE = "struct<geometry:struct<type:string,coordinates:string,geometries:string>,properties:string>"
_PAIRS = "array<array<double>>"
_POINTS = "array<struct<x:double,y:double>>"


def _points(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def _parts(kind: Column, text: Column) -> Column:
    """Lines or rings of any geometry: array<array<struct<x, y>>>."""
    flat, deep, deeper = F.from_json(text, _PAIRS), F.from_json(text, f"array<{_PAIRS}>"), F.from_json(text, f"array<array<{_PAIRS}>>")
    single = F.from_json(text, "array<double>")
    return (
        F.when(kind == "Point", F.array(F.array(F.struct(single[0].alias("x"), single[1].alias("y")))))
        .when(kind.isin("LineString", "MultiPoint"), F.array(_points(flat)))
        .when(kind.isin("MultiLineString", "Polygon"), F.transform(deep, _points))
        .when(kind == "MultiPolygon", F.flatten(F.transform(deeper, lambda q: F.transform(q, _points))))
    )


def _polygons(kind: Column, text: Column) -> Column:
    """Polygons of an areal geometry, each a list of rings; null for others."""
    deep, deeper = F.from_json(text, f"array<{_PAIRS}>"), F.from_json(text, f"array<array<{_PAIRS}>>")
    rings = lambda q: F.transform(q, _points)
    return F.when(kind == "Polygon", F.array(rings(deep))).when(kind == "MultiPolygon", F.transform(deeper, rings))


def _ddl(variant_schema: str) -> str:
    """The schema of a variant as that of JSON: objects are structs, types without a value are text."""
    out = variant_schema.replace("OBJECT<", "STRUCT<")
    out = re.sub(r"\b(VOID|VARIANT)\b", "STRING", out)
    return re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", out)


def read_geojson(spark: SparkSession, path: str, lines: bool = False, properties: str | None = None) -> DataFrame:
    """A column per property, ``gtype``, ``parts`` (lines or rings) and ``polygons`` (rings by polygon)."""
    features = spark.read.text(path) if lines else read_features(spark, path)
    text = features.select(F.from_json("value", _FEATURE).alias("f"))
    # a geometry collection gives a row for each of its members
    members = F.from_json("f.geometry.geometries", "array<struct<type:string,coordinates:string>>")
    own = F.array(F.struct("f.geometry.type", "f.geometry.coordinates"))
    flat = text.select(F.explode(F.coalesce(members, own)).alias("g"), F.col("f.properties").alias("p"))
    rows = flat.select(F.col("g.type").alias("gtype"), _parts(F.col("g.type"), F.col("g.coordinates")).alias("parts"), _polygons(F.col("g.type"), F.col("g.coordinates")).alias("polygons"), "p")
    if properties is None:
        found = rows.agg(F.schema_of_variant_agg(F.try_parse_json("p")).alias("s")).first().s
        properties = _ddl(found) if found and found.startswith("OBJECT<") and found != "OBJECT<>" else ""
    if not properties:
        return rows.drop("p")
    return rows.withColumn("p", F.from_json("p", properties)).select("p.*", "gtype", "parts", "polygons")


def lines_of(df: DataFrame) -> DataFrame:
    """Single-part lines: one row per part of line geometries, other columns repeated."""
    return df.filter(F.col("gtype").isin("LineString", "MultiLineString") & F.col("parts").isNotNull()).withColumn("pts", F.explode("parts")).filter(F.size("pts") > 0).drop("parts", "polygons")


def polygons_of(df: DataFrame) -> DataFrame:
    """Single simple polygons, a row each: its shell and then its holes in ``rings``.

    Rings that cross themselves or one another are split (even-odd); what has
    no area is left out.
    """
    from ..operators.polygons import repaired

    return repaired(df.withColumn("rings", F.explode("polygons")).drop("parts", "polygons"))


def feature_json(df: DataFrame, geometry: str = "pts", kind: str = "LineString") -> DataFrame:
    """One column ``value`` of features; ``geometry`` is a point, a line, or parts."""
    g = F.col(geometry)
    pair = lambda p: F.array(p["x"], p["y"])
    shape = df.schema[geometry].dataType.simpleString()
    depth = shape.count("array<")
    coords = pair(g) if depth == 0 else F.transform(g, pair) if depth == 1 else F.transform(g, lambda part: F.transform(part, pair))
    rest = [F.col(c) for c in df.columns if c != geometry]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), coords.alias("coordinates")).alias("geometry"), F.struct(*rest).alias("properties"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(df: DataFrame, path: str, geometry: str = "pts", kind: str = "LineString", lines: bool = False) -> None:
    """A folder of files: newline-delimited features, or a whole feature collection each."""
    features = feature_json(df, geometry, kind)

    def collection(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            values = [("" if first and i == 0 else ",") + v for i, v in enumerate(batch.column(0).to_pylist())]
            if values:
                head = ['{"type":"FeatureCollection","features":['] if first else []
                first = False
                yield pa.RecordBatch.from_arrays([pa.array(head + values)], names=["value"])
        if not first:
            yield pa.RecordBatch.from_arrays([pa.array(["]}"])], names=["value"])

    (features if lines else features.mapInArrow(collection, "value string")).write.text(path)
