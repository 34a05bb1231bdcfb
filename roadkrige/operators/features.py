"""Road features: points of interest around roads, road density, population."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import CLASSES
from ..functions.geometry import centroid, clip_to_box, length, pieces
from ..functions.numbers import per_100m, row_sum
from ..functions.projections import transform
from .polygons import line_buffer_area, weighted_mean
from .spatial import box_join, lines_in_circles, nearest_join, within_join

# Radii in metres and the classes that get a distance.
FRONTAGE_M = 20.0
DENSITY_RADII = (100, 300, 800)
NEAREST_CLASSES = ("transport", "retail", "food", "education", "health")
ROAD_DENSITY_RADIUS = 300.0


def class_counts(roads: DataFrame, poi: DataFrame, radii: dict[str, float], road_id: str = "road_id") -> DataFrame:
    """Per road and prefix: ``{prefix}_{class}`` counts of points strictly within a radius.

    One join at the largest radius serves all; the class list is fixed, so the
    schema does not depend on the data.  Roads without points get zeros.
    """
    pairs = within_join(roads.select(road_id, "pts"), poi.select("x", "y", "l1"), max(radii.values()), strict=True)
    # pairs are counted by class and ring first, so that the distance is looked at once a pair
    rings = sorted(set(radii.values()))
    ring = F.lit(len(rings))
    for i, r in reversed(list(enumerate(rings))):
        ring = F.when(F.col("d2") < r * r, i).otherwise(ring)
    ringed = pairs.groupBy(road_id, "l1", ring.alias("_ring")).agg(F.count(F.lit(1)).alias("_n"))
    counts = [
        F.sum(F.when((F.col("_ring") <= rings.index(r)) & (F.col("l1") == c), F.col("_n")).otherwise(0)).alias(f"{prefix}_{c}")
        for prefix, r in radii.items()
        for c in CLASSES
    ]
    table = ringed.groupBy(road_id).agg(*counts)
    names = [f"{prefix}_{c}" for prefix in radii for c in CLASSES]
    joined = roads.select(road_id, "pts").join(table.hint("merge"), road_id, "left")
    return joined.select(road_id, "pts", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def frontage(roads: DataFrame, poi: DataFrame, road_id: str = "road_id", radius: float = FRONTAGE_M) -> DataFrame:
    """front20_{class}, their total and each per 100 m of road."""
    counted = class_counts(roads, poi, {"front20": radius}, road_id)
    names = [f"front20_{c}" for c in CLASSES]
    total = counted.withColumn("front20_total", row_sum(counted, names))
    m = length(F.col("pts"))
    return total.select(
        road_id, m.alias("length_m"), *names, "front20_total", *[per_100m(F.col(n), m).alias(f"{n}_per100m") for n in [*names, "front20_total"]]
    )


def poi_density(roads: DataFrame, poi: DataFrame, road_id: str = "road_id", radii: tuple[int, ...] = DENSITY_RADII) -> DataFrame:
    """dens{R}_{class}_kmp2 and totals: counts over the area within R of the road."""
    counted = class_counts(roads, poi, {f"dens{r}": float(r) for r in radii}, road_id)
    out = [F.col(road_id)]
    for r in radii:
        area = line_buffer_area(F.col("pts"), float(r)) / 1e6
        names = [f"dens{r}_{c}" for c in CLASSES]
        out += [(F.col(n) / area).alias(f"{n}_kmp2") for n in names]
        out.append((row_sum(counted, names) / area).alias(f"dens{r}_total_kmp2"))
    return counted.select(*out)


def nearest_by_class(roads: DataFrame, poi: DataFrame, road_id: str = "road_id", classes: tuple[str, ...] = NEAREST_CLASSES) -> DataFrame:
    """dist_{class}_m of each road; null where a class has no point."""
    asked = roads.select(road_id, "pts", F.explode(F.array(*map(F.lit, classes))).alias("l1"))
    points = poi.filter(F.col("l1").isin(*classes)).select(F.col("poi_id"), "x", "y", "l1")
    found = nearest_join(asked, points, road_id, "poi_id", on=("l1",))
    table = found.groupBy(road_id).agg(*[F.min(F.when(F.col("l1") == c, F.col("distance"))).alias(f"dist_{c}_m") for c in classes])
    return roads.select(road_id).join(table.hint("merge"), road_id, "left")


def road_density(segments: DataFrame, seg_id: str = "road_id", radius: float = ROAD_DENSITY_RADIUS, include_self: bool = True) -> DataFrame:
    """Road length within ``radius`` of each segment's centroid, and km per square km."""
    # a file's segments are few bytes and much work: as they are read they would be put into a task for each of its row groups
    dealt = segments.select(F.col(seg_id).alias("_seg"), "pts").repartition(4 * segments.sparkSession.sparkContext.defaultParallelism, "_seg")
    # a generated row is worked out once, where a plain column is again for every filter and column that names it
    measured = dealt.select("_seg", F.explode(F.array(F.struct(centroid(F.col("pts")).alias("c"), length(F.col("pts")).alias("m")))).alias("_m"))
    centres = measured.select(F.col("_seg").alias("_centre"), F.col("_m.c.x").alias("x"), F.col("_m.c.y").alias("y"))
    inside = lines_in_circles(dealt, centres, radius)
    if not include_self:
        inside = inside.filter(~F.col("_seg").eqNullSafe(F.col("_centre")))
    total = inside.groupBy("_centre").agg(F.sum("clip_m").alias("_sum"))
    area = math.pi * radius * radius / 1e6
    m = F.coalesce("_sum", F.lit(0.0))
    joined = measured.select("_seg", F.col("_m.m").alias("seg_len_m")).join(total.hint("merge"), F.col("_seg") == F.col("_centre"), "left")
    return joined.select(F.col("_seg").alias(seg_id), "seg_len_m", m.alias("road_length_in_R_m"), (m / 1000 / area).alias("road_density"))


def raster_value(points: DataFrame, pixels: DataFrame, info, epsg: int, x: str = "x", y: str = "y") -> DataFrame:
    """``points`` of system ``epsg`` with the ``value`` of the pixel they lie in, in the raster's own system.

    ``info`` is the raster's row of ``raster_info``; a raster without a code is in ``epsg`` itself.
    A point outside it, on no data or without a place has a null.
    """
    at = transform(F.col(x), F.col(y), epsg, info["epsg"] or epsg)
    col, row = F.floor((F.col("_p.x") - info["x_min"]) / info["pixel_x"]), F.floor((info["y_max"] - F.col("_p.y")) / info["pixel_y"])
    placed = points.withColumn("_p", at).withColumns({"_row": row, "_col": col}).drop("_p")
    return placed.join(pixels.select(F.col("row").alias("_row"), F.col("col").alias("_col"), "value"), ["_row", "_col"], "left").drop("_row", "_col")


def zone_population(zones: DataFrame, pixels: DataFrame, x: str = "x", y: str = "y", x_min: float = 0.0, y_max: float = 0.0, pixel: float = 1.0) -> DataFrame:
    """The raster value under each zone's point, else the mean of its box's pixels, else 0."""
    col, row = F.floor((F.col(x) - x_min) / pixel).cast("int"), F.floor((y_max - F.col(y)) / pixel).cast("int")
    at = zones.withColumns({"_row": row, "_col": col})
    values = pixels.select(F.col("row").alias("_row"), F.col("col").alias("_col"), "value")
    sampled = at.join(values, ["_row", "_col"], "left").drop("_row", "_col")
    mean = zonal_mean(zones, pixels, x_min, y_max, pixel).select("zone_id", F.col("zone_mean").alias("_mean"))
    return sampled.join(mean, "zone_id", "left").withColumn("population", F.coalesce("value", "_mean", F.lit(0.0))).drop("value", "_mean")


def zonal_mean(zones: DataFrame, pixels: DataFrame, x_min: float, y_max: float, pixel: float) -> DataFrame:
    """Mean of the pixels whose centres lie in each box zone; no value, no weight."""
    low = lambda v: F.ceil(v - 0.5).cast("int")
    cols = F.sequence(low((F.col("x0") - x_min) / pixel), low((F.col("x1") - x_min) / pixel))
    rows = F.sequence(low((y_max - F.col("y1")) / pixel), low((y_max - F.col("y0")) / pixel))
    cells = zones.select("zone_id", "x0", "y0", "x1", "y1", F.explode(cols).alias("col"), rows.alias("_rows")).select("*", F.explode("_rows").alias("row"))
    px, py = x_min + (F.col("col") + 0.5) * pixel, y_max - (F.col("row") + 0.5) * pixel
    inside = cells.filter((px >= F.col("x0")) & (px < F.col("x1")) & (py >= F.col("y0")) & (py < F.col("y1")))
    return inside.join(pixels, ["row", "col"]).groupBy("zone_id").agg(F.avg("value").alias("zone_mean"))


def population_by_road(roads: DataFrame, zones: DataFrame, cell: float, road_id: str = "road_id", boxes: bool = True) -> DataFrame:
    """Length-weighted mean of the zones' population along each road; 0 outside all zones.

    ``zones`` have x0, y0, x1, y1 or, where not ``boxes``, ``zone_id`` and the ``rings`` of a polygon.
    """
    if not boxes:
        return weighted_mean(roads, zones, cell, road_id, "zone_id", "population")
    pairs = box_join(roads.select(road_id, "pts"), zones, cell)

    def part(s):
        return clip_to_box(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"], F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))

    clipped = F.aggregate(F.transform(pieces(F.col("pts")), part), F.lit(0.0), lambda a, v: a + v)
    mean = pairs.withColumn("_m", clipped).filter("_m > 0").groupBy(road_id).agg(F.try_divide(F.sum(F.col("population") * F.col("_m")), F.sum("_m")).alias("population"))
    return roads.select(road_id).join(mean, road_id, "left").withColumn("population", F.coalesce("population", F.lit(0.0)))
