"""Spatial joins and the features made with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.classify import poi_class
from ..functions.geometry import centroid
from ..operators import features as E
from ..operators import polygons as P
from ..operators import spatial as S
from ..operators.match import match_points
from . import fixtures as X
from .fixtures import sql
from .registry import query


def classed(spark, d):
    poi = X.poi(spark, d)
    return poi.select("poi_id", "x", "y", poi_class(poi.columns).alias("l1"))


def centres(spark, d):
    # a generated row is worked out once, where a plain column is again for every filter and column that names it
    return X.roads(spark, d).select("road_id", F.explode(F.array(centroid(F.col("pts")))).alias("c")).select("road_id", F.col("c.x").alias("x"), F.col("c.y").alias("y"))


_FRONT = ", ".join(f"count(*) FILTER (d2 < 400 AND l1 = '{c}') AS front20_{c}" for c in E.CLASSES)
_SUM = " + ".join(f"coalesce(front20_{c}, 0)" for c in E.CLASSES)


@query(
    sql("pairs", "segs")
    + f""", c AS (SELECT road_id, {_FRONT} FROM pairs GROUP BY road_id)
    SELECT road_id, len AS length_m, {", ".join(f"coalesce(front20_{c}, 0) AS front20_{c}" for c in E.CLASSES)}, ({_SUM})::DOUBLE AS front20_total,
        {", ".join(f"100 * coalesce(front20_{c}, 0) / len AS front20_{c}_per100m" for c in E.CLASSES)}, 100 * ({_SUM}) / len AS front20_total_per100m
    FROM segs LEFT JOIN c USING (road_id)"""
)
def frontage_pivot(spark, d):
    return E.frontage(X.roads(spark, d), classed(spark, d))


def _density_sql() -> str:
    counts = ", ".join(f"count(*) FILTER (d2 < {r * r} AND l1 = '{c}') AS n{r}_{c}" for r in E.DENSITY_RADII for c in E.CLASSES)
    area = lambda r: f"((2 * {float(r)}::DOUBLE * len + {3.141592653589793 * r * r!r}::DOUBLE) / 1e6)"
    out = [f"round(coalesce(n{r}_{c}, 0) / {area(r)}, 6) AS dens{r}_{c}_kmp2" for r in E.DENSITY_RADII for c in E.CLASSES]
    out += [f"round(({' + '.join(f'coalesce(n{r}_{c}, 0)' for c in E.CLASSES)}) / {area(r)}, 6) AS dens{r}_total_kmp2" for r in E.DENSITY_RADII]
    return sql("pairs", "segs") + f", c AS (SELECT road_id, {counts} FROM pairs GROUP BY road_id) SELECT road_id, {', '.join(out)} FROM segs LEFT JOIN c USING (road_id)"


@query(_density_sql())
def poi_density_multi_radius(spark, d):
    out = E.poi_density(X.roads(spark, d), classed(spark, d))
    return out.select("road_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "road_id"])


_CLIP = """SELECT a.road_id, sum(CASE WHEN disc > 0 AND t1 > t0 THEN (t1 - t0) * sqrt(qa) ELSE 0 END) AS m FROM segs a JOIN segs b
        ON b.cx BETWEEN a.cx - 400 AND a.cx + 400 AND b.cy BETWEEN a.cy - 400 AND a.cy + 400,
        LATERAL (SELECT (b.x2 - b.x1) * (b.x2 - b.x1) + (b.y2 - b.y1) * (b.y2 - b.y1) AS qa, 2 * ((b.x1 - a.cx) * (b.x2 - b.x1) + (b.y1 - a.cy) * (b.y2 - b.y1)) AS qb,
            (b.x1 - a.cx) * (b.x1 - a.cx) + (b.y1 - a.cy) * (b.y1 - a.cy) - 90000.0 AS qc) q,
        LATERAL (SELECT qb * qb - 4 * qa * qc AS disc) dd,
        LATERAL (SELECT greatest(0, (-qb - sqrt(greatest(disc, 0))) / (2 * qa)) AS t0, least(1, (-qb + sqrt(greatest(disc, 0))) / (2 * qa)) AS t1) tt
        GROUP BY a.road_id"""


@query(
    sql("segs")
    + f""", m AS ({_CLIP}) SELECT road_id, len AS seg_len_m, round(coalesce(m, 0), 5) AS road_length_in_R_m,
    round(coalesce(m, 0) / 1000 / (pi() * 90000 / 1e6), 5) AS road_density FROM segs LEFT JOIN m USING (road_id)"""
)
def road_density_r300(spark, d):
    out = E.road_density(X.roads(spark, d))
    return out.select("road_id", "seg_len_m", F.round("road_length_in_R_m", 5).alias("road_length_in_R_m"), F.round("road_density", 5).alias("road_density"))


def _near_sql() -> str:
    best = ", ".join(f"round(sqrt(min(d2) FILTER (l1 = '{c}')), 6) AS dist_{c}_m" for c in E.NEAREST_CLASSES)
    return sql("segs", "classed") + f"""SELECT s.road_id, {best} FROM segs s, classed p,
        LATERAL (SELECT least(1, greatest(0, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t) tt,
        LATERAL (SELECT (p.x - (x1 + t * (x2 - x1))) * (p.x - (x1 + t * (x2 - x1))) + (p.y - (y1 + t * (y2 - y1))) * (p.y - (y1 + t * (y2 - y1))) AS d2) dd GROUP BY s.road_id"""


@query(_near_sql())
def nearest_poi_by_class(spark, d):
    out = E.nearest_by_class(X.roads(spark, d), classed(spark, d))
    return out.select("road_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "road_id"])


@query(sql("segs", "poi") + """SELECT poi_id, min_by(road_id, (d2, road_id)) AS road_id, round(sqrt(min(d2)), 6) AS distance_m FROM segs s, poi p,
        LATERAL (SELECT least(1, greatest(0, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t) tt,
        LATERAL (SELECT (p.x - (x1 + t * (x2 - x1))) * (p.x - (x1 + t * (x2 - x1))) + (p.y - (y1 + t * (y2 - y1))) * (p.y - (y1 + t * (y2 - y1))) AS d2) dd WHERE d2 <= 2500 GROUP BY poi_id""")
def map_match_top1(spark, d):
    points = X.poi(spark, d).select("poi_id", "x", "y", F.lit("road").alias("road_name"))
    roads = X.roads(spark, d).withColumn("name", F.lit("A Road"))
    return match_points(points, roads, "poi_id").select("poi_id", "road_id", F.round("distance_m", 6).alias("distance_m"))


@query(sql("segs") + "SELECT a.road_id, count(*) AS density FROM segs a JOIN segs b ON (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= 90000 GROUP BY 1")
def centroid_count_300(spark, d):
    return S.radius_count(centres(spark, d), "road_id", 300.0).withColumnRenamed("n", "density")


@query(sql("segs") + """SELECT a.road_id AS a, b.road_id AS b, round(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)), 6) AS w
    FROM segs a JOIN segs b ON a.road_id < b.road_id AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= 250000""")
def virtual_links_500(spark, d):
    return S.radius_pairs(centres(spark, d), "road_id", 500.0).select("a", "b", F.round(F.sqrt("d2"), 6).alias("w"))


_POP = "zp AS (SELECT zone_id, x0, y0, x1 AS zx1, y1 AS zy1, coalesce(value, 0) AS population FROM zones JOIN raster ON row = 4 - zone_id // 5 AND col = zone_id % 5)"


@query(sql("segs", "zones", "raster", more=_POP) + """, c AS (SELECT road_id, population, greatest(0, least(greatest(x1, x2), zx1) - greatest(least(x1, x2), x0)) + greatest(0, least(greatest(y1, y2), zy1) - greatest(least(y1, y2), y0)) AS m
        FROM segs JOIN zp ON greatest(x1, x2) >= x0 AND least(x1, x2) <= zx1 AND greatest(y1, y2) >= y0 AND least(y1, y2) <= zy1)
    SELECT road_id, round(coalesce(sum(population * m) / nullif(sum(m), 0), 0), 6) AS population FROM segs LEFT JOIN c USING (road_id) GROUP BY road_id""")
def population_wmean(spark, d):
    side = X.lattice_size(spark, d) * X.BLOCK / X.N_BOXES
    mid = X.zones(spark, d).withColumns({"x": (F.col("x0") + F.col("x1")) / 2, "y": (F.col("y0") + F.col("y1")) / 2})
    zones = E.zone_population(mid, X.raster(spark, d), x_min=0.0, y_max=side * X.N_BOXES, pixel=side)
    out = E.population_by_road(X.roads(spark, d), zones.select("x0", "y0", "x1", "y1", "population"), side)
    return out.select("road_id", F.round("population", 6).alias("population"))


@query(sql("zones", "raster") + "SELECT zone_id, value FROM zones JOIN raster ON row = 4 - zone_id // 5 AND col = zone_id % 5")
def raster_sample(spark, d):
    side = X.lattice_size(spark, d) * X.BLOCK / X.N_BOXES
    at = X.zones(spark, d).select("zone_id", F.floor(((F.col("x0") + F.col("x1")) / 2) / side).cast("int").alias("col"), F.floor((side * 5 - (F.col("y0") + F.col("y1")) / 2) / side).cast("int").alias("row"))
    return at.join(X.raster(spark, d), ["row", "col"]).select("zone_id", "value")


@query(sql("zones", "raster") + """SELECT a.zone_id, round(avg(value), 6) AS zone_mean FROM zones a JOIN zones b ON b.zone_id % 5 BETWEEN a.zone_id % 5 AND a.zone_id % 5 + 1
    AND b.zone_id // 5 BETWEEN a.zone_id // 5 AND a.zone_id // 5 + 1 JOIN raster ON row = 4 - b.zone_id // 5 AND col = b.zone_id % 5 GROUP BY 1""")
def raster_zonal_mean(spark, d):
    side = X.lattice_size(spark, d) * X.BLOCK / X.N_BOXES
    wide = X.zones(spark, d).withColumns({"x1": F.col("x1") + side, "y1": F.col("y1") + side})
    return E.zonal_mean(wide, X.raster(spark, d), 0.0, side * X.N_BOXES, side).select("zone_id", F.round("zone_mean", 6).alias("zone_mean"))


_INSIDE = """m AS (SELECT road_id, zone_id, sum(sign * CASE WHEN y1 = y2 THEN (y1 BETWEEN by0 AND by1)::INT * greatest(0, least(x2, bx1) - greatest(x1, bx0))
        ELSE (x1 BETWEEN bx0 AND bx1)::INT * greatest(0, least(y2, by1) - greatest(y1, by0)) END) AS m FROM segs, boxes GROUP BY 1, 2)"""


@query(sql("segs", "boxes", more=_INSIDE) + "SELECT road_id, zone_id, round(m, 6) AS m FROM m WHERE m > 1e-9")
def polygon_overlay(spark, d):
    """Length of each road inside concave polygons with holes."""
    inside = P.line_overlay(X.roads(spark, d), X.shapes(spark, d), X.BLOCK * 4.0, "road_id", "zone_id")
    return inside.filter("m > 1e-9").withColumn("m", F.round("m", 6))


@query(sql("segs", "boxes", more=_INSIDE) + "SELECT road_id, round(coalesce(sum(40 * zone_id * m) / nullif(sum(m), 0), 0), 6) AS population FROM segs LEFT JOIN m USING (road_id) GROUP BY road_id")
def polygon_wmean(spark, d):
    zones = X.shapes(spark, d).withColumn("population", 40.0 * F.col("zone_id"))
    out = E.population_by_road(X.roads(spark, d), zones, X.BLOCK * 4.0, boxes=False)
    return out.select("road_id", F.round("population", 6).alias("population"))


@query(sql("boxes") + """, px AS (SELECT 100 * ((p_partkey // 2) % g) + 50 AS x, 100 * ((p_partkey // 2) // g) + 50 AS y, (p_partkey % 97)::DOUBLE AS value FROM part, g WHERE p_partkey % 2 = 0 AND p_partkey % 11 <> 0),
    hit AS (SELECT zone_id, x, y, value FROM boxes JOIN px ON x > bx0 AND x < bx1 AND y > by0 AND y < by1 GROUP BY ALL HAVING sum(sign) > 0)
    SELECT zone_id, round(avg(value), 6) AS mean, count(*) AS n FROM hit GROUP BY zone_id""")
def polygon_mask_mean(spark, d):
    """Mean of the pixels whose centres lie in concave polygons with holes."""
    top = float(X.lattice_size(spark, d) * X.BLOCK)
    return P.mask_mean(X.shapes(spark, d), X.block_pixels(spark, d), "zone_id", 0.0, top, float(X.BLOCK)).withColumn("mean", F.round("mean", 6))


@query(sql("roads") + """SELECT a.road_id // 2 AS corner, r, round(400 * r + pi() * r * r + r * r * (pi() / 4 - 1), 6) AS area
    FROM roads a JOIN roads b ON b.road_id = a.road_id + 1, (VALUES (20), (60)) v(r) WHERE a.road_id % 2 = 0""")
def buffer_area_bent(spark, d):
    """Area around lines with a right angle: the roads of a block's corner, walked through it."""
    side = lambda k: X.roads(spark, d).filter(f"road_id % 2 = {k}").select(F.expr("road_id div 2").alias("corner"), F.col("pts").alias(f"p{k}"))
    both = side(0).join(side(1), "corner").select("corner", F.concat(F.reverse("p0"), F.slice("p1", 2, 1)).alias("pts"))
    each = [both.select("corner", F.lit(r).alias("r"), F.round(P.line_buffer_area(F.col("pts"), float(r)), 6).alias("area")) for r in (20, 60)]
    return X.union_all(each)


@query(sql("zones") + """SELECT zone_id, 1 AS n_rings, round(400.0 * g * g / 4, 4) AS area FROM zones, g, range(2)
    UNION ALL SELECT zone_id, 2, round(0.66 * 324 * g * g, 4) FROM zones, g""")
def polygon_repair(spark, d):
    """Self-crossing rings and rings with holes as simple polygons."""
    simple = P.repaired(X.bow_ties(spark, d).unionByName(X.shapes(spark, d)))
    return simple.select("zone_id", F.size("rings").alias("n_rings"), F.round(P.polygon_area(F.col("rings")), 4).alias("area"))


@query(sql("segs") + """, n AS (SELECT x1 AS x, y1 AS y FROM segs UNION SELECT x2, y2 FROM segs), k AS (SELECT x, y, row_number() OVER (ORDER BY x, y) - 1 AS node_id FROM n)
    SELECT road_id, min_by(node_id, ((cx - x) * (cx - x) + (cy - y) * (cy - y), node_id)) AS node_id, sqrt(min((cx - x) * (cx - x) + (cy - y) * (cy - y))) AS distance
    FROM segs JOIN k ON x BETWEEN cx - 120 AND cx + 120 AND y BETWEEN cy - 120 AND cy + 120 GROUP BY road_id""")
def snap_nearest_node(spark, d):
    from ..operators.network import line_edges, nodes_of, snap

    nodes = nodes_of(line_edges(X.roads(spark, d)))
    return snap(centres(spark, d), nodes, "road_id").select("road_id", "node_id", "distance")
