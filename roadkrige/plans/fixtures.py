"""Road-network tables derived from the star-schema tables by integer arithmetic.

Roads lie on a street lattice with 100 m blocks; every table comes with the
SQL that makes the same rows, so that queries can be checked against it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import line

BLOCK = 100
ROAD_TYPES = ("motorway", "trunk_link", "primary", "secondary", "tertiary_link", "residential", "service", "path")
AMENITIES = ("bus_stop", "marketplace", "cafe", "school", "pharmacy", None, "place_of_worship", None, None, "bank", "laundry", None)
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
N_BOXES = 5


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lattice_size(spark: SparkSession, sf_dir: str) -> int:
    """Blocks along one side of the lattice, computed once so that plans hold a literal."""
    return max(1, math.ceil(math.sqrt(read(spark, sf_dir, "part").count() / 2)))


def pick(values: tuple, index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index + 1).cast("int"))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, k = lattice_size(spark, sf_dir), F.col("p_partkey")
    half = F.expr("p_partkey div 2")
    i, j = half % g, F.expr(f"(p_partkey div 2) div {g}")
    x, y = (i * BLOCK).cast("double"), (j * BLOCK).cast("double")
    across = k % 2 == 0
    end_x, end_y = x + F.when(across, BLOCK).otherwise(0), y + F.when(across, 0).otherwise(BLOCK)
    return read(spark, sf_dir, "part").select(
        k.alias("road_id"),
        k.alias("osm_id"),
        F.col("p_name").alias("name"),
        F.when(k % 17 != 0, pick(ROAD_TYPES, k % 8)).alias("type"),
        F.when(k % 13 == 0, None).when(k % 29 == 0, "signals").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" km/h"))).alias("maxspeed"),
        line((x, y), (end_x, end_y)).alias("pts"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts; ids repeat and lie on every fifth road."""
    return read(spark, sf_dir, "lineitem").filter("l_partkey % 5 = 0").select(
        F.col("l_partkey").alias("osm_id"), F.when(F.col("l_linenumber") % 7 != 0, F.col("l_quantity") * 1000).alias("aadt")
    )


def poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    width, k = lattice_size(spark, sf_dir) * BLOCK, F.col("c_custkey")
    tag = lambda name, cond, value: F.when(cond, F.lit(value)).cast("string").alias(name)
    return read(spark, sf_dir, "customer").select(
        k.alias("poi_id"),
        ((k * 7919) % width).cast("double").alias("x"),
        ((k * 104729 + 37) % width).cast("double").alias("y"),
        pick(AMENITIES, k % 12).alias("amenity"),
        tag("shop", k % 31 == 0, "Books"),
        tag("tourism", k % 12 == 5, "hotel"),
        tag("leisure", k % 12 == 7, " Park "),
        tag("office", k % 41 == 0, "lawyer"),
        tag("public_transport", k % 43 == 0, "platform"),
        tag("railway", k % 47 == 0, "halt"),
        tag("landuse", k % 12 == 8, "industrial"),
        tag("man_made", k % 53 == 0, "works"),
        tag("category", k % 59 == 0, "food"),
        F.lit(None).cast("string").alias("fclass"),
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square zones, N_BOXES by N_BOXES over the lattice, as boxes and rings."""
    side = lattice_size(spark, sf_dir) * BLOCK / N_BOXES
    k = F.col("n_nationkey").cast("long")
    col, row = k % N_BOXES, F.expr(f"n_nationkey div {N_BOXES}")
    x0, y0 = col * F.lit(side), row * F.lit(side)
    boxes = read(spark, sf_dir, "nation").select(
        k.alias("zone_id"), x0.alias("x0"), y0.alias("y0"), (x0 + F.lit(side)).alias("x1"), (y0 + F.lit(side)).alias("y1")
    )
    ring = line(("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))
    return boxes.withColumn("ring", ring)


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pixel a zone, row 0 at the top; one pixel has no value."""
    k = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(
        (F.lit(N_BOXES - 1) - F.expr(f"n_nationkey div {N_BOXES}")).cast("int").alias("row"),
        (k % N_BOXES).cast("int").alias("col"),
        F.when(k != 7, k * 40.0).alias("value"),
    )


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corner with a square hole in each zone, off the lattice; as rings, holes after the shell."""
    side = lattice_size(spark, sf_dir) * BLOCK / N_BOXES
    s = F.lit(0.9 * side)
    at = lambda *steps: line(*[(F.col("x0") + 13.3 + s * a, F.col("y0") + 13.3 + s * b) for a, b in steps])
    shell = at((0, 0), (1, 0), (1, 1), (0.5, 1), (0.5, 0.5), (0, 0.5), (0, 0))
    hole = at((0.6, 0.1), (0.9, 0.1), (0.9, 0.4), (0.6, 0.4), (0.6, 0.1))
    return zones(spark, sf_dir).select("zone_id", F.array(shell, hole).alias("rings"))


def bow_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring that crosses itself in each zone."""
    ring = line(("x0", "y0"), ("x1", "y1"), ("x1", "y0"), ("x0", "y1"), ("x0", "y0"))
    return zones(spark, sf_dir).select("zone_id", F.array(ring).alias("rings"))


def block_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel for each block of the lattice that has a road along its lower side; row 0 at the top; some have no value."""
    g, k = lattice_size(spark, sf_dir), F.col("p_partkey")
    return read(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(
        (F.lit(g - 1) - F.expr(f"(p_partkey div 2) div {g}")).cast("int").alias("row"),
        (F.expr("p_partkey div 2") % g).cast("int").alias("col"),
        F.when(k % 11 != 0, (k % 97).cast("double")).alias("value"),
    )


def count_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as a count workbook has them: merged cells leave nulls below their first row."""
    k = F.col("event_id")
    spot = F.concat(
        (F.lit(13) + (k % 100) / 1000.0).cast("decimal(8,3)").cast("string"), F.lit(", "), (F.lit(100) + (k % 77) / 1000.0).cast("decimal(8,3)").cast("string")
    )
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("counts_"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".xlsx")).alias("file"),
        k.alias("rownum"),
        F.when(k % 4 == 0, F.concat(F.lit(" Road​ "), F.col("event_type"), F.lit(" "), (k % 9).cast("string"))).alias("road_name"),
        F.when(k % 4 == 0, spot).alias("latlon"),
        F.when(k % 3 != 0, F.col("value")).alias("aadt"),
    )


def paired_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-part geometries: roads 2i and 2i + 1 as the parts of one id."""
    numbered = roads(spark, sf_dir).withColumn("pair", F.expr("road_id div 2"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("road_id", "pts"))), lambda p: p["pts"])
    return numbered.groupBy("pair").agg(parts.alias("parts")).select(F.col("pair").alias("osm_id"), "parts")


_SQL = {
    "g": "g AS (SELECT greatest(1, ceil(sqrt(count(*) / 2.0)))::BIGINT AS g FROM part)",
    "roads": """roads AS (
        SELECT p_partkey AS road_id, p_partkey AS osm_id, p_name AS name,
               CASE WHEN p_partkey % 17 <> 0 THEN (['motorway','trunk_link','primary','secondary','tertiary_link','residential','service','path'])[p_partkey % 8 + 1] END AS type,
               CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN 'signals' ELSE p_size || ' km/h' END AS maxspeed,
               (100 * ((p_partkey // 2) % g))::DOUBLE AS x1, (100 * ((p_partkey // 2) // g))::DOUBLE AS y1,
               (100 * ((p_partkey // 2) % g) + CASE WHEN p_partkey % 2 = 0 THEN 100 ELSE 0 END)::DOUBLE AS x2,
               (100 * ((p_partkey // 2) // g) + CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 100 END)::DOUBLE AS y2
        FROM part, g)""",
    "obs": """obs AS (
        SELECT l_partkey AS osm_id, CASE WHEN l_linenumber % 7 <> 0 THEN l_quantity * 1000 END AS aadt
        FROM lineitem WHERE l_partkey % 5 = 0)""",
    "poi": """poi AS (
        SELECT c_custkey AS poi_id, ((c_custkey * 7919) % (100 * g))::DOUBLE AS x, ((c_custkey * 104729 + 37) % (100 * g))::DOUBLE AS y,
               (['bus_stop','marketplace','cafe','school','pharmacy',NULL,'place_of_worship',NULL,NULL,'bank','laundry',NULL])[c_custkey % 12 + 1] AS amenity,
               CASE WHEN c_custkey % 31 = 0 THEN 'Books' END AS shop, CASE WHEN c_custkey % 12 = 5 THEN 'hotel' END AS tourism,
               CASE WHEN c_custkey % 12 = 7 THEN ' Park ' END AS leisure, CASE WHEN c_custkey % 41 = 0 THEN 'lawyer' END AS office,
               CASE WHEN c_custkey % 43 = 0 THEN 'platform' END AS public_transport, CASE WHEN c_custkey % 47 = 0 THEN 'halt' END AS railway,
               CASE WHEN c_custkey % 12 = 8 THEN 'industrial' END AS landuse, CASE WHEN c_custkey % 53 = 0 THEN 'works' END AS man_made,
               CASE WHEN c_custkey % 59 = 0 THEN 'food' END AS category, NULL::VARCHAR AS fclass
        FROM customer, g)""",
    "classed": """classed AS (
        SELECT poi_id, x, y, CASE
            WHEN amenity = 'bus_stop' OR public_transport = 'platform' OR railway = 'halt' THEN 'transport'
            WHEN shop IS NOT NULL OR amenity = 'marketplace' THEN 'retail'
            WHEN amenity = 'cafe' OR category = 'food' THEN 'food'
            WHEN amenity = 'school' THEN 'education'
            WHEN amenity = 'pharmacy' THEN 'health'
            WHEN tourism = 'hotel' THEN 'lodging'
            WHEN amenity = 'place_of_worship' THEN 'tourism_culture'
            WHEN trim(leisure) = 'Park' THEN 'leisure_sport'
            WHEN landuse = 'industrial' OR man_made = 'works' THEN 'industry_logistics'
            WHEN amenity = 'bank' OR office IS NOT NULL THEN 'office_gov'
            WHEN amenity = 'laundry' THEN 'services' ELSE 'other' END AS l1
        FROM poi)""",
    "zones": """zones AS (
        SELECT n_nationkey::BIGINT AS zone_id, (n_nationkey % 5) * (g * 100 / 5.0::DOUBLE) AS x0, (n_nationkey // 5) * (g * 100 / 5.0::DOUBLE) AS y0,
               (n_nationkey % 5) * (g * 100 / 5.0::DOUBLE) + (g * 100 / 5.0::DOUBLE) AS x1, (n_nationkey // 5) * (g * 100 / 5.0::DOUBLE) + (g * 100 / 5.0::DOUBLE) AS y1
        FROM nation, g)""",
    "boxes": """boxes AS (
        SELECT zone_id, sign, x0 + 13.3 + 18.0 * g * a AS bx0, y0 + 13.3 + 18.0 * g * b AS by0, x0 + 13.3 + 18.0 * g * c AS bx1, y0 + 13.3 + 18.0 * g * d AS by1
        FROM zones, g, (VALUES (1, 0.0, 0.0, 1.0, 0.5), (1, 0.5, 0.5, 1.0, 1.0), (-1, 0.6, 0.1, 0.9, 0.4)) v(sign, a, b, c, d))""",
    "raster": """raster AS (
        SELECT (4 - n_nationkey // 5)::INTEGER AS row, (n_nationkey % 5)::INTEGER AS col, CASE WHEN n_nationkey <> 7 THEN n_nationkey * 40.0::DOUBLE END AS value
        FROM nation)""",
    "sheet": r"""sheet AS (
        SELECT 'counts_' || strftime(ts, '%Y-%m-%d') || '.xlsx' AS file, event_id AS rownum,
               CASE WHEN event_id % 4 = 0 THEN ' Road' || chr(8203) || ' ' || event_type || ' ' || (event_id % 9) END AS road_name,
               CASE WHEN event_id % 4 = 0 THEN (13 + (event_id % 100) / 1000.0)::DECIMAL(8,3) || ', ' || (100 + (event_id % 77) / 1000.0)::DECIMAL(8,3) END AS latlon,
               CASE WHEN event_id % 3 <> 0 THEN value END AS aadt
        FROM events)""",
    "mean_obs": "mean_obs AS (SELECT osm_id, avg(aadt) AS aadt_obs FROM obs WHERE aadt IS NOT NULL GROUP BY osm_id)",
    "segs": """segs AS (
        SELECT road_id, x1, y1, x2, y2, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM roads)""",
    "pairs": """pairs AS (
        SELECT s.road_id, p.poi_id, p.l1,
               (p.x - (s.x1 + t * (s.x2 - s.x1))) * (p.x - (s.x1 + t * (s.x2 - s.x1))) + (p.y - (s.y1 + t * (s.y2 - s.y1))) * (p.y - (s.y1 + t * (s.y2 - s.y1))) AS d2
        FROM segs s JOIN classed p ON p.x BETWEEN least(s.x1, s.x2) - 800 AND greatest(s.x1, s.x2) + 800
            AND p.y BETWEEN least(s.y1, s.y2) - 800 AND greatest(s.y1, s.y2) + 800,
        LATERAL (SELECT least(1, greatest(0, ((p.x - s.x1) * (s.x2 - s.x1) + (p.y - s.y1) * (s.y2 - s.y1)) / ((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1)))) AS t))""",
}
_NEEDS = {
    "roads": ("g",), "poi": ("g",), "classed": ("poi",), "zones": ("g",), "mean_obs": ("obs",), "segs": ("roads",), "boxes": ("zones",), "pairs": ("segs", "classed"),
}


def sql(*names: str, more: str = "") -> str:
    """A WITH clause of the named tables and what they need; ``more`` adds further ones."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [_SQL[n] for n in order] + ([more] if more else [])
    return "WITH " + ",\n".join(parts) + "\n"


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
