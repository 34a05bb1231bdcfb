"""Scalar functions: text, classes, geometry, projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import projections as P
from ..functions import text as T
from ..functions.classify import poi_class
from . import fixtures as X
from .fixtures import sql
from .registry import query


@query("""SELECT doc_id, md5(lower(regexp_replace(regexp_replace(nfc_normalize(text), '[' || chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279) || ']', '', 'g'), '^\\s+|\\s+$', '', 'g'))) AS cleaned FROM documents""")
def clean_text(spark, d):
    return X.read(spark, d, "documents").select("doc_id", F.md5(T.clean_text(F.col("text")).cast("binary")).alias("cleaned"))


@query(sql("sheet") + r"""SELECT rownum, TRY_CAST(nullif(regexp_extract(latlon, '(\d+\.\d+)[,\s]+(\d+\.\d+)', 1), '') AS DOUBLE) AS lat,
    TRY_CAST(nullif(regexp_extract(latlon, '(\d+\.\d+)[,\s]+(\d+\.\d+)', 2), '') AS DOUBLE) AS lon FROM sheet""")
def latlon_extract(spark, d):
    return X.count_sheet(spark, d).select("rownum", T.extract_latlon(F.col("latlon")).alias("p")).select("rownum", "p.lat", "p.lon")


@query(r"""WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'n/a' WHEN c_custkey % 5 = 1 THEN '13.5, 100.25 ' WHEN c_custkey % 5 = 2 THEN NULL
        ELSE '-' || (c_custkey % 90) || '.5,' || (c_custkey % 180) END AS s FROM customer)
    SELECT c_custkey, TRY_CAST(nullif(regexp_extract(s, '^\s*([-+]?\d+(?:\.\d+)?)\s*,\s*([-+]?\d+(?:\.\d+)?)\s*$', 1), '') AS DOUBLE) AS lat,
        TRY_CAST(nullif(regexp_extract(s, '^\s*([-+]?\d+(?:\.\d+)?)\s*,\s*([-+]?\d+(?:\.\d+)?)\s*$', 2), '') AS DOUBLE) AS lon FROM t""")
def latlon_anchored(spark, d):
    k = F.col("c_custkey")
    s = F.when(k % 5 == 0, "n/a").when(k % 5 == 1, "13.5, 100.25 ").when(k % 5 == 2, None).otherwise(F.concat(F.lit("-"), (k % 90).cast("string"), F.lit(".5,"), (k % 180).cast("string")))
    return X.read(spark, d, "customer").select("c_custkey", T.anchored_latlon(s).alias("p")).select("c_custkey", "p.lat", "p.lon")


@query(sql("roads") + r"""SELECT road_id, TRY_CAST(nullif(regexp_extract(maxspeed, '\d+\.?\d*'), '') AS DOUBLE) AS num, coalesce(TRY_CAST(nullif(regexp_extract(maxspeed, '\d+'), '') AS DOUBLE), 0) AS whole FROM roads""")
def maxspeed_num(spark, d):
    return X.roads(spark, d).select("road_id", T.max_speed(F.col("maxspeed")).alias("num"), T.max_speed_whole(F.col("maxspeed")).alias("whole"))


@query(r"""SELECT p_partkey AS road_id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey END AS osm_id FROM part""")
def osm_id_extract(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, "relation/none").otherwise(F.concat(F.lit("way/"), k.cast("string")))
    return X.read(spark, d, "part").select(k.alias("road_id"), T.digits_id(text).alias("osm_id"))


@query(sql("sheet") + """SELECT rownum, substr(file, 8, 10) AS day, file AS name FROM sheet""")
def file_date(spark, d):
    path = F.concat(F.lit("data/in/"), F.col("file"))
    return X.count_sheet(spark, d).select("rownum", T.file_date(path).alias("day"), T.base_name(path).alias("name"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 100.0::DOUBLE END AS score FROM part""")
def fuzzy_score(spark, d):
    k = F.col("p_partkey")
    inner = F.when(k % 2 == 0, F.substring("p_name", 2, 4))
    return X.read(spark, d, "part").select("p_partkey", T.partial_ratio(inner, F.col("p_name")).alias("score"))


@query(sql("classed") + "SELECT poi_id, l1 FROM classed")
def poi_classes(spark, d):
    poi = X.poi(spark, d)
    return poi.select("poi_id", poi_class(poi.columns).alias("l1"))


@query("""SELECT event_id, coalesce(event_type, '') || '_' || user_id || '_' || CASE WHEN event_id % 4 = 0 THEN '' ELSE (event_id % 9)::VARCHAR END AS key FROM events""")
def match_key(spark, d):
    rows = X.read(spark, d, "events").withColumn("k", F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 9))
    return rows.select("event_id", T.match_key("event_type", "user_id", "k").alias("key"))


@query("""SELECT c_custkey, round(exp(-(c_custkey % 50) / 10.0::DOUBLE), 8) AS e, round(sqrt(abs(c_acctbal)), 8) AS s, least(5.0::DOUBLE, greatest(1.0::DOUBLE, c_acctbal / 1000)) AS clipped,
    round(pi() * pow(c_custkey % 7, 2), 8) AS area, round_even(c_custkey / 2.0::DOUBLE, 0)::BIGINT AS half FROM customer""")
def math_basics(spark, d):
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    from ..functions.numbers import half_even

    return X.read(spark, d, "customer").select(
        "c_custkey", F.round(F.exp(-(k % 50) / 10.0), 8).alias("e"), F.round(F.sqrt(F.abs(b)), 8).alias("s"), F.least(F.lit(5.0), F.greatest(F.lit(1.0), b / 1000)).alias("clipped"),
        F.round(F.pi() * F.pow(k % 7, F.lit(2)), 8).alias("area"), half_even(k / 2.0).alias("half"),
    )


@query(sql("segs") + "SELECT road_id, len AS length_m, cx, cy FROM segs")
def line_measures(spark, d):
    pts = F.col("pts")
    return X.roads(spark, d).select("road_id", G.length(pts).alias("length_m"), G.centroid(pts).alias("c")).select("road_id", "length_m", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))


@query(sql("segs") + """, n AS (SELECT *, road_id // 2 AS osm_id, row_number() OVER (PARTITION BY road_id // 2 ORDER BY len DESC, road_id) AS k FROM segs)
    SELECT osm_id, len AS length_m, cx AS mx, cy AS my FROM n WHERE k = 1""")
def longest_part_midpoint(spark, d):
    best = F.aggregate(
        F.col("parts"), F.lit(None).cast("array<struct<x:double,y:double>>"), lambda acc, p: F.when(acc.isNull() | (G.length(p) > G.length(acc)), p).otherwise(acc)
    )
    longest = X.paired_roads(spark, d).select("osm_id", best.alias("pts"))
    mid = longest.select("osm_id", G.length(F.col("pts")).alias("length_m"), G.midpoint(F.col("pts")).alias("m"))
    return mid.select("osm_id", "length_m", F.col("m.x").alias("mx"), F.col("m.y").alias("my"))


@query(sql("roads") + """SELECT road_id, 'LineString' AS gtype FROM roads WHERE road_id % 3 = 0""")
def geom_filters(spark, d):
    k = F.col("road_id")
    mixed = X.roads(spark, d).select("road_id", F.when(k % 3 == 0, "LineString").when(k % 3 == 1, "Point").otherwise("LineString").alias("gtype"), F.when(k % 3 != 2, F.col("pts")).alias("pts"))
    return mixed.filter(F.col("gtype").isin("LineString", "MultiLineString") & F.col("pts").isNotNull() & (F.size("pts") > 0)).select("road_id", "gtype")


@query("""SELECT c_custkey, (c_custkey % 100)::DOUBLE AS x, (c_custkey % 17)::DOUBLE AS y FROM customer""")
def make_points(spark, d):
    k = F.col("c_custkey")
    return X.read(spark, d, "customer").select("c_custkey", G.point(k % 100, k % 17).alias("p")).select("c_custkey", "p.x", "p.y")


@query("""SELECT c_custkey, round(sqrt(pow((c_custkey % 100) - least(60, greatest(10, c_custkey % 100)), 2) + pow((c_custkey % 17) - 5, 2)), 8) AS d_line,
    round(sqrt(pow(c_custkey % 100, 2) + pow(c_custkey % 17, 2)), 8) AS d_point FROM customer""")
def point_line_distance(spark, d):
    x, y = (F.col("c_custkey") % 100).cast("double"), (F.col("c_custkey") % 17).cast("double")
    road = G.line((10, 5), (35, 5), (60, 5))
    return X.read(spark, d, "customer").select("c_custkey", F.round(G.point_line_distance(x, y, road), 8).alias("d_line"), F.round(G.point_distance(G.point(x, y), G.point(0, 0)), 8).alias("d_point"))


@query(sql("zones") + "SELECT zone_id, (x0 + x1) / 2 AS px, (y0 + y1) / 2 AS py FROM zones")
def zone_rep_point(spark, d):
    return X.zones(spark, d).select("zone_id", G.representative_point(F.col("ring")).alias("p")).select("zone_id", F.col("p.x").alias("px"), F.col("p.y").alias("py"))


def _utm_sql(lon: str, lat: str) -> str:
    n, r = G._N, G._K0 * G._R
    e = 2 * n**0.5 / (1 + n)
    xs = " + ".join(f"{a!r}::DOUBLE * cos({2 * i} * xi) * sinh({2 * i} * eta)" for i, a in enumerate(G._ALPHA, 1))
    ys = " + ".join(f"{a!r}::DOUBLE * sin({2 * i} * xi) * cosh({2 * i} * eta)" for i, a in enumerate(G._ALPHA, 1))
    return f"""WITH p AS (SELECT c_custkey, radians({lat}) AS phi, radians({lon} - 99) AS lam FROM customer),
        t AS (SELECT *, sinh(atanh(sin(phi)) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(phi))) AS t FROM p),
        u AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
        SELECT c_custkey, round(500000 + {r!r}::DOUBLE * (eta + {xs}), 4) AS x, round({r!r}::DOUBLE * (xi + {ys}), 4) AS y FROM u"""


@query(_utm_sql("(100 + (c_custkey % 100) / 100.0::DOUBLE)", "(13 + (c_custkey % 77) / 77.0::DOUBLE)"))
def utm_forward(spark, d):
    k = F.col("c_custkey")
    p = G.utm_forward(100 + (k % 100) / 100.0, 13 + (k % 77) / 77.0)
    return X.read(spark, d, "customer").select("c_custkey", p.alias("p")).select("c_custkey", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


# closed forms of three systems: web Mercator, a conformal cone (EPSG:2154) and Albers' (EPSG:5070), both on GRS 80
def _systems_sql() -> str:
    psi = lambda p: f"(atanh(sin({p})) - e * atanh(e * sin({p})))"
    m = lambda p: f"(cos({p}) / sqrt(1 - e * e * sin({p}) * sin({p})))"
    q = lambda p: f"((1 - e * e) * (sin({p}) / (1 - e * e * sin({p}) * sin({p})) + atanh(e * sin({p})) / e))"
    return f"""WITH c AS (SELECT c_custkey, radians(-120 + (c_custkey % 97) / 2.0::DOUBLE) AS lam, radians(20 + (c_custkey % 61) / 2.0::DOUBLE) AS phi, 6378137.0::DOUBLE AS a,
            sqrt(2 / 298.257222101::DOUBLE - 1 / (298.257222101::DOUBLE * 298.257222101::DOUBLE)) AS e,
            radians(46.5::DOUBLE) AS l0, radians(44.0::DOUBLE) AS l1, radians(49.0::DOUBLE) AS l2, radians(23.0::DOUBLE) AS b0, radians(29.5::DOUBLE) AS b1, radians(45.5::DOUBLE) AS b2 FROM customer),
        n AS (SELECT *, (ln({m("l1")}) - ln({m("l2")})) / ({psi("l2")} - {psi("l1")}) AS ln_, ({m("b1")} * {m("b1")} - {m("b2")} * {m("b2")}) / ({q("b2")} - {q("b1")}) AS bn FROM c),
        f AS (SELECT *, a * {m("l1")} * exp(ln_ * {psi("l1")}) / ln_ AS lf, {m("b1")} * {m("b1")} + bn * {q("b1")} AS bc FROM n),
        r AS (SELECT *, lf * exp(-ln_ * {psi("phi")}) AS lr, lf * exp(-ln_ * {psi("l0")}) AS lr0, a * sqrt(bc - bn * {q("phi")}) / bn AS br, a * sqrt(bc - bn * {q("b0")}) / bn AS br0,
            ln_ * (lam - radians(3.0::DOUBLE)) AS lt, bn * (lam + radians(96.0::DOUBLE)) AS bt FROM f)
        SELECT c_custkey, round(a * lam, 3) AS web_x, round(a * atanh(sin(phi)), 3) AS web_y, round(700000 + lr * sin(lt), 3) AS cone_x, round(6600000 + lr0 - lr * cos(lt), 3) AS cone_y,
            round(br * sin(bt), 3) AS albers_x, round(br0 - br * cos(bt), 3) AS albers_y FROM r"""


@query(_systems_sql())
def project_systems(spark, d):
    k = F.col("c_custkey")
    lon, lat = -120 + (k % 97) / 2.0, 20 + (k % 61) / 2.0
    places = {"web": P.transform(lon, lat, 4326, 3857), "cone": P.transform(lon, lat, 4326, 2154), "albers": P.transform(lon, lat, 4326, 5070)}
    rows = X.read(spark, d, "customer").select("c_custkey", *[p.alias(n) for n, p in places.items()])
    return rows.select("c_custkey", *[F.round(f"{n}.{c}", 3).alias(f"{n}_{c}") for n in places for c in "xy"])


@query("SELECT c_custkey, round(-120 + (c_custkey % 97) / 2.0::DOUBLE, 9) AS lon, round(20 + (c_custkey % 61) / 2.0::DOUBLE, 9) AS lat FROM customer")
def reproject_back(spark, d):
    """Through four systems and back to degrees."""
    k = F.col("c_custkey")
    p = G.point(-120 + (k % 97) / 2.0, 20 + (k % 61) / 2.0)
    rows = X.read(spark, d, "customer").select("c_custkey", p.alias("p"))
    way = (4326, 3395, 5070, 32613, 3857, 4326)
    for one, other in zip(way, way[1:], strict=False):
        rows = rows.select("c_custkey", P.transform("p.x", "p.y", one, other).alias("p"))
    return rows.select("c_custkey", F.round("p.x", 9).alias("lon"), F.round("p.y", 9).alias("lat"))
