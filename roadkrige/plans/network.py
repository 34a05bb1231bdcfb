"""Graphs, network distance, variograms and kriging."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import storage
from ..operators import kriging as K
from ..operators import local as L
from ..operators import network as N
from ..operators import relational as R
from ..operators.spatial import radius_pairs
from . import fixtures as X
from .fixtures import sql
from .registry import query
from .spatial import centres

_PIECES = 'e AS (SELECT x1 AS ax, y1 AS ay, x2 AS bx, y2 AS "by", len AS w FROM segs)'


@query(sql("segs", more=_PIECES) + 'SELECT ax, ay, bx, "by", min(w) AS w FROM e WHERE w > 0 GROUP BY 1, 2, 3, 4')
def graph_edges_min(spark, d):
    return N.line_edges(X.roads(spark, d))


@query(sql("segs", more=_PIECES) + 'SELECT ax, ay, bx, "by", min(w) AS w FROM (FROM e UNION ALL SELECT ax, ay, ax, ay, 0.0 FROM e WHERE ax = ay) GROUP BY 1, 2, 3, 4')
def graph_edges_keep_zero(spark, d):
    roads = X.roads(spark, d)
    start = F.element_at("pts", 1)
    still = roads.filter(start["x"] == start["y"]).withColumn("pts", F.array(start, start))
    return N.line_edges(roads.unionByName(still), keep_zero=True)


@query(sql("segs", more=_PIECES) + 'SELECT (SELECT count(*) FROM (SELECT ax, ay FROM e UNION SELECT bx, "by" FROM e)) AS n_nodes, (SELECT count(*) FROM (SELECT DISTINCT ax, ay, bx, "by" FROM e)) AS n_edges')
def graph_size(spark, d):
    edges = N.line_edges(X.roads(spark, d))
    ends = edges.select(F.col("ax").alias("x"), F.col("ay").alias("y")).unionByName(edges.select(F.col("bx").alias("x"), F.col("by").alias("y"))).distinct()
    return ends.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges")))  # one row each


@query(sql("segs", more=_PIECES) + """, v AS (SELECT a.cx AS ax, a.cy AS ay, b.cx AS bx, b.cy AS "by", sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS w
        FROM segs a JOIN segs b ON a.road_id < b.road_id AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= 250000)
    SELECT ax, ay, bx, "by", round(min(w), 6) AS w FROM (SELECT * FROM e UNION ALL SELECT * FROM v) GROUP BY 1, 2, 3, 4""")
def graph_with_virtual(spark, d):
    out = N.with_virtual_links(N.line_edges(X.roads(spark, d)), centres(spark, d), "road_id", 500.0)
    return out.withColumn("w", F.round("w", 6))


# A node's distance from another in closed form: blocks within the full rows and the started one above them, where the
# lattice is connected both ways; the nodes at its edge hang on one road each (``e``) from the block node (bx, by).
_GRID = """lat AS (SELECT g, ((SELECT count(*) FROM part) // 2) // g AS top, ((SELECT count(*) FROM part) // 2) % g AS p FROM g),
    ends AS (SELECT x1 AS x, y1 AS y FROM segs UNION SELECT x2, y2 FROM segs),
    base AS (SELECT x, y, CASE WHEN x = 100 * g THEN x - 100 ELSE x END AS bx,
        CASE WHEN y > 100 * top OR (y = 100 * top AND x > 100 * p) THEN y - 100 ELSE y END AS "by" FROM ends, lat),
    ends_at AS (SELECT *, x - bx + y - "by" AS e FROM base),
    src AS (SELECT DISTINCT x1 AS x, y1 AS y FROM segs JOIN mean_obs ON osm_id = road_id WHERE aadt_obs IS NOT NULL),
    dist AS (SELECT s.x AS sx, s.y AS sy, t.x AS tx, t.y AS ty,
        CASE WHEN s.x = t.x AND s.y = t.y THEN 0 ELSE s.e + t.e + abs(s.bx - t.bx) + abs(s."by" - t."by") END AS d
        FROM ends_at s JOIN src ON s.x = src.x AND s.y = src.y, ends_at t)"""


def _graph(spark, d):
    """Numbered edges and nodes."""
    edges = N.line_edges(X.roads(spark, d))
    nodes = storage.table(N.nodes_of(edges), "nodes")
    return N.numbered_edges(edges, nodes), nodes


def _labelled_nodes(spark, d, nodes):
    """The nodes that the roads with counts snap to."""
    counted = R.mean_by_key(X.observations(spark, d)).filter("aadt_obs is not null").select(F.col("osm_id").alias("road_id"))
    return N.snap(centres(spark, d).join(counted, "road_id", "left_semi"), nodes, "road_id").select("node_id").distinct()


def _sources(spark, d, nodes):
    """The labelled nodes with their places."""
    return nodes.join(_labelled_nodes(spark, d, nodes), "node_id", "left_semi")


@query(sql("segs", "mean_obs", more=_GRID) + "SELECT sx, sy, tx, ty, d AS dist FROM dist")
def network_distance(spark, d):
    edges, nodes = _graph(spark, d)
    return N.network_distance(edges, _sources(spark, d, nodes), nodes, places=True)


@query(sql("segs", "mean_obs", more=_GRID) + "SELECT sx, sy, tx, ty, d AS dist FROM dist UNION ALL SELECT x, y, -1.0, -1.0, 1e6 FROM src")
def network_distance_fill(spark, d):
    edges, nodes = _graph(spark, d)
    lost = spark.createDataFrame([(-1, -1.0, -1.0)], "node_id long, x double, y double")
    return N.distance_matrix(edges, _sources(spark, d, nodes), nodes.unionByName(lost), places=True)


@query(sql("segs", "mean_obs", more=_GRID) + "SELECT sx, sy, tx, ty, round(2.5 * exp(-d / 1500), 8) AS cov FROM dist")
def cov_matrix(spark, d):
    edges, nodes = _graph(spark, d)
    placed = N.network_distance(edges, _sources(spark, d, nodes), nodes, places=True)
    return placed.select("sx", "sy", "tx", "ty", F.round(K.exponential_covariance(F.col("dist"), 2.5, 1500.0), 8).alias("cov"))


_CLOUD = """c AS (SELECT sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS h, 0.5 * pow((a.road_id % 11) - (b.road_id % 11), 2)::DOUBLE AS gamma
    FROM segs a JOIN segs b ON a.road_id < b.road_id AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= 90000)"""


def _cloud(spark, d):
    value = centres(spark, d).withColumn("r", (F.col("road_id") % 11).cast("double"))
    pairs = radius_pairs(value, "road_id", 300.0, carry=("r",))
    return K.variogram_cloud(pairs.withColumn("dist", F.sqrt("d2")), left="a_r", right="b_r")


@query(sql("segs", more=_CLOUD) + "SELECT round(quantile_cont(gamma, 0.1), 8) AS nugget, round(max(gamma) - quantile_cont(gamma, 0.1), 8) AS sill, round(quantile_cont(h, 0.75), 6) AS range, round(var_pop(gamma), 6) AS spread FROM c")
def variogram_p0(spark, d):
    cloud = _cloud(spark, d)
    start = K.start_values(cloud).crossJoin(cloud.agg(F.var_pop("gamma").alias("spread")))  # one row each
    return start.select(F.round("nugget", 8).alias("nugget"), F.round("sill", 8).alias("sill"), F.round("range", 6).alias("range"), F.round("spread", 6).alias("spread"))


@query(sql("segs", more=_CLOUD) + "SELECT round(h, 6) AS h, count(*) AS n, round(avg(gamma), 8) AS gamma FROM c GROUP BY 1")
def variogram_cloud(spark, d):
    return _cloud(spark, d).groupBy(F.round("h", 6).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gamma"), 8).alias("gamma"))


@query()
def variogram_fit(spark, d):
    nugget, c, a = K.fit_variogram(_cloud(spark, d), 10.0)
    return spark.createDataFrame([(nugget, c, a)], "nugget double, c double, a double")


REACH = 1500.0


@query(sql("segs", "mean_obs", more=_GRID) + f"SELECT sx, sy, tx, ty, d AS dist FROM dist WHERE d <= {REACH}")
def network_distance_within(spark, d):
    """Pairs of a labelled node and any node within a range, tile by tile."""
    edges, nodes = _graph(spark, d)
    return N.with_places(L.distances_within(edges, nodes, _labelled_nodes(spark, d, nodes), nodes, REACH), nodes, nodes)


@query(sql("segs", "mean_obs") + """SELECT road_id, rank, sample_id, round(sqrt(d2), 6) AS distance FROM (
    SELECT s.road_id, m.osm_id AS sample_id, (s.cx - t.cx) * (s.cx - t.cx) + (s.cy - t.cy) * (s.cy - t.cy) AS d2,
        row_number() OVER (PARTITION BY s.road_id ORDER BY (s.cx - t.cx) * (s.cx - t.cx) + (s.cy - t.cy) * (s.cy - t.cy), m.osm_id)::INTEGER AS rank
    FROM segs s CROSS JOIN mean_obs m JOIN segs t ON t.road_id = m.osm_id) WHERE rank <= 8""")
def nearest_labelled_8(spark, d):
    """The eight labelled roads whose centres are nearest to each road's."""
    near = L.k_nearest(centres(spark, d), labelled_sample(spark, d), 8, "road_id", "sample_id")
    return near.withColumn("distance", F.round("distance", 6))


_TWO = "80000 - (CASE WHEN {h} > 0 THEN 300 ELSE 0 END + 79700 * (1 - exp(-3 * {h} / 800)))"


@query(sql("segs") + f""", h AS (SELECT road_id, sqrt(pow(cx - 100, 2) + pow(cy - 100, 2)) AS h1, sqrt(pow(cx - 700, 2) + pow(cy - 500, 2)) AS h2, sqrt(pow(600, 2) + pow(400, 2)) AS h12 FROM segs),
    k AS (SELECT road_id, {_TWO.format(h="h1")} AS k1, {_TWO.format(h="h2")} AS k2, {_TWO.format(h="h12")} AS k12 FROM h)
    SELECT road_id, round(1000 * (0.5 + (k1 - k2) / (2 * (80000 - k12))) + 5000 * (0.5 - (k1 - k2) / (2 * (80000 - k12))), 4) AS estimate FROM k""")
def ok_two_point(spark, d):
    xy, z = np.array([[100.0, 100.0], [700.0, 500.0]]), np.array([1000.0, 5000.0])
    between = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    model = K.Kriging(between, z, K.FromVariogram(80000.0, K.practical_exponential, 300.0, 79700.0, 800.0), 80000.0)
    return K.krige_points(model, xy, centres(spark, d), ["road_id"]).withColumn("estimate", F.round("estimate", 4))


@query(sql("segs", "mean_obs", more=_GRID) + """, t AS (SELECT x, y, exp(-(e + bx + "by") / 8000) AS k1, 1 + 1e-10 AS s, exp(-1000 / 8000.0) AS c,
        exp(-CASE WHEN x = 1000 AND y = 0 THEN 0 ELSE e + abs(bx - least(1000, 100 * g - 100)) + 1000 - least(1000, 100 * g - 100) + "by" END / 8000) AS k2 FROM ends_at, lat)
    SELECT x, y, round((1.5 * (s * k1 - c * k2) - 0.5 * (s * k2 - c * k1)) / (s * s - c * c), 7) AS estimate FROM t""")
def network_simple_krige(spark, d):
    edges, nodes = _graph(spark, d)
    known = [r.node_id for r in nodes.filter("y = 0 and x in (0, 1000)").orderBy("x").collect()]  # two nodes
    model = K.network_simple_kriging(np.array([[0.0, 1000.0], [1000.0, 0.0]]), np.array([1.5, -0.5]))
    dist = N.network_distance(edges, nodes.filter(F.col("node_id").isin(known)), nodes)
    out = K.krige_distances(model, dist, known)
    return out.join(nodes, F.col("dst") == F.col("node_id")).select("x", "y", F.round("estimate", 7).alias("estimate"))


@query(sql("roads", "mean_obs") + "SELECT road_id, 20000 + 3 * x1 AS aadt_pred_reg, 20000 + 3 * x1 + coalesce(aadt_obs - 25000, 0) AS aadt_pred_rk FROM roads LEFT JOIN mean_obs USING (osm_id)")
def rk_combine(spark, d):
    roads = X.roads(spark, d).select("road_id", (20000 + 3 * F.element_at("pts", 1)["x"]).alias("pred"))
    resid = R.mean_by_key(X.observations(spark, d)).select(F.col("osm_id").alias("road_id"), (F.col("aadt_obs") - 25000).alias("estimate"))
    return K.combine(roads, resid, "road_id").select("road_id", F.col("pred").alias("aadt_pred_reg"), "aadt_pred_rk")


@query(sql("roads", "mean_obs") + "SELECT road_id, 20000 + 3 * x1 AS aadt_pred_reg FROM roads")
def reg_layer(spark, d):
    return rk_combine(spark, d).select("road_id", "aadt_pred_reg")


@query(sql("roads", "mean_obs") + "SELECT road_id, coalesce(round_even(aadt_obs, 0), round_even(1000 + x1 / 3, 0))::BIGINT AS aadt FROM roads LEFT JOIN mean_obs USING (osm_id)")
def kriging_assign(spark, d):
    roads = X.roads(spark, d).join(R.mean_by_key(X.observations(spark, d), to="aadt"), "osm_id", "left")
    estimates = X.roads(spark, d).select("road_id", (1000 + F.element_at("pts", 1)["x"] / 3).alias("estimate"))
    return K.assign(roads, estimates, "road_id").select("road_id", "aadt")


def labelled_sample(spark, d):
    """sample_id, x, y, z (mean count) of all labelled roads."""
    mean = R.mean_by_key(X.observations(spark, d)).withColumnRenamed("osm_id", "road_id")
    return centres(spark, d).join(mean, "road_id").select(F.col("road_id").alias("sample_id"), "x", "y", F.col("aadt_obs").alias("z"))


@query()
def ok_fixed_variogram(spark, d):
    return L.krige_fixed(labelled_sample(spark, d), centres(spark, d), ["road_id"])


@query()
def uk_spherical(spark, d):
    return L.krige_spherical(labelled_sample(spark, d), centres(spark, d), ["road_id"])
