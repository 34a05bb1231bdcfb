"""Regression, model search and regression kriging over the road network."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import storage
from ..functions.text import max_speed_whole
from ..operators import kriging as K
from ..operators import local as L
from ..operators import models as M
from ..operators import network as N
from ..operators import relational as R
from ..operators.spatial import extent
from . import fixtures as X
from .fixtures import sql
from .network import _graph
from .registry import query
from .spatial import centres

REACH = 3000.0  # metres of road within which residuals are compared and kriged
NEIGHBOURS = 32
NUMERIC = ["maxspeed_num", "x", "y"]
SMALL = {"numTrees": (5, 10), "maxDepth": (3, 6), "minInstancesPerNode": (1, 4), "subset": (0.4, 1.0), "bootstrap": (0, 1)}


def feature_table(spark, d):
    """One row a road: features, type and, where counted, the mean count."""
    roads = R.attach_mean(X.roads(spark, d), X.observations(spark, d))
    table = roads.select("road_id", F.coalesce("type", F.lit("unknown")).alias("type"), max_speed_whole(F.col("maxspeed")).alias("maxspeed_num"), "aadt_obs")
    return storage.table(table.join(centres(spark, d), "road_id"), "features")


def labelled(spark, d):
    """All roads, and the counted ones with split flag and fold."""
    table = feature_table(spark, d)
    rows = table.filter("aadt_obs is not null")
    return table, M.hash_split(rows, "road_id").withColumn("fold", (F.col("road_id") % 3).cast("int"))


@query(sql("roads") + """SELECT road_id, CASE WHEN type = 'motorway' THEN 1.0::DOUBLE ELSE 0 END AS type_motorway, CASE WHEN type = 'path' THEN 1.0::DOUBLE ELSE 0 END AS type_path FROM roads""")
def one_hot(spark, d):
    return M.one_hot(X.roads(spark, d), "type", ["motorway", "path"]).select("road_id", "type_motorway", "type_path")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def ols_1d(spark, d):
    model = M.least_squares(["l_quantity"], None, "l_extendedprice").fit(X.read(spark, d, "lineitem")).stages[-1]
    return spark.createDataFrame([(round(float(model.coefficients[0]), 4), round(float(model.intercept), 2))], "slope double, intercept double")


@query("""WITH RECURSIVE o AS (SELECT c_nationkey AS g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS r FROM customer GROUP BY 1),
    f AS (SELECT 0::BIGINT AS r, NULL::INTEGER AS g, NULL::INTEGER AS fold, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, 0::BIGINT AS d, 0::BIGINT AS e UNION ALL
        SELECT r, g, fold, a + (fold = 0)::INT * n, b + (fold = 1)::INT * n, c + (fold = 2)::INT * n, d + (fold = 3)::INT * n, e + (fold = 4)::INT * n
        FROM (SELECT o.r, o.g, o.n, a, b, c, d, e, list_position([a, b, c, d, e], least(a, b, c, d, e)) - 1 AS fold FROM f JOIN o ON o.r = f.r + 1))
    SELECT g AS cluster, fold::INTEGER AS fold FROM f WHERE r > 0""")
def group_kfold(spark, d):
    sizes = X.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    return M.group_folds(sizes, "cluster", 5)


@query()
def kmeans_split(spark, d):
    _, rows = labelled(spark, d)
    return M.spatial_split(rows.drop("is_test"), "road_id").select("road_id", "cluster", "is_test")


@query()
def rf_pred(spark, d):
    _, rows = labelled(spark, d)
    model = M.forest(NUMERIC, "type", "aadt_obs", trees=20, depth=10).fit(rows.filter("not is_test"))
    return model.transform(rows).select("road_id", "is_test", F.col("aadt_obs").alias("y_true"), F.col("pred").alias("y_pred_reg"))


@query()
def predict_network(spark, d):
    table, rows = labelled(spark, d)
    return M.least_squares(NUMERIC, "type", "aadt_obs").fit(rows.filter("not is_test")).transform(table).select("road_id", F.col("pred").alias("aadt_pred_reg"))


@query()
def svr_pred(spark, d):
    table, rows = labelled(spark, d)
    model = M.support_vectors(rows.filter("not is_test").orderBy("road_id"), NUMERIC, "aadt_obs")
    return model.transform(table).select("road_id", F.col("pred").alias("aadt_pred_reg"))


@query()
def grid_search(spark, d):
    _, rows = labelled(spark, d)
    return M.grid_search(rows.orderBy("road_id"), NUMERIC, "aadt_obs", "fold", M.SVR_GRID)


@query()
def random_search(spark, d):
    _, rows = labelled(spark, d)
    found = M.random_search(rows, NUMERIC, "type", "aadt_obs", "fold", draws=2, space=SMALL)
    return spark.createDataFrame([(s["trees"], s["depth"], s["minInstancesPerNode"], s["bootstrap"], s["mean_r2"]) for s in found], "trees int, depth int, leaf int, bootstrap boolean, mean_r2 double")


@query()
def iterative_selection(spark, d):
    _, rows = labelled(spark, d)
    history = M.iterative_selection(rows.filter("not is_test"), rows.filter("is_test"), NUMERIC, "type", "aadt_obs", "fold", rounds=2, draws=1, space=SMALL)
    names = ("round", "n_num", "n_cat", "cv_r2", "train_r2", "train_rmse", "test_r2", "test_rmse")
    return spark.createDataFrame([tuple(h[n] for n in names) for h in history], "round int, n_num int, n_cat int, cv_r2 double, train_r2 double, train_rmse double, test_r2 double, test_rmse double")


@query()
def model_importance(spark, d):
    _, rows = labelled(spark, d)
    model = M.forest(NUMERIC, "type", "aadt_obs", trees=10, depth=6).fit(rows)
    return spark.createDataFrame(M.importances(model, model.transform(rows)), "feature string, importance double")


@query()
def perm_importance(spark, d):
    _, rows = labelled(spark, d)
    model = M.least_squares(NUMERIC, None, "aadt_obs").fit(rows.filter("not is_test"))
    return M.permutation_importance(rows.filter("is_test").select(*NUMERIC, "aadt_obs"), NUMERIC, "aadt_obs", model.transform, repeats=2)


def regression_kriging(spark, d, predict):
    """Regression, residuals per snapped node, variogram over network distance, kriged residuals for all roads.

    The variogram is of all pairs within REACH; each node is kriged from the NEIGHBOURS nearest residuals there.
    """
    table, rows = labelled(spark, d)
    fitted = storage.table(predict(rows.filter("not is_test"), table), "fitted")
    edges, nodes = _graph(spark, d)
    edges = storage.table(edges, "graph")
    at = storage.table(N.snap(centres(spark, d), nodes, "road_id").select("road_id", "node_id"), "snapped")
    resid = rows.filter("not is_test").select("road_id", "aadt_obs").join(fitted, "road_id").join(at, "road_id")
    resid = storage.table(resid.groupBy("node_id").agg(F.avg(F.col("aadt_obs") - F.col("pred")).alias("r")), "residuals")
    cloud = storage.table(L.residual_cloud(edges, nodes, resid, REACH), "cloud")
    spread = resid.agg(F.var_pop("r"), F.count(F.lit(1))).first()
    nugget, c, a = K.fit_variogram(cloud, float(spread[0] or 0.0))
    box = extent(nodes)
    start = math.sqrt(NEIGHBOURS * max(box[2] - box[0], 1.0) * max(box[3] - box[1], 1.0) / max(1, spread[1])) if box else REACH
    kriged = L.krige_network(edges, nodes, resid, nodes, K.Exponential(c, a), c + nugget + K.RIDGE, REACH, NEIGHBOURS, start)
    by_road = at.join(kriged, F.col("node_id") == F.col("dst")).select("road_id", "estimate")
    out = K.combine(fitted, by_road, "road_id")
    truth = rows.select("road_id", "is_test")
    return out.join(truth, "road_id", "left").join(table.select("road_id", "aadt_obs"), "road_id").select(
        "road_id", "aadt_obs", F.col("pred").alias("aadt_pred_reg"), F.col("estimate").alias("rk_resid"), "aadt_pred_rk", "is_test"
    )


def _by_ridge(train, table):
    return M.Ridge(NUMERIC).fit(train, "aadt_obs").transform(table).select("road_id", "pred")


@query()
def ridge_rk(spark, d):
    return regression_kriging(spark, d, _by_ridge)


@query()
def forest_rk(spark, d):
    return regression_kriging(spark, d, lambda train, table: M.forest(NUMERIC, "type", "aadt_obs", trees=10, depth=8).fit(train).transform(table).select("road_id", "pred"))


@query()
def model_compare(spark, d):
    """R2 and RMSE of three regressions, each alone and with kriged residuals (straight-line distance)."""
    table, rows = labelled(spark, d)
    train, out = rows.filter("not is_test"), []
    models = {
        "linear": lambda: M.least_squares(NUMERIC, "type", "aadt_obs").fit(train).transform,
        "forest": lambda: M.forest(NUMERIC, "type", "aadt_obs", trees=10, depth=8, seed=0).fit(train).transform,
        "svr": lambda: M.support_vectors(train.orderBy("road_id"), NUMERIC, "aadt_obs").transform,
    }
    for name, fit in models.items():
        pred = storage.table(fit()(rows).select("road_id", "x", "y", "aadt_obs", "is_test", "pred"), "pred")
        sample = pred.filter("not is_test").select(F.col("road_id").alias("sample_id"), "x", "y", (F.col("aadt_obs") - F.col("pred")).alias("z"))
        kriged = L.krige_spherical(sample, pred.filter("is_test"), ["road_id"])
        both = K.combine(pred.filter("is_test"), kriged, "road_id")
        for kind, column in (("reg", "pred"), ("rk", "aadt_pred_rk")):
            out.append(M.metrics(both, "aadt_obs", column).select(F.lit(name).alias("model"), F.lit(kind).alias("kind"), "r2", "rmse", "n"))
    return X.union_all(out)
