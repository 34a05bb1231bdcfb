from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadkrige.operators import kriging as K
from roadkrige.operators import local as L
from roadkrige.operators import models as M
from roadkrige.operators import network as N
from roadkrige.operators import relational as R


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(1)
    xy = rng.uniform(0, 1000, (40, 2))
    return np.column_stack((xy, 1000 + 3 * xy[:, 0] + rng.normal(0, 50, 40)))


def test_weights_sum_to_one_and_loop_equals_batch(sample):
    model = K.ordinary_kriging(sample)
    to = np.random.default_rng(2).uniform(0, 1500, (7, 40))
    w = model.weights(to)
    assert np.allclose(w.sum(0), 1)
    assert np.allclose(model.predict(to), w.T @ sample[:, 2])
    single = [model.weights(to[i : i + 1])[:, 0] for i in range(7)]
    assert np.allclose(np.array(single).T, w)


def test_no_nugget_interpolates():
    xy = np.array([[0.0, 0], [5, 0], [0, 7], [3, 3]])
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    z = np.array([1.0, 2, 3, 4])
    for ordinary in (True, False):
        assert np.allclose(K.Kriging(d, z, K.Exponential(2.0, 5.0), 2.0, ordinary).predict(d), z)
    nugget = K.residual_kriging(d, z, 0.5, 2.0, 5.0)
    assert not np.allclose(nugget.predict(d), z)
    assert np.isfinite(K.Kriging(np.zeros((2, 2)), np.array([1.0, 3.0]), K.Exponential(1, 1), 1.0).predict(np.zeros((1, 2)))).all()


def test_unreachable_targets_get_the_mean_without_information():
    d = np.array([[0, np.inf], [np.inf, 0]])
    model = K.residual_kriging(d, np.array([2.0, 4.0]), 0.1, 1.0, 100.0)
    assert model.predict(np.full((1, 2), np.inf))[0] == pytest.approx(3.0)


def test_variogram_fit_finds_the_parameters():
    h = np.random.default_rng(0).uniform(1, 5000, 800)
    n, c, a = K.fit_exponential(h, 0.3 + 2.0 * (1 - np.exp(-h / 700)), 10.0)
    assert (n, c, a) == pytest.approx((0.3, 2.0, 700), rel=0.02)
    assert K.fit_exponential(h[:5], h[:5], 4.0) == (K.DEFAULT_NUGGET, 4.0, K.DEFAULT_RANGE)
    assert K.fit_exponential(h, 0.3 + 2 * (1 - np.exp(-h / 700)), 1.0)[1] == 1.0  # c stays within the variance
    n, c, r = K.fit_spherical(h, K.spherical_variogram(h, 0.5, 3.0, 2000.0))
    assert c + n == pytest.approx(3.5, rel=0.1)
    with pytest.raises(ValueError):
        K.ordinary_kriging(np.zeros((2, 3)))


def test_estimates_by_distances_and_by_points_agree(spark, sample):
    model = K.ordinary_kriging(sample)
    at = np.random.default_rng(3).uniform(0, 1000, (9, 2))
    d = np.sqrt(((at[:, None] - sample[None, :, :2]) ** 2).sum(2))
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "id long, x double, y double")
    long = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(9) for j in range(40)], "dst long, src long, dist double")
    a = dict(map(tuple, K.krige_points(model, sample[:, :2], points, ["id"]).collect()))
    b = dict(map(tuple, K.krige_distances(model, long, list(range(40))).collect()))
    assert a == pytest.approx(b) and [a[i] for i in range(9)] == pytest.approx(list(model.predict(d)))


def test_combine_and_assign_by_key(spark):
    pred = spark.createDataFrame([(1, 10.0), (2, 20.0)], "k long, pred double")
    est = spark.createDataFrame([(2, 5.5)], "k long, estimate double")
    assert sorted((r.k, r.aadt_pred_rk) for r in K.combine(pred, est, "k").collect()) == [(1, 10.0), (2, 25.5)]
    roads = spark.createDataFrame([(1, 7.0), (2, None), (3, None)], "k long, aadt double")
    assert sorted((r.k, r.aadt) for r in K.assign(roads, est, "k").collect()) == [(1, 7), (2, 6), (3, None)]


def test_network(spark):
    rows = [(0, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]), (1, [(0.0, 0.0), (1.0, 0.0)]), (2, [(9.0, 9.0), (9.0, 10.0)]), (3, [(5.0, 5.0), (5.0, 5.0)])]
    lines = spark.createDataFrame(rows, "id long, pts array<struct<x:double,y:double>>")
    edges = N.line_edges(lines)
    assert edges.count() == 3 and N.line_edges(lines, keep_zero=True).count() == 4
    nodes = N.nodes_of(edges)
    assert [tuple(r) for r in nodes.orderBy("node_id").collect()] == [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 1.0), (3, 9.0, 9.0), (4, 9.0, 10.0)]
    numbered = N.numbered_edges(edges, nodes)
    fast = sorted(map(tuple, N.network_distance(numbered, nodes.filter("node_id in (0, 3)"), nodes).collect()))
    slow = sorted(map(tuple, N.network_distance(numbered, nodes.filter("node_id in (0, 3)"), nodes, local_edges=0).collect()))
    assert fast == slow == [(0, 0, 0.0), (0, 1, 1.0), (0, 2, 2.0), (3, 3, 0.0), (3, 4, 1.0)]
    matrix = {(r.src, r.dst): r.dist for r in N.distance_matrix(numbered, nodes.filter("node_id = 0"), nodes).collect()}
    assert len(matrix) == 5 and matrix[0, 3] == N.UNREACHABLE and matrix[0, 0] == 0


def test_dijkstra_is_symmetric_and_equals_relaxation(spark):
    rng = np.random.default_rng(6)
    edges = spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 30, 80), rng.integers(0, 30, 80), rng.uniform(1, 9, 80), strict=True)], "src long, dst long, w double")
    nodes = spark.range(30).withColumnRenamed("id", "node_id")
    fast = {(r.src, r.dst): r.dist for r in N.network_distance(edges, nodes, nodes).collect()}
    slow = {(r.src, r.dst): r.dist for r in N.relaxed_distance(edges, nodes, nodes).collect()}
    assert fast == pytest.approx(slow)
    assert all(fast[b, a] == pytest.approx(d) for (a, b), d in fast.items())
    assert all(fast[a, c] <= fast[a, b] + fast[b, c] + 1e-9 for a, b in list(fast)[:200] for c in range(30) if (b, c) in fast)


def test_ridge_is_the_closed_form_and_scores_leave_one_out():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3)) * [1, 5, 0.2]
    y = x @ [1.0, -0.5, 3.0] + 7 + rng.normal(0, 0.3, 60)
    m = M.Ridge(["a", "b", "c"]).fit_arrays(x, y)
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + m.alpha * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(m.coef, want)
    errors = []
    for a in m.alphas:
        out = []
        for i in range(60):
            k = np.arange(60) != i
            zk, c = z[k] - z[k].mean(0), y[k].mean()
            b = np.linalg.solve(zk.T @ zk + a * np.eye(3), zk.T @ (y[k] - c))
            out.append(y[i] - c - (z[i] - z[k].mean(0)) @ b)
        errors.append(np.mean(np.square(out)))
    assert m.alphas[int(np.argmin(errors))] == m.alpha


def test_ridge_and_svr_transform_as_on_arrays(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-2, 2, (120, 2))
    y = np.sin(2 * x[:, 0]) * 10 + x[:, 1]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, y double")
    svr = M.SVR(["a", "b"], C=10.0, epsilon=0.05).fit(df, "y")
    assert M.score_r2(y, svr.predict_arrays(x)) > 0.95
    for model in (svr, M.Ridge(["a", "b"]).fit(df, "y")):
        rows = model.transform(df).collect()
        assert np.allclose([r.pred for r in rows], model.predict_arrays(np.array([[r.a, r.b] for r in rows])))


def test_encoder_gives_zeros_for_unseen(spark):
    from pyspark.ml import Pipeline

    train = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "t string, n double")
    model = Pipeline(stages=M.encoder(["n"], "t")).fit(train)
    out = model.transform(spark.createDataFrame([("b", 5.0), ("zz", 6.0)], "t string, n double"))
    assert [r.features.toArray().tolist() for r in out.collect()] == [[5.0, 0.0, 1.0], [6.0, 0.0, 0.0]]
    assert len(M.feature_names(out)) == 3


def test_metrics_scaling_and_folds(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0), (None, 1.0)], "y double, p double")
    m = M.metrics(df, "y", "p").first()
    assert (m.r2, m.rmse, m.n) == pytest.approx((1 - 1.25 / (14 / 3), math.sqrt(1.25 / 3), 3))
    same = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r.v_z for r in M.standardise(same, ["v"]).collect()] == [0.0, 0.0]
    sizes = spark.createDataFrame([("a", 10), ("b", 9), ("c", 8), ("d", 2)], "g string, n long")
    assert dict(map(tuple, M.group_folds(sizes, "g", 2).collect())) == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_windows(spark):
    sheet = spark.createDataFrame([("f", 0, None), ("f", 1, "a"), ("f", 2, None), ("g", 0, None), ("g", 3, "b")], "file string, n int, v string")
    assert [r.v for r in R.forward_fill(sheet, ["v"], "n", "file").orderBy("file", "n").collect()] == [None, "a", "a", None, "b"]
    ids = R.dense_id(spark.range(100).select((F.col("id") * 37 % 101).alias("k")), ["k"]).orderBy("k").collect()
    assert [r.seg_id for r in ids] == list(range(100))
    small = spark.createDataFrame([(i, 1) for i in range(4)] + [(10 + i, 2) for i in range(12)], "k long, c int")
    picked = R.stratified_sample(small, "c", "k").filter("is_test").collect()
    assert len(picked) == 2 and {r.c for r in picked} == {2}
    pairs = [(r.i, r.j) for r in R.thinned_pairs(spark.range(30).selectExpr("id", "double(id) as r"), "id", ["r"], most=50).orderBy("i", "j").collect()]
    want = [(i, j) for i in range(30) for j in range(i + 1, 30, 8)][:50]
    assert pairs == want


def test_permutation_importance_finds_the_column_that_matters(spark):
    df = spark.range(200).selectExpr("double(id % 17) as a", "double(id % 5) as b", "3.0 * (id % 17) as y")
    model = M.least_squares(["a", "b"], None, "y").fit(df)
    got = {r.feature: r.importance_mean for r in M.permutation_importance(df, ["a", "b"], "y", model.transform, repeats=2).collect()}
    assert got["a"] > 1 and abs(got["b"]) < 0.05


def test_spherical_fit_is_of_all_pairs(sample):
    i, j = np.triu_indices(len(sample), 1)
    d = np.sqrt(((sample[i, :2] - sample[j, :2]) ** 2).sum(1))
    assert K.spherical_kriging(sample).covariance.parameters == pytest.approx(K.fit_spherical(d, 0.5 * (sample[i, 2] - sample[j, 2]) ** 2))


def test_thinned_indices():
    i, j = R.thinned_indices(30, 50)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(i, j) for i in range(30) for j in range(i + 1, 30, 8)][:50]


def test_regression_kriging_uses_every_residual(spark, monkeypatch):
    """On a road of 450 pieces: the estimates are those of each node's nearest residuals, under the variogram of all pairs in reach."""
    from pyspark.sql import Row

    from roadkrige.plans import models as P

    rows = [Row(road_id=i, x=50.0 * i, y=0.0, aadt_obs=float(i % 7 + i // 40), is_test=False) for i in range(450)]
    table = spark.createDataFrame(rows)
    nodes = table.select(F.col("road_id").alias("node_id"), "x", "y")
    edges = spark.range(449).selectExpr("id as src", "id + 1 as dst", "50.0D as w")
    monkeypatch.setattr(P, "labelled", lambda spark, d: (table.drop("is_test"), table))
    monkeypatch.setattr(P, "centres", lambda spark, d: table.select("road_id", "x", "y"))
    monkeypatch.setattr(P, "_graph", lambda spark, d: (edges, nodes))
    out = P.regression_kriging(spark, "", lambda train, t: t.select("road_id", F.lit(3.0).alias("pred")))
    got = {r.road_id: r.rk_resid for r in out.collect()}
    z = np.array([r.aadt_obs - 3.0 for r in rows])
    far = 50.0 * np.abs(np.subtract.outer(np.arange(450), np.arange(450)))
    i, j = np.nonzero(np.triu(far <= P.REACH, 1))
    cloud = spark.createDataFrame([(float(far[a, b]), 0.5 * float(z[a] - z[b]) ** 2) for a, b in zip(i, j, strict=True)], "h double, gamma double")
    nugget, c, a = K.fit_variogram(cloud, float(z.var()))
    for t in (0, 7, 200, 333, 449):
        near = np.lexsort((np.arange(450), far[t]))[: P.NEIGHBOURS]
        model = K.residual_kriging(far[np.ix_(near, near)], z[near], nugget, c, a)
        assert got[t] == pytest.approx(float(model.predict(far[t : t + 1, near])[0]), rel=1e-6, abs=1e-9)
    assert len(got) == 450


def test_variogram_fit_sees_all_lags(spark):
    rng = np.random.default_rng(9)
    h = np.concatenate((np.full(6000, 5.0), rng.choice([10.0, 20.0, 40.0, 80.0, 160.0], 3000)))
    gamma = (0.5 + 3.0 * (1 - np.exp(-h / 30))) * rng.uniform(0.5, 1.5, len(h))
    cloud = spark.createDataFrame([(float(a), float(b)) for a, b in zip(h, gamma, strict=True)], "h double, gamma double").orderBy("h", "gamma")
    assert K.fit_variogram(cloud, 100.0) == pytest.approx(K.fit_exponential(h, gamma, 100.0), rel=1e-6)
    empty = K.fit_variogram(cloud.limit(0), 4.0)
    assert empty == (K.DEFAULT_NUGGET, 4.0, K.DEFAULT_RANGE)


def test_support_vector_queries_take_every_labelled_row(spark, monkeypatch):
    from roadkrige.plans import models as P

    n, train = 700, 630
    rows = spark.range(n).selectExpr("id as road_id", "double(id % 26) as x", "double(id div 26) as y", "double(id % 9) as maxspeed_num", "string(id % 3) as type",
                                     "double(id % 13) + double(id % 9) as aadt_obs", "id % 10 = 0 as is_test", "int(id % 3) as fold").toPandas()
    table = spark.createDataFrame(rows)
    monkeypatch.setattr(P, "labelled", lambda spark, d: (table, table))
    fits, kriged, searched = [], [], []
    fit, krige = M.SVR.fit_arrays, L.krige_spherical
    monkeypatch.setattr(M.SVR, "fit_arrays", lambda self, x, y: fits.append(len(x)) or fit(self, x, y))
    monkeypatch.setattr(L, "krige_spherical", lambda sample, *rest: kriged.append(sample.count()) or krige(sample, *rest))
    monkeypatch.setattr(M, "grid_search", lambda df, columns, label, fold, grid=None: searched.append((df.count(), grid or M.SVR_GRID)))
    P.svr_pred(spark, "")
    assert P.model_compare(spark, "").count() == 6
    P.grid_search(spark, "")
    assert fits == [train, train] and kriged == [train] * 3 and searched == [(n, M.SVR_GRID)]
    with pytest.raises(ValueError, match="at most"):
        M.SVR(["x"]).fit(spark.range(M.SAMPLE_ROWS + 1).selectExpr("double(id) as x", "double(id) as t"), "t")


def test_ridge_and_permutation_take_more_rows_than_a_dense_solver(spark):
    n = M.SAMPLE_ROWS + 1000
    df = spark.range(n).selectExpr("id", "double(id % 17) as a", "double(id * 7 % 23) as b", f"id % 17 * if(id < {M.SAMPLE_ROWS}, 1.0D, 9.0D) + id % 5 as y").orderBy("id")
    rows = df.toPandas()
    whole = M.Ridge(["a", "b"]).fit_arrays(rows[["a", "b"]].to_numpy(float), rows.y.to_numpy(float))
    ridge = M.Ridge(["a", "b"]).fit(df, "y")
    assert ridge.alpha == whole.alpha and np.allclose(ridge.coef, whole.coef) and ridge.centre == pytest.approx(whole.centre)
    counts = []

    def predict(t):
        counts.append((t.count(), t.agg(F.sum("a")).first()[0], t.agg(F.sum("b")).first()[0]))
        return ridge.transform(t)

    got = {r.feature: r.importance_mean for r in M.permutation_importance(df.drop("id"), ["a", "b"], "y", predict, repeats=1).collect()}
    assert set(counts) == {(n, rows.a.sum(), rows.b.sum())} and got["a"] > 0.1 > abs(got["b"])
