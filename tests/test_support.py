"""Support vector regression over any number of rows against the dense solver."""

from __future__ import annotations

import numpy as np
import pytest

from roadkrige.operators import models as M
from roadkrige.operators import support as S


def town(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack((rng.integers(1, 50, n), rng.uniform(0, 9000, n), rng.uniform(0, 9000, n))).astype(float)
    y = 25000 + 3000 * np.sin(x[:, 1] / 1500) + 40 * x[:, 0] + rng.normal(0, 2500, n)
    rows = [(*map(float, r), float(t), i % 3) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "a double, b double, c double, y double, fold int")


@pytest.mark.parametrize("setting", [{}, {"C": 10.0, "epsilon": 0.3, "gamma": 0.03}])
def test_wide_solver_reaches_the_least_loss(spark, setting):
    """The loss of no dense fit is lower, and more sweeps bring those nearer."""
    x, y, df = town(spark, 200)
    wide = M.WideSVR(["a", "b", "c"], **setting).fit(df, "y")
    t, at = (y - y.mean()) / y.std(), wide.at
    loss = lambda f, size: size / 2 + wide.C * np.maximum(np.abs(t - f) - wide.epsilon, 0).sum()
    least, apart = loss(wide.basis.features(x) @ at, at @ at), []
    for sweeps in (20, 1500):
        dense = M.SVR(["a", "b", "c"], sweeps=sweeps, **setting).fit_arrays(x, y)
        f = (dense.predict_arrays(x) - y.mean()) / y.std()
        apart.append(loss(f, dense.beta @ dense._kernel(dense.support, dense.support) @ dense.beta) / least - 1)
    assert -1e-5 < apart[1] < 0.01 and apart[1] < apart[0]
    assert np.allclose([r.pred for r in wide.transform(df).collect()], wide.predict_arrays(x))


def test_rows_that_the_sample_misses_become_pivots(spark, monkeypatch):
    x, y, df = town(spark, 300)
    monkeypatch.setattr(S, "SAMPLE", 20)
    basis = S.Fits(df, ["a", "b", "c"], "y", [{"gamma": 0.1}]).bases[0]
    z = (x - basis.mean) / basis.scale
    mapped = basis.features(x)[:, :-1]
    assert len(basis.centres) > 20 and np.abs(mapped @ mapped.T - S.rbf(z, z, 0.1)).max() < 1e-7


def test_queries_have_no_limit_of_rows(spark, monkeypatch):
    x, y, df = town(spark, 240)
    fold, grid, want = np.arange(240) % 3, {"C": (1.0,), "epsilon": (0.1,), "gamma": ("scale", 0.1)}, []
    for gamma in grid["gamma"]:  # more sweeps than the search's: those leave it short of the least loss
        fits = [(f, M.SVR(["a", "b", "c"], gamma=gamma, sweeps=3000).fit_arrays(x[fold != f], y[fold != f])) for f in range(3)]
        want.append(np.mean([M.score_r2(y[fold == f], m.predict_arrays(x[fold == f])) for f, m in fits]))
    monkeypatch.setattr(M, "SAMPLE_ROWS", 200)
    assert isinstance(M.support_vectors(df, ["a", "b", "c"], "y"), M.WideSVR)
    found = sorted(map(tuple, M.grid_search(df, ["a", "b", "c"], "y", "fold", grid).select("setting", "C", "epsilon", "gamma", "n_folds").collect()))
    assert found == [(0, "1.0", "0.1", "scale", 3), (1, "1.0", "0.1", "0.1", 3)]
    assert [r.mean_r2 for r in M.grid_search(df, ["a", "b", "c"], "y", "fold", grid).orderBy("setting").collect()] == pytest.approx(want, abs=0.02)
