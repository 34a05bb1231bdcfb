from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

pytest.importorskip("roadkrige.llm")
from roadkrige.llm import balls  # noqa: E402


def brute(rows, k, rounds, d, seed=balls.SEED, scale=balls.SCALE):
    """Every vector against every centroid, in Python integers."""
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in ok)
    centroids = [list(v) for _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in ok]
        for j in range(len(centroids)):
            own = [v for (_, v), a in zip(ok, at, strict=True) if a == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted((i, nearest(v)[1], nearest(v)[0]) for i, v in ok), centroids


def run(spark, rows, kind="float", **more):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, v string").repartition(5)
    found, centroids = balls.cluster(df, **more)
    return sorted((r.vec_id, r.cluster, int(r.distance)) for r in found.collect()), centroids


def test_equals_comparing_everything(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 0.5, (9, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 9] + rng.normal(0, 0.05 + 0.2 * (i % 2), 8)]) for i in range(600)]
    rows += [(1000 + i, rows[4][1]) for i in range(40)] + [(7, rows[9][1]), (7, rows[9][1])]  # copies and a repeated id
    rows += [(2000, None), (2001, []), (2002, [None] * 8), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (2005, [1.0] * 9), (None, rows[0][1])]
    assert run(spark, rows, k=12, rounds=4, dimensions=8) == brute(rows, 12, 4, 8)


def test_ties_negative_means_and_balls_without_members(spark):
    rows = [(i, [(-1.0) ** i * (i % 5) / 256, (i % 3) / 256 - 1 / 256]) for i in range(60)]  # few different vectors, many starts
    assert run(spark, rows, k=30, rounds=3, dimensions=2) == brute(rows, 30, 3, 2)


def test_fewer_vectors_than_centroids_and_empty_tables(spark):
    rows = [(1, [0.5, 1.0]), (2, [-0.5, 0.0])]
    got, centroids = run(spark, rows, k=5, rounds=2, dimensions=2)
    assert (got, centroids) == brute(rows, 5, 2, 2) and len(centroids) == 2
    assert run(spark, rows[:0], k=5, rounds=2, dimensions=2) == ([], [])


def test_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 3) * 10.0 ** (i % 38)]) for i in range(80)]
    got, centroids = run(spark, rows, k=6, rounds=3, dimensions=3)
    want, there = brute(rows, 6, 3, 3)
    assert centroids == there and got == [(i, c, min(d, balls.LIMB)) for i, c, d in want]


def test_most_distances_are_not_computed():
    rng = np.random.default_rng(2)
    centres = np.floor(rng.normal(0, 4000, (40, 16)))
    v = centres[rng.integers(0, 40, 4000)] + np.floor(rng.normal(0, 300, (4000, 16)))
    own = ((v[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    radii = [balls._up(int(((v[own == i] - centres[i]) ** 2).sum(1).max(initial=0))) for i in range(40)]
    ball = balls.Balls(centres.astype(int).tolist(), radii)
    at, best, compared = ball.assign(v, own)
    assert (at == own).all() and (best == ((v - centres[own]) ** 2).sum(1)).all()
    assert compared < 2 * len(v) and sum(len(n) for n, _ in ball.near) < 40 * 39


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    want = con.sql(balls.ORACLE_SQL["op11_ball_kmeans"])
    got = balls.op11_ball_kmeans(spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
