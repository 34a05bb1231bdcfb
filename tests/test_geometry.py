from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from roadkrige.functions import geometry as G
from roadkrige.operators import spatial as S


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_measures(spark):
    bent = G.line((0, 0), (3, 4), (3, 10))
    assert value(spark, G.length(bent)) == 11.0
    c = value(spark, G.centroid(bent))
    assert (c.x, c.y) == pytest.approx(((1.5 * 5 + 3 * 6) / 11, (2 * 5 + 7 * 6) / 11))
    m = value(spark, G.midpoint(bent))
    assert (m.x, m.y) == pytest.approx((3, 4.5))
    still = G.line((2, 2), (2, 2))
    assert value(spark, G.length(still)) == 0 and tuple(value(spark, G.centroid(still))) == (2, 2) and tuple(value(spark, G.midpoint(still))) == (2, 2)
    assert value(spark, G.point_line_distance(F.lit(5.0), F.lit(7.0), bent)) == 2.0
    assert value(spark, G.buffer_area(F.lit(10.0), 2.0)) == pytest.approx(40 + 4 * math.pi)


@pytest.mark.parametrize("piece,want", [((-10, 0, 10, 0), 6.0), ((0, 0, 10, 0), 3.0), ((-1, 0, 1, 0), 2.0), ((-10, 3, 10, 3), 0.0), ((5, 5, 9, 9), 0.0), ((0, 0, 0, 0), 0.0)])
def test_clip_to_circle(spark, piece, want):
    assert value(spark, G.clip_to_circle(0.0, 0.0, 3.0, *map(float, piece))) == pytest.approx(want)


def test_polygons(spark):
    square = G.line((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
    notch = G.line((0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6), (0, 0))
    assert value(spark, G.ring_area(square)) == 16 and value(spark, G.ring_area(notch)) == 28
    assert value(spark, G.in_ring(F.lit(1.0), F.lit(5.0), notch)) and not value(spark, G.in_ring(F.lit(3.0), F.lit(5.0), notch))
    p = value(spark, G.representative_point(notch))
    assert value(spark, G.in_ring(F.lit(p.x), F.lit(p.y), notch))
    through = G.line((-1, 4), (7, 4))
    assert value(spark, S.overlay_length(through, notch)) == pytest.approx(4.0)
    assert value(spark, S.overlay_length(through, square)) == pytest.approx(0.0, abs=4)
    assert value(spark, G.clip_to_box(-1.0, 2.0, 9.0, 2.0, 0.0, 0.0, 4.0, 4.0)) == pytest.approx(4.0)


def test_projection_round_trip_and_published_value(spark):
    p = value(spark, G.utm_forward(99.0, 45.0))
    assert p.x == pytest.approx(500000) and p.y == pytest.approx(4982950.400, abs=2e-3)
    for lon, lat in ((100.5, 13.75), (97.1, 20.0), (101.9, 5.5)):
        x = value(spark, G.utm_forward(lon, lat))
        back = value(spark, G.utm_inverse(F.lit(x.x), F.lit(x.y)))
        assert (back.x, back.y) == pytest.approx((lon, lat), abs=1e-8)


def brute_distance(pts, x, y):
    best = math.inf
    for (ax, ay), (bx, by) in zip(pts, pts[1:], strict=False):
        dx, dy = bx - ax, by - ay
        t = 0 if dx == dy == 0 else max(0, min(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
        best = min(best, math.hypot(x - ax - t * dx, y - ay - t * dy))
    return best


@pytest.fixture(scope="module")
def random_map(spark):
    import random

    rng = random.Random(3)
    lines = [(i, [(rng.uniform(-500, 500), rng.uniform(-500, 500)) for _ in range(rng.randint(2, 4))]) for i in range(60)] + [(99, [(7.0, 7.0), (7.0, 7.0)])]
    points = [(i, rng.uniform(-600, 600), rng.uniform(-600, 600)) for i in range(150)]
    schema = "id long, pts array<struct<x:double,y:double>>"
    return lines, points, spark.createDataFrame(lines, schema), spark.createDataFrame(points, "pid long, x double, y double")


@pytest.mark.parametrize("radius", [5.0, 60.0, 400.0])
def test_grid_join_equals_brute_force(random_map, radius):
    lines, points, ldf, pdf = random_map
    got = sorted((r.id, r.pid) for r in S.within_join(ldf, pdf, radius).collect())
    assert got == sorted((i, p) for i, pts in lines for p, x, y in points if brute_distance(pts, x, y) <= radius)


def test_nearest_equals_brute_force(random_map):
    lines, points, ldf, pdf = random_map
    got = {r.id: (r.pid, r.distance) for r in S.nearest_join(ldf, pdf, "id", "pid", start=3.0).collect()}
    for i, pts in lines:
        d, p = min((brute_distance(pts, x, y), p) for p, x, y in points)
        assert got[i][0] == p and got[i][1] == pytest.approx(d)
    assert S.nearest_join(ldf, pdf.limit(0), "id", "pid").count() == 0


def test_strict_and_closed_radius(spark):
    line = spark.createDataFrame([(1, [(0.0, 0.0), (10.0, 0.0)])], "id long, pts array<struct<x:double,y:double>>")
    at = spark.createDataFrame([(1, 5.0, 3.0), (2, 13.0, 0.0), (3, 5.0, 2.9), (4, None, 1.0)], "pid long, x double, y double")
    assert sorted(r.pid for r in S.within_join(line, at, 3.0, strict=True).collect()) == [3]
    assert sorted(r.pid for r in S.within_join(line, at, 3.0).collect()) == [1, 2, 3]


def test_boxes_meet_once(spark):
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (30.0, 30.0)])], "id long, pts array<struct<x:double,y:double>>")
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 20.0, 20.0), (2, 90.0, 90.0, 95.0, 95.0)], "z long, x0 double, y0 double, x1 double, y1 double")
    assert [r.z for r in S.box_join(lines, boxes, 5.0).collect()] == [1]


def _clipped(cx, cy, r, pts):
    """Length of a line inside a circle, from the distances along each piece at which it crosses the border."""
    total = 0.0
    for (ax, ay), (bx, by) in zip(pts, pts[1:]):
        n = math.hypot(bx - ax, by - ay)
        if n:
            ux, uy = (bx - ax) / n, (by - ay) / n
            along, off = (cx - ax) * ux + (cy - ay) * uy, (cx - ax) * uy - (cy - ay) * ux
            half = math.sqrt(max(r * r - off * off, 0.0))
            total += max(0.0, min(n, along + half) - max(0.0, along - half))
    return total


@pytest.mark.parametrize("include_self", [True, False])
def test_road_density_of_bent_long_and_odd_lines(spark, include_self):
    from roadkrige.operators.features import road_density

    rng = random.Random(7)
    lines = {i: [(rng.uniform(-900, 900), rng.uniform(-900, 900)) for _ in range(rng.choice((2, 2, 3, 6)))] for i in range(60)}
    lines |= {100 + i: [(x, y), (x + 100.0, y)] for i, (x, y) in enumerate((a * 100.0, b * 100.0) for a in range(-4, 4) for b in range(-4, 4))}  # some touch a circle only
    lines |= {200: [(5000.0, 5000.0), (5000.0, 5300.0)], 201: [(50.0, 0.0)], 202: [(50.0, 0.0), (50.0, 0.0), (50.0, 40.0)], 203: [(1.0, 1.0), (1.0, 1.0)]}
    rows = [(i, [{"x": x, "y": y} for x, y in pts]) for i, pts in lines.items()] + [(300, []), (301, None)]
    df = spark.createDataFrame(rows, "road_id long, pts array<struct<x: double, y: double>>")
    got = {r.road_id: r for r in road_density(df, radius=300.0, include_self=include_self).collect()}
    assert set(got) == {*lines, 300, 301} and got[300].road_length_in_R_m == got[301].road_density == 0.0
    for i, pts in lines.items():
        spans = [(math.dist(a, b), (a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(pts, pts[1:])]
        n = sum(s[0] for s in spans)
        cx, cy = (sum(s[0] * s[k] for s in spans) / n for k in (1, 2)) if n else pts[0]
        want = sum(_clipped(cx, cy, 300.0, other) for j, other in lines.items() if include_self or j != i)
        assert got[i].seg_len_m == pytest.approx(n)
        assert got[i].road_length_in_R_m == pytest.approx(want, abs=1e-6) and got[i].road_density == pytest.approx(want / 1000 / (math.pi * 0.09), abs=1e-8)


def test_road_density_walks_no_array_for_a_pair_and_deals_out_its_segments(spark):
    from roadkrige.operators.features import road_density

    df = spark.range(50).selectExpr("id as road_id", "array(named_struct('x', id * 10.0D, 'y', 0.0D), named_struct('x', id + 1.0D, 'y', 5.0D)) as pts").coalesce(1)
    plan = road_density(df)._jdf.queryExecution().executedPlan().toString().splitlines()
    last = max(n for n, line in enumerate(plan) if "SortMergeJoin [_i" in line)
    assert not any("lambdafunction" in line for line in plan[: last + 1] if "Join" in line or "clip" in line)
    # each walk over a segment is in a row that is generated once, after the rows of the file's one task are dealt out
    walks = [n for n, line in enumerate(plan) if "lambdafunction" in line]
    assert walks and all("Generate explode" in plan[n] for n in walks)
    assert all(any("REPARTITION_BY_NUM" in line for line in plan[n : n + 4]) for n in walks)
