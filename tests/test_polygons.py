"""Polygons with holes, crossings and islands, against points, pixels and fine steps."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadkrige.operators import polygons as P
from roadkrige.sources import geojson

SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
HOLE = [(2, 2), (6, 2), (6, 7), (2, 7), (2, 2)]
ISLAND = [(3, 3), (5, 3), (5, 5), (3, 5), (3, 3)]
BOW = [(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)]


def even_odd(rings, x, y):
    n = np.zeros(np.shape(x), dtype=int)
    for r in rings:
        r = np.asarray(r, float)
        for (ax, ay), (bx, by) in zip(r, np.roll(r, -1, 0), strict=True):
            spans = (ay > y) != (by > y)
            with np.errstate(divide="ignore", invalid="ignore"):
                n += spans & (ax + (y - ay) * (bx - ax) / (by - ay) > x)
    return n % 2 == 1


def area(polygon):
    of = lambda r: abs(P._signed(r))
    return of(polygon[0]) - sum(map(of, polygon[1:]))


def shapes(seed):
    rng = np.random.default_rng(seed)
    if seed % 3 == 0:  # any closed walk, on a grid so that corners and edges meet
        return [[tuple(p) for p in rng.integers(0, 7, (9, 2)).astype(float)] for _ in range(2)]
    if seed % 3 == 1:
        return [[tuple(p) for p in rng.uniform(0, 10, (12, 2))] for _ in range(2)]
    turn, out = np.sort(rng.uniform(0, 2 * np.pi, 14)), []
    for scale in (1.0, 0.4):  # a star with a star inside
        r = scale * rng.uniform(2, 5, 14)
        out.append([(5 + a, 5 + b) for a, b in zip(r * np.cos(turn), r * np.sin(turn), strict=True)])
    return out


def test_known_repairs():
    two = P.simple_polygons([BOW])
    assert sorted(map(area, two)) == pytest.approx([25, 25]) and [len(p) for p in two] == [1, 1]
    holed = P.simple_polygons([SQUARE, HOLE])
    assert [len(p) for p in holed] == [2] and area(holed[0]) == pytest.approx(80)
    island = P.simple_polygons([ISLAND, SQUARE, HOLE[::-1]])
    assert sorted(map(area, island)) == pytest.approx([4, 80]) and sorted(map(len, island)) == [1, 2]
    assert P.simple_polygons([SQUARE, SQUARE]) == [] == P.simple_polygons([]) == P.simple_polygons([[(0, 0), (1, 1), (0, 0)], [(1, 1)]])
    beside = P.simple_polygons([SQUARE, [(10, 0), (20, 0), (20, 10), (10, 10)]])  # an edge in common goes; the last ring is not closed
    assert [area(p) for p in beside] == pytest.approx([200]) and len(beside[0]) == 1
    touching = P.simple_polygons([SQUARE, [(0, 5), (4, 3), (4, 7), (0, 5)]])
    assert sum(map(area, touching)) == pytest.approx(92)


@pytest.mark.parametrize("seed", range(60))
def test_repair_keeps_the_even_odd_inside(seed):
    rings = shapes(seed)
    simple = P.simple_polygons([np.array(r) for r in rings])
    rng = np.random.default_rng(seed + 1000)
    x, y = rng.uniform(-0.5, 10.5, (2, 4000))
    inside = np.array([even_odd([r[:-1] for r in p], x, y) for p in simple])
    assert (inside.sum(0) == even_odd(rings, x, y)).all()  # in one polygon each
    again = P.simple_polygons([r for p in simple for r in p])
    assert sum(map(area, again)) == pytest.approx(sum(map(area, simple))) and all(P._signed(p[0]) > 0 > P._signed(h) for p in simple for h in p[1:])


def as_rows(spark, polygons):
    rings = [(i, [[{"x": float(x), "y": float(y)} for x, y in [*r, r[0]]] for r in p]) for i, p in enumerate(polygons)]
    return spark.createDataFrame(rings, "zone_id long, rings array<array<struct<x:double,y:double>>>")


def test_overlay_and_mean_along_lines(spark):
    polygons = [shapes(s) for s in range(12)]
    rng = np.random.default_rng(1)
    lines = [rng.uniform(-2, 12, (rng.integers(2, 6), 2)) for _ in range(15)]
    pts = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in p]) for i, p in enumerate(lines)], "road_id long, pts array<struct<x:double,y:double>>")
    got = {(r.road_id, r.zone_id): r.m for r in P.line_overlay(pts, as_rows(spark, polygons), 5.0, "road_id", "zone_id").collect()}
    for i, p in enumerate(lines):
        for j, rings in enumerate(polygons):
            want = 0.0
            for a, b in zip(p, p[1:], strict=False):
                at = a + (np.arange(4000)[:, None] + 0.5) / 4000 * (b - a)
                want += even_odd(rings, at[:, 0], at[:, 1]).mean() * np.hypot(*(b - a))
            assert got.get((i, j), 0.0) == pytest.approx(want, abs=0.05)
    zones = as_rows(spark, polygons).withColumn("population", F.col("zone_id") * 10.0)
    mean = {r.road_id: r.population for r in P.weighted_mean(pts, zones, 5.0, "road_id", "zone_id", "population").collect()}
    for i in range(len(lines)):
        met = {j: m for (r, j), m in got.items() if r == i}
        assert mean[i] == pytest.approx(sum(10.0 * j * m for j, m in met.items()) / sum(met.values()) if met else 0.0)


def test_mask_mean(spark):
    polygons = [shapes(s) for s in range(20)] + [[[(0.9, 0.9), (0.95, 0.9), (0.95, 0.95)]], [SQUARE[:-1], HOLE[:-1], ISLAND[:-1]]]
    rng = np.random.default_rng(2)
    value = np.where(rng.uniform(size=(30, 30)) < 0.1, np.nan, rng.uniform(0, 9, (30, 30)))
    pixels = spark.createDataFrame([(r, c, None if np.isnan(value[r, c]) and c % 2 else float(value[r, c])) for r in range(30) for c in range(30)], "row int, col int, value double")
    got = {r.zone_id: (r["mean"], r.n) for r in P.mask_mean(as_rows(spark, polygons), pixels, "zone_id", -1.0317, 11.0729, 0.4).collect()}
    x, y = np.meshgrid(-1.0317 + (np.arange(30) + 0.5) * 0.4, 11.0729 - (np.arange(30) + 0.5) * 0.4)
    for i, rings in enumerate(polygons):
        hit = even_odd(rings, x, y) & ~np.isnan(value)
        assert (i in got) == hit.any() and (not hit.any() or got[i] == (pytest.approx(value[hit].mean()), hit.sum()))


def test_reader_keeps_holes_and_splits_crossings(spark, tmp_path):
    import json

    geometries = [{"type": "Polygon", "coordinates": [SQUARE, HOLE]}, {"type": "MultiPolygon", "coordinates": [[SQUARE, HOLE], [[(20 + x, y) for x, y in SQUARE]]]},
                  {"type": "Polygon", "coordinates": [BOW]}, {"type": "LineString", "coordinates": [(0, 0), (1, 1)]}, None, {"type": "Polygon", "coordinates": []}]
    features = [{"type": "Feature", "properties": {"zone_id": i}, "geometry": g} for i, g in enumerate(geometries)]
    (tmp_path / "z.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    zones = geojson.polygons_of(geojson.read_geojson(spark, str(tmp_path / "z.geojson")))
    got = sorted((r.zone_id, r.n, r.a) for r in zones.select("zone_id", F.size("rings").alias("n"), P.polygon_area(F.col("rings")).alias("a")).collect())
    assert got == [(0, 2, 80.0), (1, 1, 100.0), (1, 2, 80.0), (2, 1, 25.0), (2, 1, 25.0)]
    roads = spark.createDataFrame([(7, [{"x": 0.0, "y": 4.0}, {"x": 10.0, "y": 4.0}])], "road_id long, pts array<struct<x:double,y:double>>")
    assert P.line_overlay(roads, zones.filter("zone_id = 0"), 5.0, "road_id", "zone_id").first().m == pytest.approx(6.0)


def near_share(points, r, x, y):
    p = np.asarray(points, float)
    best = np.full(x.shape, np.inf)
    for a, b in zip(p, p[1:] if len(p) > 1 else p, strict=False):
        d, w = b - a, np.stack((x, y), -1) - a
        t = np.clip((w @ d) / max(d @ d, 1e-300), 0, 1)
        best = np.minimum(best, np.hypot(*np.moveaxis(w - t[..., None] * d, -1, 0)))
    return (best <= r).mean()


@pytest.mark.parametrize("seed", range(25))
def test_area_around_a_bent_line(seed):
    rng = np.random.default_rng(seed)
    points = rng.uniform(0, 10, (rng.integers(2, 9), 2)) if seed % 2 else rng.integers(0, 5, (7, 2)).astype(float)
    step = 22 / 1200  # a place anywhere in each small square
    x, y = np.meshgrid(np.arange(1200), np.arange(1200))
    x, y = (-6 + step * (v + rng.uniform(size=v.shape)) for v in (x, y))
    for r in (0.3, 2.0, 5.5):
        assert P.area_around(points, r) == pytest.approx(near_share(points, r, x, y) * 22 * 22, rel=4e-3)


def test_area_around_closed_forms():
    line = [(0, 0), (7, 0), (7, 24)]
    assert P.area_around(line[:2], 2.0) == pytest.approx(28 + 4 * np.pi, rel=1e-12)
    assert P.area_around(line, 2.0) == pytest.approx(4 * 31 + 4 * np.pi + 4 * (np.pi / 4 - 1), rel=1e-9)  # outer sector, inner overlap
    assert P.area_around([*line, *line[::-1], (3, 0)], 2.0) == pytest.approx(P.area_around(line, 2.0), rel=1e-9)  # there and back
    assert P.area_around([(0, 0), (3, 0), (1, 0), (7, 0)], 1.0) == pytest.approx(14 + np.pi, rel=1e-9)  # pieces on one another
    ring = [(0, 0), (20, 0), (20, 20), (0, 20), (0, 0)]
    assert P.area_around(ring, 3.0) == pytest.approx(4 * 20 * 3 + 9 * np.pi + 400 - 14 * 14, rel=1e-9)  # a courtyard stays open
    assert P.area_around([(1, 1)], 2.0) == pytest.approx(4 * np.pi) == P.area_around([(1, 1), (1, 1)], 2.0)
    assert P.area_around([], 2.0) == 0.0


def test_areas_column(spark):
    lines = [[(0, 0), (7, 0), (7, 24)], [(0, 0), (7, 24)], [(5, 5)], []]
    df = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in p]) for i, p in enumerate(lines)] + [(4, None)], "id long, pts array<struct<x:double,y:double>>")
    got = {r.id: r.a for r in df.select("id", P.line_buffer_area(F.col("pts"), 2.0).alias("a")).collect()}
    assert got == {**{i: pytest.approx(P.area_around(p, 2.0)) for i, p in enumerate(lines)}, 4: None}


def test_overlay_lists_no_polygon_cells_for_a_pair_and_spreads_its_work(spark):
    square = [[(0.0, 0.0), (40.0, 0.0), (40.0, 40.0), (0.0, 40.0), (0.0, 0.0)]]
    lines = spark.range(2000).selectExpr("id as road_id", "array(named_struct('x', double(id % 50), 'y', double(id div 50)), named_struct('x', double(id % 50 + 1), 'y', double(id div 50))) as pts")
    met = P.line_overlay(lines, as_rows(spark, [square]), 1.0, "road_id", "zone_id")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "array_intersect" not in plan and "BroadcastHashJoin" not in plan and "REPARTITION_BY_NUM" in plan
    rows = met.collect()
    assert len(rows) == len({r.road_id for r in rows}) and {r.m for r in rows} == {1.0}
    assert {r.road_id for r in rows if 0 < r.road_id // 50} == {i for i in range(50, 2000) if i % 50 < 40}


def test_shifted_lines_share_their_area(monkeypatch):
    called, head = [], P.area_around
    monkeypatch.setattr(P, "area_around", lambda points, r: called.append(1) or head(points, r))
    lines = [[(100.0 * i, 0.0), (100.0 * i, 100.0), (100.0 * i + 100.0, 100.0)] for i in range(50)] + [None, [(0.0, 0.0), (5.0, 9.0), (20.0, 0.0)], []]
    got = P.areas_around(lines, 20.0)
    assert got == [None if v is None else pytest.approx(head(v, 20.0)) for v in lines] and len(called) == 3
