"""Planar geometry as Column expressions over arrays of (x, y) structs.

A line is an array<struct<x, y>>, a multi-part line an array of lines, a
polygon an array of rings.  Everything here stays in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c))


def point(x, y) -> Column:
    return F.struct(_col(x).cast("double").alias("x"), _col(y).cast("double").alias("y"))


def line(*points) -> Column:
    return F.array(*[point(x, y) for x, y in points])


def pieces(pts: Column) -> Column:
    """The straight pieces of a line: array<struct<a, b>>."""
    n = F.greatest(F.size(pts) - 1, F.lit(0))
    ahead, behind = F.slice(pts, 1, n), F.slice(pts, 2, n)
    return F.zip_with(ahead, behind, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def line_pieces(pts: Column) -> Column:
    """The same as ``pieces``; straight lines, the common case, need no walk over an array."""
    return F.when(F.size(pts) == 2, F.array(F.struct(pts[0].alias("a"), pts[1].alias("b")))).otherwise(pieces(pts))


def distance2(ax, ay, bx, by) -> Column:
    dx, dy = _col(ax) - _col(bx), _col(ay) - _col(by)
    return dx * dx + dy * dy


def point_distance(a: Column, b: Column) -> Column:
    return F.sqrt(distance2(a["x"], a["y"], b["x"], b["y"]))


def length(pts: Column) -> Column:
    return F.aggregate(pieces(pts), F.lit(0.0), lambda acc, s: acc + point_distance(s["a"], s["b"]))


def centroid(pts: Column) -> Column:
    """Length-weighted centroid of a line; its first point where the length is 0."""

    def grow(acc, s):
        w = point_distance(s["a"], s["b"])
        mid = lambda c: (s["a"][c] + s["b"][c]) / 2
        return F.struct((acc["w"] + w).alias("w"), (acc["x"] + w * mid("x")).alias("x"), (acc["y"] + w * mid("y")).alias("y"))

    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = lambda acc: F.when(acc["w"] > 0, point(acc["x"] / acc["w"], acc["y"] / acc["w"])).otherwise(F.element_at(pts, 1))
    return F.when(F.size(pts) > 0, F.aggregate(pieces(pts), zero, grow, total))


def midpoint(pts: Column, share: float = 0.5) -> Column:
    """The point at ``share`` of the way along a line."""
    goal = length(pts) * share

    def walk(acc, s):
        w = point_distance(s["a"], s["b"])
        t = F.when(w > 0, (goal - acc["done"]) / w).otherwise(0.0)
        at = point(s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"]), s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"]))
        here = acc["at"].isNull() & (acc["done"] + w >= goal)
        return F.struct((acc["done"] + w).alias("done"), F.when(here, at).otherwise(acc["at"]).alias("at"))

    zero = F.struct(F.lit(0.0).alias("done"), F.lit(None).cast("struct<x:double,y:double>").alias("at"))
    return F.coalesce(F.aggregate(pieces(pts), zero, walk, lambda acc: acc["at"]), F.element_at(pts, -1))


def point_piece_distance2(x, y, ax, ay, bx, by) -> Column:
    """Squared distance of a point to the straight piece from a to b."""
    x, y, ax, ay, bx, by = map(_col, (x, y, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((x - ax) * dx + (y - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    px, py = x - (ax + t * dx), y - (ay + t * dy)
    return px * px + py * py


def point_line_distance(x, y, pts: Column) -> Column:
    each = F.transform(pieces(pts), lambda s: point_piece_distance2(x, y, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]))
    return F.sqrt(F.array_min(each))


def clip_to_circle(cx, cy, r: float, ax, ay, bx, by) -> Column:
    """Length of the straight piece from a to b inside the circle: roots of a quadratic, clamped."""
    cx, cy, ax, ay, bx, by = map(_col, (cx, cy, ax, ay, bx, by))
    dx, dy, fx, fy = bx - ax, by - ay, ax - cx, ay - cy
    a, b, c = dx * dx + dy * dy, 2 * (fx * dx + fy * dy), fx * fx + fy * fy - r * r
    root = F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))
    t0 = F.greatest(F.lit(0.0), (-b - root) / F.nullif(2 * a, F.lit(0.0)))
    t1 = F.least(F.lit(1.0), (-b + root) / F.nullif(2 * a, F.lit(0.0)))
    inside = (b * b - 4 * a * c > 0) & (t1 > t0)
    return F.when(inside, (t1 - t0) * F.sqrt(a)).otherwise(0.0)


def clip_to_box(ax, ay, bx, by, x0, y0, x1, y1) -> Column:
    """Length of the straight piece from a to b inside an axis-parallel box (Liang-Barsky)."""
    ax, ay, bx, by, x0, y0, x1, y1 = map(_col, (ax, ay, bx, by, x0, y0, x1, y1))
    low, high, out = F.lit(0.0), F.lit(1.0), F.lit(False)
    for a, b, lo, hi in ((ax, bx, x0, x1), (ay, by, y0, y1)):
        d = b - a
        first, last = F.try_divide(lo - a, d), F.try_divide(hi - a, d)
        low = F.greatest(low, F.coalesce(F.least(first, last), F.lit(0.0)))
        high = F.least(high, F.coalesce(F.greatest(first, last), F.lit(1.0)))
        out = out | ((d == 0) & ((a < lo) | (a > hi)))
    return F.when(out | (high <= low), 0.0).otherwise((high - low) * F.sqrt(distance2(ax, ay, bx, by)))


def buffer_area(straight_length, r: float) -> Column:
    """Area within ``r`` of one straight piece."""
    return 2 * r * _col(straight_length) + math.pi * r * r


def ring_area(ring: Column) -> Column:
    return F.abs(F.aggregate(pieces(ring), F.lit(0.0), lambda acc, s: acc + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / 2


def rings_edges(rings: Column) -> Column:
    """The straight pieces of all rings of a polygon."""
    return F.flatten(F.transform(rings, pieces))


def in_ring(x, y, ring: Column) -> Column:
    """Whether a point lies inside a closed ring, by crossings."""
    return inside(x, y, pieces(ring))


def inside(x, y, edges: Column) -> Column:
    """Whether a point lies inside closed rings given as their pieces, by the even-odd rule."""
    x, y = _col(x), _col(y)

    def cross(acc, s):
        a, b = s["a"], s["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + (y - a["y"]) * F.try_divide(b["x"] - a["x"], b["y"] - a["y"])
        return F.when(spans & (x < at), ~acc).otherwise(acc)

    return F.aggregate(edges, F.lit(False), cross)


def representative_point(ring: Column) -> Column:
    """A point inside a ring: the middle of its widest stretch at mid height."""
    ys = F.transform(ring, lambda p: p["y"])
    # between two vertex heights, so that no vertex lies on the scan line
    levels = F.array_sort(F.array_distinct(ys))
    n = F.size(levels)
    mid = (F.array_min(ys) + F.array_max(ys)) / 2
    above, below = F.array_min(F.filter(levels, lambda v: v > mid)), F.array_max(F.filter(levels, lambda v: v <= mid))
    y = F.when(n > 1, (above + below) / 2).otherwise(mid)
    hits = F.transform(
        F.filter(pieces(ring), lambda s: (s["a"]["y"] > y) != (s["b"]["y"] > y)),
        lambda s: s["a"]["x"] + (y - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"]) / (s["b"]["y"] - s["a"]["y"]),
    )
    hits = F.array_sort(hits)
    spans = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(hits) - 1, F.lit(1)), F.lit(2)),
        lambda i: F.struct((F.try_element_at(hits, i + 1) - F.try_element_at(hits, i)).alias("w"), ((F.try_element_at(hits, i + 1) + F.try_element_at(hits, i)) / 2).alias("x")),
    )
    return F.when(F.size(hits) > 1, point(F.array_max(spans)["x"], y)).otherwise(F.element_at(ring, 1))


# Transverse Mercator (UTM) on WGS 84 by the Krueger series in the third flattening.
_A, _F, _K0, _EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
_N = _F / (2 - _F)
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm_forward(lon, lat, zone: int = 47, south: bool = False) -> Column:
    """Degrees to metres, as a point."""
    lon, lat = _col(lon), _col(lat)
    e = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = F.radians(lat), F.radians(lon - F.lit(float(6 * zone - 183)))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for i, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * i * xi) * F.sinh(2 * i * eta)
        y = y + a * F.sin(2 * i * xi) * F.cosh(2 * i * eta)
    return point(_EAST + _K0 * _R * x, (10_000_000.0 if south else 0.0) + _K0 * _R * y)


def utm_inverse(x, y, zone: int = 47, south: bool = False) -> Column:
    """Metres to degrees, as a point (x: longitude, y: latitude)."""
    xi = (_col(y) - (10_000_000.0 if south else 0.0)) / (_K0 * _R)
    eta = (_col(x) - _EAST) / (_K0 * _R)
    xi1, eta1 = xi, eta
    for i, b in enumerate(_BETA, 1):
        xi1 = xi1 - b * F.sin(2 * i * xi) * F.cosh(2 * i * eta)
        eta1 = eta1 - b * F.cos(2 * i * xi) * F.sinh(2 * i * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for i, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * i * chi)
    lam = F.atan2(F.sinh(eta1), F.cos(xi1))
    return point(F.degrees(lam) + float(6 * zone - 183), F.degrees(phi))


def reproject(pts: Column, transform) -> Column:
    """A line with ``transform(x, y)`` applied to every vertex."""
    return F.transform(pts, lambda p: transform(p["x"], p["y"]))
