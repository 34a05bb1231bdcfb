"""Polygons with holes: repair, overlay with lines, raster means.

A polygon is a list of closed rings, ``rings``; what is inside is told by the
even-odd rule over all of them, so holes, islands in holes and crossings need no
order.  ``repaired`` turns any such list into simple polygons, a shell with its
holes each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import buffer_area, inside, length, pieces, ring_area, rings_edges
from .spatial import box_join, overlay_edges

SNAP = 1e-11  # of a polygon's extent: places nearer than that are one
BLOCK = 1 << 20  # pairs of edges compared at once
_RINGS = "array<array<struct<x:double,y:double>>>"


def boxed(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """The bounding box of each polygon as x0, y0, x1, y1; polygons without a place are left out."""
    places = F.flatten(F.col(rings))
    along = lambda c: F.transform(places, lambda p: p[c])
    out = polygons.withColumns({"x0": F.array_min(along("x")), "y0": F.array_min(along("y")), "x1": F.array_max(along("x")), "y1": F.array_max(along("y"))})
    return out.filter("x0 is not null and y0 is not null")


def polygon_area(rings: Column) -> Column:
    """Area of a simple polygon: its first ring less the others."""
    rest = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return F.when(F.size(rings) > 0, ring_area(F.element_at(rings, 1)) - F.aggregate(rest, F.lit(0.0), lambda a, r: a + ring_area(r)))


def line_overlay(lines: DataFrame, polygons: DataFrame, cell: float, line_id: str, polygon_id: str) -> DataFrame:
    """line_id, polygon_id, m: the length of each line (``pts``) inside each polygon (``rings``) it meets."""
    pairs = box_join(lines.select(line_id, "pts"), boxed(polygons.select(polygon_id, "rings")), cell)
    # a row for each length: what filters name is not worked out again for them
    met = F.explode(F.array(overlay_edges(F.col("pts"), rings_edges(F.col("rings")))))
    return pairs.select(line_id, polygon_id, met.alias("m")).filter("m > 0")


def weighted_mean(lines: DataFrame, polygons: DataFrame, cell: float, line_id: str, polygon_id: str, value: str) -> DataFrame:
    """Length-weighted mean of the polygons' ``value`` along each line; 0 outside all of them."""
    met = line_overlay(lines, polygons, cell, line_id, polygon_id).join(polygons.select(polygon_id, value), polygon_id)
    mean = met.groupBy(line_id).agg(F.try_divide(F.sum(F.col(value) * F.col("m")), F.sum("m")).alias(value))
    return lines.select(line_id).join(mean, line_id, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def pixel_runs(polygons: DataFrame, polygon_id: str, x_min: float, y_max: float, pixel: float) -> DataFrame:
    """polygon_id, row, first, last: the pixels whose centres lie inside, as runs of columns.

    A scan line through the centres of a pixel row meets the edges in places
    that, sorted, bound the inside in pairs.
    """
    lines = boxed(polygons.select(polygon_id, "rings")).select(
        polygon_id, rings_edges(F.col("rings")).alias("e"), F.ceil((F.lit(y_max) - F.col("y1")) / pixel - 0.5).alias("top"), F.floor((F.lit(y_max) - F.col("y0")) / pixel - 0.5).alias("bottom")
    )
    rows = lines.filter("bottom >= top").select(polygon_id, "e", F.explode(F.sequence("top", "bottom")).alias("row"))
    y = F.lit(y_max) - (F.col("row") + 0.5) * pixel
    met = F.filter("e", lambda s: (s["a"]["y"] > y) != (s["b"]["y"] > y))
    places = F.array_sort(F.transform(met, lambda s: s["a"]["x"] + (y - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"]) / (s["b"]["y"] - s["a"]["y"])))
    crossed = rows.withColumn("at", places).filter(F.size("at") > 1)
    # a centre on a left end is inside, on a right end it is not, as with boxes
    first = lambda v: F.ceil((v - x_min) / pixel - 0.5)
    pairs = F.transform(F.sequence(F.lit(1), F.size("at") - 1, F.lit(2)), lambda i: F.struct(first(F.element_at("at", i)).alias("first"), (first(F.element_at("at", i + 1)) - 1).alias("last")))
    return crossed.select(polygon_id, F.col("row").cast("int").alias("row"), F.explode(pairs).alias("run")).select(polygon_id, "row", "run.first", "run.last").filter("last >= first")


def mask_mean(polygons: DataFrame, pixels: DataFrame, polygon_id: str, x_min: float, y_max: float, pixel: float) -> DataFrame:
    """polygon_id, mean, n: of the pixels (row, col, value) whose centres lie inside; pixels without a value do not count."""
    runs = pixel_runs(polygons, polygon_id, x_min, y_max, pixel)
    cells = runs.select(polygon_id, "row", F.explode(F.sequence("first", "last")).alias("col")).withColumn("col", F.col("col").cast("int"))
    known = pixels.filter("value is not null and not isnan(value)").select("row", "col", "value")
    return cells.join(known, ["row", "col"]).groupBy(polygon_id).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def contains(rings: Column, x, y) -> Column:
    return inside(x, y, rings_edges(rings))


# ---------------------------------------------------------------- repair


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def _meetings(a: np.ndarray, b: np.ndarray, near: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(edge, place) of all places where edges (a to b) meet others."""
    low, high = np.minimum(a, b) - near, np.maximum(a, b) + near
    step = max(1, BLOCK // max(1, len(a)))
    for first in range(0, len(a), step):
        some = slice(first, first + step)
        touch = (low[some, None] <= high[None]).all(2) & (high[some, None] >= low[None]).all(2)
        i, j = np.nonzero(touch)
        i, j = i[i + first < j] + first, j[i + first < j]
        r, s, q = b[i] - a[i], b[j] - a[j], a[j] - a[i]
        det = _cross(r, s)
        askew = np.abs(det) > near * np.minimum(np.hypot(*r.T), np.hypot(*s.T))  # else the one keeps to the other's line
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = _cross(q, s) / det, _cross(q, r) / det
        tt, uu = near / np.maximum(np.hypot(*r.T), near), near / np.maximum(np.hypot(*s.T), near)
        hit = askew & (t >= -tt) & (t <= 1 + tt) & (u >= -uu) & (u <= 1 + uu)
        place = a[i[hit]] + np.clip(t[hit], 0, 1)[:, None] * r[hit]
        yield i[hit], place
        yield j[hit], place
        for p, d, end in ((i, r, a[j]), (i, r, b[j]), (j, s, a[i]), (j, s, b[i])):  # along one line: ends of the one on the other
            rel = end - a[p]
            size = np.maximum(np.hypot(*d.T), near)
            on = ~askew & (np.abs(_cross(d, rel)) <= near * size) & ((d * rel).sum(1) > 0) & ((d * rel).sum(1) < size * size)
            yield p[on], end[on]


def cut_edges(a: np.ndarray, b: np.ndarray) -> dict[tuple, int]:
    """Edges (a to b) cut where they meet: how many lie between each two places, whatever their direction."""
    moving = (a != b).any(1)
    a, b = a[moving], b[moving]
    if not len(a):
        return {}
    low = np.minimum(a, b).min(0)
    near = max(float((np.maximum(a, b).max(0) - low).max()) * SNAP, 1e-300)
    cuts: list[list] = [[] for _ in a]
    for edge, place in _meetings(a, b, near):
        for e, p in zip(edge.tolist(), place.tolist(), strict=True):
            cuts[e].append(p)
    known: dict[tuple, tuple] = {}

    def snapped(p) -> tuple:
        """The place that stands for all places next to it."""
        k = tuple(int(round((v - o) / (4 * near))) for v, o in zip(p, low, strict=True))
        for dx in (0, -1, 1):
            for dy in (0, -1, 1):
                if (found := known.get((k[0] + dx, k[1] + dy))) is not None:
                    return found
        return known.setdefault(k, (float(p[0]), float(p[1])))

    for p in a.tolist():
        snapped(p)
    count: dict[tuple, int] = {}
    for e, more in enumerate(cuts):
        way = sorted([a[e].tolist(), *more, b[e].tolist()], key=lambda p, e=e: float(np.dot(np.subtract(p, a[e]), b[e] - a[e])))
        stops = [snapped(p) for p in way]
        for p, q in zip(stops, stops[1:], strict=False):
            if p != q:
                key = (p, q) if p < q else (q, p)
                count[key] = count.get(key, 0) + 1
    return count


def _sides(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the inside lies to the right (of upright edges: at larger x) or above (of level ones)."""
    mid, level = (a + b) / 2, a[:, 1] == b[:, 1]
    out = np.zeros(len(a), dtype=bool)
    step = max(1, BLOCK // max(1, len(a)))
    for x, y, some in ((0, 1, np.flatnonzero(~level)), (1, 0, np.flatnonzero(level))):
        for first in range(0, len(some), step):
            e = some[first : first + step]
            at = mid[e]
            spans = (a[None, :, y] > at[:, None, y]) != (b[None, :, y] > at[:, None, y])
            spans[np.arange(len(e)), e] = False
            with np.errstate(divide="ignore", invalid="ignore"):
                place = a[:, x] + (at[:, None, y] - a[:, y]) * (b[:, x] - a[:, x]) / (b[:, y] - a[:, y])
            out[e] = (spans & (place > at[:, None, x])).sum(1) % 2 == 1
    return out


def _signed(ring: np.ndarray) -> float:
    p = ring - ring[0]
    return float(_cross(p[:-1], p[1:]).sum()) / 2


def _within(ring: np.ndarray, x: float, y: float) -> bool:
    a, b = ring[:-1], ring[1:]
    spans = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[spans], b[spans]
    return bool(((a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])) > x).sum() % 2)


def simple_polygons(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Simple polygons (shell, holes) with the even-odd inside of ``rings`` (n x 2 each).

    Edges are cut where they meet, those that lie on one another cancel in
    pairs, the others are turned so that the inside is on their left, and
    walked; at a crossing the walk turns as far left as it can.
    """
    closed = [np.vstack((r, r[:1])) if len(r) and (r[0] != r[-1]).any() else r for r in (np.asarray(r, float).reshape(-1, 2) for r in rings)]
    closed = [r[np.isfinite(r).all(1)] for r in closed]
    a, b = (np.concatenate([r[s] for r in closed if len(r) > 3] or [np.zeros((0, 2))]) for s in (slice(None, -1), slice(1, None)))
    count = cut_edges(a, b)
    odd = [k for k, n in count.items() if n % 2]
    if not odd:
        return []
    p, q = (np.array([k[i] for k in odd]) for i in (0, 1))
    right = _sides(p, q)
    level = p[:, 1] == q[:, 1]
    up = (q[:, 1] > p[:, 1]) | (level & (q[:, 0] > p[:, 0]))
    # inside at larger x: downwards; inside above: to the right
    forward = np.where(level, right == up, right != up)
    start, end = np.where(forward[:, None], p, q), np.where(forward[:, None], q, p)
    leaving: dict[tuple, list[int]] = {}
    for e, at in enumerate(map(tuple, start.tolist())):
        leaving.setdefault(at, []).append(e)
    angle = np.arctan2(*(end - start).T[::-1])
    free, found = np.ones(len(start), dtype=bool), []
    for first in range(len(start)):
        if not free[first]:
            continue
        ring, e = [start[first]], first
        while free[e]:
            free[e] = False
            ring.append(end[e])
            back = angle[e] + np.pi
            options = [o for o in leaving.get(tuple(end[e].tolist()), []) if free[o] or o == first]
            if not options:
                break
            e = min(options, key=lambda o, back=back: (back - angle[o] - 1e-12) % (2 * np.pi))
        if len(ring) > 3 and (ring[0] == ring[-1]).all():
            found.append(np.array(ring))
    shells = sorted((r for r in found if _signed(r) > 0), key=_signed)
    out = [[s] for s in shells]
    for hole in (r for r in found if _signed(r) < 0):
        x, y = (hole[0] + hole[1]) / 2
        for polygon in out:  # the smallest shell around it
            if _within(polygon[0], x, y):
                polygon.append(hole)
                break
    return out


def repaired(df: DataFrame, rings: str = "rings") -> DataFrame:
    """A row per simple polygon, in ``rings``, other columns repeated; what has no area goes."""

    @F.arrow_udf(f"array<{_RINGS}>")
    def split(column: pa.Array) -> pa.Array:
        def one(value: list | None) -> list:
            parts = simple_polygons([np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2) for ring in value if ring]) if value else []
            return [[[{"x": x, "y": y} for x, y in ring.tolist()] for ring in polygon] for polygon in parts]

        place = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        return pa.array([one(v.as_py()) for v in column], pa.list_(pa.list_(pa.list_(place))))

    return df.withColumn(rings, F.explode(split(F.col(rings))))


# ---------------------------------------------------------------- area around a line


def _outside(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, r: float) -> np.ndarray:
    """Which places are nowhere nearer than ``r`` to the pieces a to b."""
    d = b - a
    size = np.maximum((d * d).sum(1), 1e-300)
    t = np.clip(((x[:, None] - a[:, 0]) * d[:, 0] + (y[:, None] - a[:, 1]) * d[:, 1]) / size, 0, 1)
    far = np.hypot(x[:, None] - a[:, 0] - t * d[:, 0], y[:, None] - a[:, 1] - t * d[:, 1])
    return far.min(1) >= r * (1 - 1e-9)


def area_around(points, r: float) -> float:
    """Area of all places within ``r`` of a line of any shape, exactly.

    Its border is made of arcs around the line's corners and of straight pieces
    beside its pieces.  Both are cut where they meet others; the stretches that
    no piece is nearer to than ``r`` are the border, along which the area is
    summed up.
    """
    p = np.asarray(points, float).reshape(-1, 2)
    if not len(p):
        return 0.0
    origin = p.mean(0)
    p = p - origin
    cut = cut_edges(p[:-1], p[1:])
    if not cut:
        return float(np.pi * r * r)
    a, b = (np.array([k[i] for k in cut]) for i in (0, 1))
    d = b - a
    size = np.hypot(*d.T)
    n = np.stack((d[:, 1], -d[:, 0]), 1) / size[:, None] * r  # to the right of a piece
    # straight stretches with the inside on their left
    start, end = np.concatenate((a + n, b - n)), np.concatenate((b + n, a - n))
    corners = np.unique(np.concatenate((a, b)), axis=0)
    way = end - start
    long_ = np.hypot(*way.T)
    total = 0.0
    for i in range(len(start)):
        # places along the stretch, 0 to 1, where circles and other stretches meet it
        f = start[i] - corners
        half = (f @ way[i]) / long_[i] ** 2
        root = half**2 - ((f * f).sum(1) - r * r) / long_[i] ** 2
        ok = root > 0
        cuts = [np.array([0.0, 1.0]), -half[ok] - np.sqrt(root[ok]), -half[ok] + np.sqrt(root[ok])]
        det, q = _cross(way[i], way), start - start[i]
        ok = np.abs(det) > 1e-12 * long_[i] * long_
        cuts.append(_cross(q[ok], way[ok]) / det[ok])
        t = np.unique(np.clip(np.concatenate(cuts), 0, 1))
        mid = (t[:-1] + t[1:]) / 2
        keep = _outside(start[i, 0] + mid * way[i, 0], start[i, 1] + mid * way[i, 1], a, b, r)
        total += float((np.diff(t) * keep).sum() * _cross(start[i], end[i])) / 2
    for c in corners:
        away = corners - c
        far = np.hypot(*away.T)
        ok = (far > 0) & (far < 2 * r)
        at, turn = np.arctan2(away[ok, 1], away[ok, 0]), np.arccos(np.clip(far[ok] / (2 * r), -1, 1))
        f = start - c
        half, size2 = (f * way).sum(1) / long_**2, long_**2
        root = half**2 - ((f * f).sum(1) - r * r) / size2
        on = root > -1e-12  # a stretch may only touch the circle
        chord = np.sqrt(np.where(root[on] < 1e-12, 0.0, root[on]))
        met = [f[on] + (-half[on] + s * chord)[:, None] * way[on] for s in (-1, 1)]
        angles = np.concatenate([at - turn, at + turn, *(np.arctan2(m[:, 1], m[:, 0]) for m in met)]) % (2 * np.pi)
        t = np.unique(np.concatenate(([0.0, 2 * np.pi], angles)))
        mid = (t[:-1] + t[1:]) / 2
        keep = _outside(c[0] + r * np.cos(mid), c[1] + r * np.sin(mid), a, b, r)
        arc = r * r * np.diff(t) + r * c[0] * np.diff(np.sin(t)) - r * c[1] * np.diff(np.cos(t))
        total += float((arc * keep).sum()) / 2
    return total


def areas_around(lines: list, r: float) -> list:
    """``area_around`` of each list of points (None: None); lines that are shifts of each other are worked out once."""
    known: dict[tuple, float] = {}

    def area(line: list) -> float:
        if not line or any(v is None for p in line for v in p):
            return area_around(line, r)
        x, y = line[0]
        shape = tuple((p - x, q - y) for p, q in line)
        if shape not in known:
            known[shape] = area_around(list(shape), r)
        return known[shape]

    return [None if v is None else area(v) for v in lines]


def line_buffer_area(pts: Column, r: float) -> Column:
    """Area within ``r`` of a line: in closed form where it is one straight piece, else by its border."""

    @F.arrow_udf("double")
    def bent(column: pa.Array) -> pa.Array:
        lines = [None if v is None else [(p["x"], p["y"]) for p in v] for v in column.to_pylist()]
        return pa.array(areas_around(lines, r), pa.float64())

    # only bent lines go to the function; the others are null there
    crooked = F.when(F.size(pts) > 2, pts)
    straight = F.when(F.size(pts) > 0, buffer_area(length(pts), r)).when(F.size(pts) == 0, 0.0)
    return F.coalesce(bent(crooked), straight)


__all__ = ["area_around", "areas_around", "boxed", "contains", "cut_edges", "line_buffer_area", "line_overlay", "mask_mean", "pieces", "pixel_runs", "polygon_area", "repaired", "simple_polygons", "weighted_mean"]
