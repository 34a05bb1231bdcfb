"""Spatial joins as grid equi-joins with an exact test.

The plane is cut into square cells.  Lines, widened by the search radius, are
listed under every cell they can reach; a point is listed under its own cell
only, so a pair meets in exactly one cell and needs no deduplication.  Spark
plans a shuffled equi-join on the cell, which adaptive execution splits where
a cell is crowded; no join compares all pairs.  Joins are asked to merge: Spark
takes a side's size from its compressed files, before its rows are listed under
their cells, and would send sides of many times that through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions.geometry import distance2, line_pieces, pieces, point_line_distance, point_piece_distance2


def cell(v, size: float) -> Column:
    return F.floor(v / size).cast("bigint")


def box_cells(x0, y0, x1, y1, size: float) -> Column:
    """All cells that a box touches: array<struct<i, j>>."""
    across, up = F.sequence(cell(x0, size), cell(x1, size)), F.sequence(cell(y0, size), cell(y1, size))
    return F.flatten(F.transform(across, lambda i: F.transform(up, lambda j: F.struct(i.alias("i"), j.alias("j")))))


def line_cells(pts: Column, r: float, size: float) -> Column:
    """Cells that hold any point within ``r`` of a line (and perhaps a few more)."""
    alone = F.array(F.struct(F.element_at(pts, 1).alias("a"), F.element_at(pts, 1).alias("b")))
    each = F.when(F.size(pts) > 1, pieces(pts)).otherwise(alone)

    def around(s):
        low = lambda c: F.least(s["a"][c], s["b"][c]) - r
        high = lambda c: F.greatest(s["a"][c], s["b"][c]) + r
        return box_cells(low("x"), low("y"), high("x"), high("y"), size)

    return F.array_distinct(F.flatten(F.transform(each, around)))


def distance2_to(pts: Column, x, y) -> Column:
    """Squared distance of (x, y) to a line or to a single point."""
    alone = F.array(F.struct(F.element_at(pts, 1).alias("a"), F.element_at(pts, 1).alias("b")))
    each = F.when(F.size(pts) > 1, pieces(pts)).otherwise(alone)
    return F.array_min(F.transform(each, lambda s: point_piece_distance2(x, y, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))


def _first_piece(pts: Column) -> dict[str, Column]:
    """End points of the first piece of a line (a point twice), and whether there are more."""
    a, b = F.element_at(pts, 1), F.coalesce(F.try_element_at(pts, F.lit(2)), F.element_at(pts, 1))
    return {"_ax": a["x"], "_ay": a["y"], "_bx": b["x"], "_by": b["y"], "_bent": F.size(pts) > 2}


def within_join(lines: DataFrame, points: DataFrame, radius: float, strict: bool = False, size: float | None = None, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of a line (column ``pts``) and a point (``x``, ``y``) within ``radius``, with ``d2``.

    ``strict`` leaves out pairs at exactly the radius.  Column names of the two
    sides must differ, but for those in ``on``, which must be equal.
    """
    size = float(size or max(radius, 1.0))
    keyed = lines.filter(F.size("pts") > 0).withColumns(_first_piece(F.col("pts")))
    keyed = keyed.withColumn("_cell", F.explode(line_cells(F.col("pts"), radius, size)))
    keyed = keyed.select("*", F.col("_cell.i").alias("_i"), F.col("_cell.j").alias("_j")).drop("_cell")
    placed = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumns({"_i": cell(F.col("x"), size), "_j": cell(F.col("y"), size)})
    # straight lines, the common case, need no walk over an array
    straight = point_piece_distance2("x", "y", "_ax", "_ay", "_bx", "_by")
    d2 = F.when(F.col("_bent"), distance2_to(F.col("pts"), F.col("x"), F.col("y"))).otherwise(straight)
    joined = keyed.join(placed.hint("merge"), ["_i", "_j", *on]).withColumn("d2", d2).drop("_i", "_j", "_ax", "_ay", "_bx", "_by", "_bent")
    return joined.filter(F.col("d2") < radius * radius if strict else F.col("d2") <= radius * radius)


def extent(df: DataFrame, x: str = "x", y: str = "y") -> tuple[float, float, float, float] | None:
    row = df.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    return None if row is None or row[0] is None else tuple(map(float, row))


def nearest_join(lines: DataFrame, points: DataFrame, line_id: str, point_id: str, start: float = 100.0, on: tuple[str, ...] = ()) -> DataFrame:
    """The nearest point of each line: line_id (and ``on``), point_id, distance; ties to the smallest point_id.

    Searches within ``start`` and doubles the radius for lines still without
    an answer, until it spans everything; lines without any candidate get none.
    """
    keys = [line_id, *on]
    bounds = extent(points)
    corners = lines.select(F.explode("pts").alias("p")).select(F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    other = extent(corners)
    if bounds is None or other is None:
        empty = lines.select(*keys).limit(0).join(points.select(point_id).limit(0), F.lit(True)).withColumn("distance", F.lit(0.0))
        return empty
    span = math.hypot(max(bounds[2], other[2]) - min(bounds[0], other[0]), max(bounds[3], other[3]) - min(bounds[1], other[1]))
    slim = points.select(point_id, "x", "y", *on)
    if on:
        lines = lines.join(slim.select(*on).distinct(), list(on), "left_semi")
    left, radius, out = lines.select(*keys, "pts"), float(start), None
    while True:
        best = within_join(left, slim, radius, on=on).groupBy(*keys).agg(F.min(F.struct("d2", point_id)).alias("best"))
        found = best.select(*keys, F.col(f"best.{point_id}").alias(point_id), F.sqrt("best.d2").alias("distance"))
        found = storage.table(found, "nearest")
        out = found if out is None else out.unionByName(found)
        if radius > span:
            return out
        left = storage.table(left.join(found.select(*keys).hint("merge"), keys, "left_anti"), "unresolved")
        if not left.head(1):
            return out
        radius *= 2


def radius_count(points: DataFrame, point_id: str, radius: float) -> DataFrame:
    """How many points lie within ``radius`` of each, itself included."""
    return radius_pairs(points, point_id, radius, ordered=False).groupBy(F.col("a").alias(point_id)).agg(F.count(F.lit(1)).alias("n"))


def radius_pairs(points: DataFrame, point_id: str, radius: float, ordered: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs a, b within ``radius`` with ``d2``; a < b where ``ordered``, else all, self pairs too.

    A point is offered to its own cell and the eight around it, and where
    ``ordered`` to half of those, as each pair then meets once.  The columns
    ``carry`` come along as a_{name} and b_{name}, so that pairs need no join for them.
    """
    size = max(float(radius), 1.0) * (1 + 1e-9)  # points a radius apart by rounding are in neighbouring cells
    placed = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    placed = placed.withColumns({"_i": cell(F.col("x"), size), "_j": cell(F.col("y"), size)})
    side = lambda n: [F.col(point_id).alias(n), F.col("x").alias(f"_{n}x"), F.col("y").alias(f"_{n}y"), *[F.col(c).alias(f"{n}_{c}") for c in carry], "_i", "_j"]
    steps = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)] if ordered else [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps]))
    offered = placed.select(*side("a")).withColumn("_d", step)
    offered = offered.withColumns({"_i": F.col("_i") + F.col("_d.i"), "_j": F.col("_j") + F.col("_d.j"), "_own": (F.col("_d.i") == 0) & (F.col("_d.j") == 0)}).drop("_d")
    dx, dy = F.col("_ax") - F.col("_bx"), F.col("_ay") - F.col("_by")
    pairs = offered.join(placed.select(*side("b")).hint("merge"), ["_i", "_j"]).withColumn("d2", dx * dx + dy * dy).filter(F.col("d2") <= radius * radius)
    if not ordered:
        return pairs.select("a", "b", "d2", *[f"{n}_{c}" for c in carry for n in "ab"])
    pairs = pairs.filter("a < b or (a > b and not _own)")
    swap = F.col("a") > F.col("b")
    turned = [F.when(swap, F.col(f"{m}{c}")).otherwise(F.col(f"{n}{c}")).alias(f"{n}{c}") for c in ("", *[f"_{c}" for c in carry]) for n, m in ("ab", "ba")]
    return pairs.select("d2", *turned)


def lines_in_circles(lines: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """Each centre (``x``, ``y``) with the straight pieces of ``lines`` (``pts``) near its circle, and the length inside, ``clip_m``.

    Lines are cut into their pieces before they are listed under cells: a pair is then arithmetic on numbers, which
    Spark compiles, and no walk over an array.  A piece that cannot reach the circle from its middle is left out by
    the join; others that miss it have a length of 0.  Pieces without length are left out.
    """
    size = max(float(radius), 1.0)
    cells = lambda c: F.explode(F.sequence(cell(F.least(f"_a{c}", f"_b{c}") - radius, size), cell(F.greatest(f"_a{c}", f"_b{c}") + radius, size)))
    ends = {f"_{n}{c}": F.col(f"_s.{n}.{c}") for n in "ab" for c in "xy"}
    cut = lines.withColumn("_s", F.explode(line_pieces(F.col("pts")))).withColumns(ends).drop("_s", "pts")
    reach = 2 * radius + F.sqrt(distance2("_ax", "_ay", "_bx", "_by"))
    cut = cut.filter(distance2("_ax", "_ay", "_bx", "_by") > 0).withColumn("_reach2", reach * reach * (1 + 1e-9))
    listed = cut.withColumn("_i", cells("x")).withColumn("_j", cells("y"))
    placed = centres.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumns({"_i": cell(F.col("x"), size), "_j": cell(F.col("y"), size)})
    near = distance2(F.col("_ax") + F.col("_bx"), F.col("_ay") + F.col("_by"), 2 * F.col("x"), 2 * F.col("y")) <= F.col("_reach2")
    pairs = placed.join(listed.hint("merge"), ["_i", "_j"]).filter(near)
    return with_clip(pairs, radius).drop("_i", "_j", "_reach2", *ends)


def with_clip(pairs: DataFrame, radius: float) -> DataFrame:
    """``clip_to_circle`` of the piece _ax, _ay, _bx, _by, which has a length, and the centre x, y, as ``clip_m``.

    Each step is a column of its own, worked out once; as one expression the discriminant alone is in it six times,
    and the compiled code of a row is too long for the JVM to optimise.
    """
    x, y, ax, ay, bx, by, dx, dy, fx, fy, a, b, disc, root = map(F.col, "x y _ax _ay _bx _by _dx _dy _fx _fy _a _b _disc _root".split())
    pairs = pairs.withColumns({"_dx": bx - ax, "_dy": by - ay, "_fx": ax - x, "_fy": ay - y})
    pairs = pairs.withColumns({"_a": dx * dx + dy * dy, "_b": 2 * (fx * dx + fy * dy), "_c": fx * fx + fy * fy - radius * radius})
    pairs = pairs.withColumn("_disc", b * b - 4 * a * F.col("_c"))
    pairs = pairs.withColumn("_root", F.sqrt(F.greatest(disc, F.lit(0.0))))
    pairs = pairs.withColumns({"_t0": F.greatest(F.lit(0.0), (-b - root) / (2 * a)), "_t1": F.least(F.lit(1.0), (-b + root) / (2 * a))})
    inside = (disc > 0) & (F.col("_t1") > F.col("_t0"))
    clip = F.when(inside, (F.col("_t1") - F.col("_t0")) * F.sqrt(a)).otherwise(0.0)
    return pairs.withColumn("clip_m", clip).drop("_dx", "_dy", "_fx", "_fy", "_a", "_b", "_c", "_disc", "_root", "_t0", "_t1")


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def overlay_length(pts: Column, ring: Column) -> Column:
    """Length of a line inside a closed ring."""
    return overlay_edges(pts, pieces(ring))


def overlay_edges(pts: Column, edges: Column) -> Column:
    """Length of a line inside rings given as their pieces (even-odd): each piece is cut where it crosses them."""
    from ..functions.geometry import inside as within
    from ..functions.geometry import point_distance

    def inside(s):
        a, b = s["a"], s["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]

        def crossing(e):
            c, d = e["a"], e["b"]
            ex, ey = d["x"] - c["x"], d["y"] - c["y"]
            det = dx * ey - dy * ex
            t = F.try_divide((c["x"] - a["x"]) * ey - (c["y"] - a["y"]) * ex, det)
            u = F.try_divide((c["x"] - a["x"]) * dy - (c["y"] - a["y"]) * dx, det)
            return F.when((t > 0) & (t < 1) & (u >= 0) & (u <= 1), t)

        cuts = F.filter(F.transform(edges, crossing), lambda t: t.isNotNull())
        cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts)))

        def length_inside(at):
            n = F.size(at) - 1
            spans = F.zip_with(F.slice(at, 1, n), F.slice(at, 2, n), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
            return F.aggregate(
                spans,
                F.lit(0.0),
                lambda acc, v: acc + F.when(within(a["x"] + (v["p"] + v["q"]) / 2 * dx, a["y"] + (v["p"] + v["q"]) / 2 * dy, edges), v["q"] - v["p"]).otherwise(0.0),
            )

        share = _bound(cuts, length_inside)
        return share * point_distance(a, b)

    def whole(own):
        nonlocal edges
        edges = own
        return F.aggregate(F.transform(pieces(pts), inside), F.lit(0.0), lambda acc, v: acc + v)

    return _bound(edges, whole)


def work_tasks(spark: SparkSession) -> int:
    """Tasks for rows that are much work for their bytes."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def box_join(lines: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Pairs of a line and a box (x0, y0, x1, y1) that share a cell, once each."""
    keyed = lines.withColumn("_cell", F.explode(line_cells(F.col("pts"), 0.0, size)))
    placed = boxes.withColumn("_cell", F.explode(box_cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size)))
    # the rows are few bytes and much work: by their bytes alone they would be put into one task
    pairs = keyed.repartition(work_tasks(lines.sparkSession), "_cell").join(placed.hint("merge"), "_cell")
    # of the cells that both touch, the pair is kept in the smallest only; a box's cells, which may be many, are not listed for it
    touched = lambda c: c["i"].between(cell(F.col("x0"), size), cell(F.col("x1"), size)) & c["j"].between(cell(F.col("y0"), size), cell(F.col("y1"), size))
    both = F.array_min(F.filter(line_cells(F.col("pts"), 0.0, size), touched))
    return pairs.filter(F.col("_cell") == both).drop("_cell")


__all__ = [
    "box_cells", "box_join", "distance2_to", "lines_in_circles", "nearest_join", "overlay_edges", "overlay_length", "point_line_distance",
    "radius_count", "radius_pairs", "within_join", "work_tasks",
]
