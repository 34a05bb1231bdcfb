"""Centroid clustering: ball k-means, exact.

Vectors become integers, floor(scale x).  A cluster is a ball: its centroid
and a radius that no member exceeds.  Centroid j is a neighbour of ball i if
half the distance of the two centroids is at most the radius of i; no member
of i can be nearer to any other centroid.  A member whose distance from its own
centroid is below half the distance of the nearest neighbour centroid lies in
the stable core and stays without a comparison.  The others lie in annuli, cut
at half the distances of the neighbours in ascending order: a member of the
m-th annulus is compared with the m nearest neighbours only.  All tests are made
on squared integers, so the result is that of comparing everything.

A round is one pass that assigns and writes the members with their clusters to
a table in the shared folder, and one that sums them by cluster.  The driver
holds what belongs to centroids: k vectors, k radii and the k x k distances; k
is a parameter.  A new radius is the old one, which the sums bring, plus the
distance that the centroid moved, rounded up.  In the first round all vectors
belong to ball 0 with an unbounded radius, which makes every centroid a
neighbour.

Arithmetic is in doubles while no squared distance can pass 2**53, else in
Python integers; distances beyond the range of a long are set to its end.
Sums are kept in two limbs of ``LIMB``, which covers all single-precision values.

Defined cases: vectors that are null, have another number of components or hold
null or non-finite ones (or any of 1e50 or more), and rows without an id, take no part; rows that repeat
an id are members each (the starting order puts the smaller vector first); equal
vectors may start several centroids, of which the smallest number gets members
and the others stay where they are; with fewer vectors than centroids there are
as many centroids as vectors; an empty table gives an empty result; further
columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

K = 40
DIMENSIONS = 64
ROUNDS = 5
SCALE = 256.0
SEED = 2
LONG_MAX = 2**63 - 1
LIMB = 10**30  # also the largest distance that is told apart from larger ones
LARGEST = 1e50
_STATE = "vec_id {id}, v array<double>, cluster int, distance decimal(38,0)"


def kept(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dimensions: int = DIMENSIONS, scale: float = SCALE) -> DataFrame:
    """vec_id and v = floor(scale x) of the vectors that take part."""
    x = F.col(embedding)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(LARGEST)))
    rows = vectors.filter(F.col(vec_id).isNotNull() & (F.size(x) == dimensions) & fine)
    # floor() of a double would be a long; what remains of the division is exact for every size
    whole = F.transform(x, lambda v: F.rint(v.cast("double") * scale))
    lower = F.zip_with(whole, x, lambda w, v: F.when(w > v.cast("double") * scale, w - 1.0).otherwise(w))
    return rows.select(F.col(vec_id).alias("vec_id"), lower.alias("v"))


def starts(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [[int(x) for x in r.v] for r in rows]


class Balls:
    """Centroids, radii and neighbours of one round, as tasks get them."""

    def __init__(self, centroids: list[list[int]], radii: list[int | None]):
        """``radii``: bounds of the members' distances; None where nothing is known."""
        self.centroids = centroids
        apart = [[sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) for b in centroids] for a in centroids]
        self.near = []
        for i, r in enumerate(radii):
            order = sorted((d, j) for j, d in enumerate(apart[i]) if j != i and (r is None or d <= 4 * r * r))
            self.near.append(([j for _, j in order], [d for d, _ in order]))
        self.largest = max((abs(x) for c in centroids for x in c), default=0)

    def assign(self, v: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector (rows), the squared distance, and how many distances were computed."""
        top = max(self.largest, int(np.abs(v).max(initial=0)))
        kind = float if 4 * v.shape[1] * top * top < 2**53 else object
        v = v if kind is float else np.vectorize(int, otypes=[object])(v)
        centroids = np.array(self.centroids, dtype=kind)
        out, best, compared = cluster.copy(), np.zeros(len(v), kind), 0
        for i in np.unique(cluster).tolist():
            rows = np.flatnonzero(cluster == i)
            own = _apart(v[rows], centroids[i])
            least, number = own.copy(), np.full(len(rows), i)
            compared += len(rows)
            inside = np.argsort(-own, kind="stable")  # outermost first: an annulus is a prefix
            outermost = own[inside]
            for j, d in zip(*self.near[i], strict=True):
                n = int(np.searchsorted(-4 * outermost, -d, side="right"))  # members with 4 own >= d
                if not n:
                    break  # farther neighbours reach the stable core even less
                some = inside[:n]
                there = _apart(v[rows[some]], centroids[j])
                compared += n
                better = (there < least[some]) | ((there == least[some]) & (j < number[some]))
                least[some[better]], number[some[better]] = there[better], j
            out[rows], best[rows] = number, least
        return out, best, compared


def _apart(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return (d * d).sum(1)


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) if len(column) else np.zeros((0, d))


def _assigned(state: DataFrame, balls: Balls, d: int) -> DataFrame:
    sent = state.sparkSession.sparkContext.broadcast(balls)  # k vectors and at most k x k distances

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster, best, _ = sent.value.assign(_vectors(b.column(1), d), b.column(2).to_numpy(zero_copy_only=False).astype(np.int64))
            far = pa.array([min(int(x), LIMB) for x in best.tolist()], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster, pa.int32()), far], names=["vec_id", "v", "cluster", "distance"])

    kind = state.schema["vec_id"].dataType.simpleString()
    return state.select("vec_id", "v", "cluster").mapInArrow(run, _STATE.format(id=kind))


def _sums(state: DataFrame, d: int) -> dict[int, list]:
    """By cluster: sums of the components, number of members and largest distance; summed in tasks first, k x d rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            v, cluster = _vectors(b.column(1), d), b.column(0).to_numpy(zero_copy_only=False)
            far = np.array([int(x) for x in b.column(2).to_pylist()], dtype=object)
            for i in np.unique(cluster).tolist():
                own = v[cluster == i]
                whole = float(np.abs(own).max(initial=0)) * len(own) < 2.0**53
                part = [int(x) for x in own.sum(0).tolist()] if whole else [sum(map(int, c)) for c in own.T.tolist()]
                at = total.setdefault(i, [[0] * d, 0, 0])
                at[0] = [x + y for x, y in zip(at[0], part, strict=True)]
                at[1], at[2] = at[1] + len(own), max(at[2], far[cluster == i].max())
        rows = [(i, p, *divmod(s, LIMB), n, far) for i, (sums, n, far) in total.items() for p, s in enumerate(sums)]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        wide = pa.decimal128(38, 0)
        kinds = (pa.int32(), pa.int32(), wide, wide, pa.int64(), wide)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["cluster", "p", "hi", "lo", "n", "far"])

    parts = state.select("cluster", "v", "distance").mapInArrow(run, "cluster int, p int, hi decimal(38,0), lo decimal(38,0), n long, far decimal(38,0)")
    out: dict[int, list] = {}
    for r in parts.groupBy("cluster", "p").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo"), F.sum("n").alias("n"), F.max("far").alias("far")).collect():  # k x d rows
        out.setdefault(r.cluster, [[0] * d, r.n, int(r.far)])[0][r.p] = int(r.hi) * LIMB + int(r.lo)
    return out


def _up(square: int) -> int:
    """The smallest integer that is at least the root."""
    return isqrt(square - 1) + 1 if square > 0 else 0


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: float = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector that takes part, and the centroids after ``rounds`` updates."""
    members = kept(vectors, vec_id, embedding, dimensions, scale)
    centroids = starts(members, k, seed)
    if not centroids:
        return members.select("vec_id", F.lit(0).alias("cluster"), F.lit(None).cast("decimal(38,0)").alias("distance")).limit(0), []
    state, radii = members.withColumn("cluster", F.lit(0)), [None] * len(centroids)
    for _ in range(rounds):
        following = scratch.table(_assigned(state, Balls(centroids, radii), dimensions), "balls")
        scratch.drop(state)
        state = following
        radii = [0] * len(centroids)  # of balls without members
        for i, (sums, n, far) in _sums(state, dimensions).items():
            new = [s // n for s in sums]
            moved = sum((x - y) ** 2 for x, y in zip(new, centroids[i], strict=True))
            radii[i], centroids[i] = _up(far) + _up(moved) if far < LIMB else None, new
    last = scratch.table(_assigned(state, Balls(centroids, radii), dimensions).drop("v"), "clustered")
    scratch.drop(state)
    return last, centroids


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    own = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    clip = lambda x: min(x, LONG_MAX)
    of = [clip(own.get(i, 0)) for i in range(len(centroids))] or [0]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids] or [""]
    at = F.col("cluster") + 1
    return found.select(
        "vec_id",
        "cluster",
        F.least("distance", F.lit(LONG_MAX)).cast("long").alias("distance"),
        F.element_at(F.array(*[F.lit(x).cast("long") for x in of]), at).alias("cluster_inertia"),
        F.lit(clip(sum(own.values()))).cast("long").alias("inertia"),
        F.element_at(F.array(*map(F.lit, digests)), at).alias("centroid_sha256"),
    )


def _oracle() -> str:
    """The same rounds without balls: every vector against every centroid."""
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE}::DOUBLE * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, e) - 1)::INTEGER AS cluster, e FROM (SELECT sha256('{SEED}:' || vec_id) AS h, e FROM v ORDER BY h, e LIMIT {K}))"""]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, ve AS e, d.c AS cluster, d.d AS distance FROM (
            SELECT vec_id, v.e AS ve, min({{'d': list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c.cluster}}) AS d
            FROM v CROSS JOIN c{i} c GROUP BY vec_id, v.e))""")
        if i < ROUNDS:
            parts.append(f"""s{i} AS (SELECT cluster, p, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM a{i}) GROUP BY 1, 2),
        c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN (
            SELECT cluster, list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY p) AS e FROM s{i} GROUP BY 1) m USING (cluster))""")
    return "WITH " + ",\n        ".join(parts) + f"""
        SELECT vec_id, a.cluster, distance, sum(distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
               sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
        FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (cluster)"""


QUERIES = {"op11_ball_kmeans": op11_ball_kmeans}
ORACLE_SQL = {"op11_ball_kmeans": _oracle()}
