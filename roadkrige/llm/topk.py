"""Exact top-k by inner product: columnar branch and bound.

Vectors become integers, floor(1024 x), their dimensions ordered by the queries'
mass, largest first.  A task lays its candidates out in columns of dimensions,
a tile at a time, and adds up scores one block of dimensions after another.
After each block, what the remaining dimensions can add is bounded by the
product of the remaining lengths (Cauchy-Schwarz); candidates whose bound is
below the query's present k-th score are compacted away.  While most pairs are
alive a block is one matrix product for all queries; from then on each query
goes on with its own survivors.  The first tile of a task is small, so that
there is a k-th score to compare with early.  Each task returns its k best per
query and a window keeps the k best of those.

Queries are taken in blocks of ``QUERY_BYTES``.  One block at a time is held by
the driver and sent to the tasks, and its results are appended to a table in
the shared folder before the next one, so the driver's memory does not grow
with the queries.  Every block scans all candidates once: exact search costs
queries times candidates however it is dealt.

Arithmetic is in doubles while sums stay below 2**53, else in Python integers;
scores outside the range of a long are set to its ends.

Defined cases: vectors that are null or hold null or non-finite components,
and rows without an id, take no part; a shorter vector counts as ended by
zeros; a query is never its own candidate (no row with its id is); rows that
repeat an id are candidates each, and as a query the one with the smallest
vector counts; equal scores go to the smaller id; with fewer than k candidates
all are returned; vectors may have any length; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch
from .text import ragged

SCALE = 1024.0
K = 10
QUERY_BYTES = 32 << 20
QUERY_TILE = 256
TILE = 2048
FIRST_TILE = 256
DIMENSIONS = 8
COMPACT_BELOW = 0.5


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    x = F.col(embedding)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return vectors.filter(F.col(vec_id).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(vec_id).alias("vec_id"), x.cast("array<double>").alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as floor(1024 x), short ones ended by zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False))
    return out


def _fit(x: np.ndarray, d: int) -> np.ndarray:
    return x if x.shape[1] == d else np.pad(x, ((0, 0), (0, d - x.shape[1])))


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.row, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf)
        self.alive: dict[int, list[int]] = {}  # by block of dimensions: pairs of tiles after the first, survivors

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        row, score, ids = (np.concatenate(x) for x in ((self.row, row), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.row, self.score, self.id = row[keep], score[keep], ids[keep]
        full = place == self.k - 1
        self.least[row[full]] = score[full]


def search_tile(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, best: Best, first_row: int) -> None:
    """Candidates ``c`` (dimensions x n) against the queries ``q`` (m x dimensions)."""
    d, k = q.shape[1], best.k
    steps = [(a, min(d, a + DIMENSIONS)) for a in range(0, d, DIMENSIONS)]
    q_left = np.sqrt(np.array([(q[:, b:] ** 2).sum(1) for _, b in steps]))
    c_left = np.sqrt(np.array([(c[b:] ** 2).sum(0) for _, b in steps]))
    least = best.least[first_row : first_row + len(q)]
    scores = np.zeros((len(q), c.shape[1]))
    at = np.argsort(c_ids, kind="stable")
    low, high = (np.searchsorted(c_ids[at], q_ids, side) for side in ("left", "right"))
    own = np.repeat(np.arange(len(q)), high - low)
    scores[own, at[ragged(low, high - low)]] = -np.inf

    def note(i: int, n: int) -> None:
        if np.isfinite(least).all():
            seen = best.alive.setdefault(i, [0, 0])
            seen[0] += scores.size
            seen[1] += n

    for i, (a, b) in enumerate(steps):
        scores += q[:, a:b] @ c[a:b]
        if i + 1 == len(steps):
            break
        alive = scores + q_left[i][:, None] * c_left[i] * (1 + 1e-9) + 1 >= least[:, None]
        note(i, int(alive.sum()))
        if alive.mean() < COMPACT_BELOW:
            found = []
            for row in np.flatnonzero(alive.any(1)).tolist():
                col = np.flatnonzero(alive[row])
                part = scores[row, col]
                for j in range(i + 1, len(steps)):
                    a, b = steps[j]
                    part = part + q[row, a:b] @ c[a:b, col]
                    keep = part + q_left[j][row] * c_left[j][col] * (1 + 1e-9) + 1 >= least[row]
                    col, part = col[keep], part[keep]
                    note(j, len(col))
                found.append((np.full(len(col), row + first_row), part, c_ids[col]))
            if found:
                best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
            return
    if scores.shape[1] > k:
        least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
    row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    best.add(row + first_row, scores[row, col], c_ids[col])


def search_large(q, q_ids, c, c_ids, best: Best, first_row: int) -> None:
    """The same in Python integers, for components of any size."""
    whole = np.vectorize(int, otypes=[object])
    scores = np.clip(whole(q).dot(whole(c)), -(2**63), 2**63 - 1)
    row, col = np.nonzero(q_ids[:, None] != c_ids[None, :])
    best.score = best.score.astype(object)
    best.add(row + first_row, scores[row, col], c_ids[col])


def search(q_ids: np.ndarray, q_all: np.ndarray, k: int, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Best:
    """The best of the candidates, which come in parts of ids and vectors."""
    best, tile = Best(len(q_ids), k), FIRST_TILE
    for c_ids, c_all in parts:
        d = max(q_all.shape[1], c_all.shape[1])
        q_fit = _fit(q_all, d)
        order = np.argsort(-(q_fit**2).sum(0), kind="stable")
        q_fit = np.ascontiguousarray(q_fit[:, order])
        large = d * np.abs(q_fit).max(initial=0) * np.abs(c_all).max(initial=0) >= 2.0**53
        first = 0
        while first < len(c_ids):
            c, ids = np.ascontiguousarray(_fit(c_all[first : first + tile], d)[:, order].T), c_ids[first : first + tile]
            for row in range(0, len(q_ids), QUERY_TILE):
                way = search_large if large or best.score.dtype == object else search_tile
                way(q_fit[row : row + QUERY_TILE], q_ids[row : row + QUERY_TILE], c, ids, best, row)
            first, tile = first + tile, TILE
    return best


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of ``vectors``."""
    spark = vectors.sparkSession
    asked = usable(queries, vec_id, embedding).groupBy("vec_id").agg(F.min("v").alias("v"))
    candidates = usable(vectors, vec_id, embedding)
    n, d = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n_blocks = max(1, math.ceil(n * 8 * max(1, d or 1) / query_bytes))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))
    path = scratch.new_path(spark, "topk")
    for i in range(n_blocks):
        held = asked.filter(block == i).toArrow()
        sent = spark.sparkContext.broadcast((held["vec_id"].to_numpy().astype(np.int64), matrix(held["v"])))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q_ids, q_all = sent.value
            best = search(q_ids, q_all, k, ((b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), matrix(b.column(1))) for b in batches))
            score = pa.array([min(int(x), 2**63 - 1) for x in best.score], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[best.row]), pa.array(best.id), score], names=["query_id", "vec_id", "score"])

        found = candidates.mapInArrow(run, "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found.write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(found.schema).parquet(path)


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


QUERIES = {"op8_topk_search": op8_topk_search}
ORACLE_SQL = {
    "op8_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 10"""
}
