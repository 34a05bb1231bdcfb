"""Relational building blocks of the traffic pipeline."""

from __future__ import annotations

from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import canonical_id, drop_missing


def mean_by_key(observations: DataFrame, key: str = "osm_id", value: str = "aadt", to: str = "aadt_obs") -> DataFrame:
    """Mean value of each key over rows that have one."""
    return drop_missing(observations.select(key, F.col(value).cast("double").alias(value)), [key, value]).groupBy(key).agg(F.avg(value).alias(to))


def attach_mean(roads: DataFrame, observations: DataFrame, left_key: str = "osm_id", right_key: str = "osm_id", value: str = "aadt") -> DataFrame:
    """All roads with the mean of their counts; ids compared as canonical text."""
    keyed = observations.select(canonical_id(F.col(right_key)).alias("_join_id"), F.col(value).alias(value))
    mean = mean_by_key(keyed, "_join_id", value)
    return roads.withColumn("_join_id", canonical_id(F.col(left_key))).join(mean, "_join_id", "left")


def forward_fill(df: DataFrame, columns: list[str], order: str, within: str) -> DataFrame:
    """Nulls take the last value above them in the declared order, per ``within``."""
    w = Window.partitionBy(within).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def dense_id(df: DataFrame, order: list[str], to: str = "seg_id", start: int = 0) -> DataFrame:
    """Dense ids along a declared order: per-range row numbers plus the ranges' offsets.

    Rows are range-partitioned by ``order``, numbered within partitions, and
    the partitions' counts are summed up, so no task sees all rows.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    from ..storage import table

    ranged = table(ranged, "ranged")
    inside = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_count"))
    before = counts.select("_part", F.coalesce(F.sum("_count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # one row per partition of the shuffle
    return inside.join(F.broadcast(before), "_part").withColumn(to, F.col("_before") + F.col("_n") - 1 + start).drop("_part", "_n", "_before")


def with_split_flag(df: DataFrame, key: str = "osm_id") -> DataFrame:
    """``is_split``: whether a key (not null) has more than one row."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(counts, key, "left").withColumn("is_split", F.coalesce(F.col("_n") > 1, F.lit(False))).drop("_n")


def unmatched(points: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``points`` whose keys (nulls equal) are not among ``matched``."""
    other = matched.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return points.join(other, cond, "left_anti")


def running_share(df: DataFrame, value: str, name: str) -> DataFrame:
    """Share of each value and the cumulative share by falling value; one row a feature, so one task."""
    order = Window.orderBy(F.col(value).desc(), name)
    total = F.sum(value).over(Window.partitionBy())
    out = df.withColumn("share", F.col(value) / F.nullif(total, F.lit(0.0)))
    return out.withColumn("cum", F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def keep_important(df: DataFrame, value: str, name: str, cumulative: float = 0.95, least: float = 1e-4) -> DataFrame:
    """Features within the cumulative share, or above the least importance."""
    return running_share(df, value, name).withColumn("keep", (F.col("cum") <= cumulative) | (F.col(value) >= least))


def stratified_sample(df: DataFrame, stratum: str, key: str, ratio: float = 0.2, least: int = 5, seed: int = 42) -> DataFrame:
    """``is_test``: per stratum of ``least`` rows or more, round-half-even(ratio * n), one at least, by hashed key."""
    mixed = seeded_hash(key, seed)
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(mixed, key))
    n = F.count(F.lit(1)).over(Window.partitionBy(stratum))
    k = F.greatest(F.lit(1), F.bround(F.lit(ratio) * n).cast("int"))
    return df.withColumn("is_test", (n >= least) & (rank <= k))


def seeded_hash(key: str, seed: int):
    """A whole-number hash that any SQL engine can repeat; for non-negative keys below 2**31."""
    k = F.col(key).cast("bigint")
    return ((k + seed) * 1103515245 + 12345) % 2147483648 * 69069 % 2147483647


def systematic_pairs(n: int, most: int = 5000) -> tuple[int, int]:
    """The step and limit that thin the pairs of n items to about ``most``."""
    total = n * (n - 1) // 2
    return max(1, total // max(1, most)), most


def thinned_indices(n: int, most: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """The same pairs as ``thinned_pairs`` takes, as arrays; pairs beyond ``most`` are not made."""
    step, limit = systematic_pairs(n, most)
    pairs = list(islice(((i, j) for i in range(n) for j in range(i + 1, n, step)), limit))
    i, j = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
    return i, j


def thinned_pairs(items: DataFrame, order: str, columns: list[str], most: int = 5000) -> DataFrame:
    """Pairs i < j of numbered items with (j - i - 1) divisible by the step, the first ``most`` in order.

    ``items`` are the labelled sample that is solved for densely later on, so
    they fit one task; the second index is generated, not cross-joined.
    """
    n = items.count()
    step, limit = systematic_pairs(n, most)
    numbered = items.withColumn("i", F.row_number().over(Window.orderBy(order)) - 1)
    left = numbered.select("i", *[F.col(c).alias(f"{c}_i") for c in columns])
    if n < 2:
        right = numbered.select(F.col("i").alias("j"), *[F.col(c).alias(f"{c}_j") for c in columns])
        return left.join(right, F.lit(False))
    # rows are taken in order until the limit, so later ones need not be generated
    per = F.floor((F.lit(n - 2) - F.col("i")) / step) + 1
    before = F.coalesce(F.sum(per).over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = left.filter(F.col("i") < n - 1).withColumn("_before", before).filter(F.col("_before") < limit)
    pairs = left.withColumn("j", F.explode(F.expr(f"sequence(i + 1, {n - 1}, {step})")))
    right = numbered.select(F.col("i").alias("j"), *[F.col(c).alias(f"{c}_j") for c in columns])
    return pairs.filter(F.col("_before") + (F.col("j") - F.col("i") - 1) / step < limit).drop("_before").join(right, "j")
