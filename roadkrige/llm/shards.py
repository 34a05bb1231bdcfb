"""Sharding by a two-pass external shuffle.

Pass one scatters whole records uniformly into buckets by a seeded hash; their
number follows the bytes and the memory that the session gives an executor's
core, so a bucket always fits one task and large executors get large buckets.  Pass two puts each bucket in a canonical
order, applies a seeded Fisher-Yates shuffle to it and writes it to the shared
folder.  The rank of a record over all buckets deals the records out to the
shards in turn, so the shards' row counts are at most one apart.

Equal texts, a hot source or repeated rows are scattered like any other rows:
the hash also takes the row's place in the input.  So a rerun over the same
partitions of the input agrees, and input cut otherwise gets another shuffle,
as uniform as the first.

Defined cases: a null text has no bytes; null ids and repeated rows are
records like others; a text of any length moves whole; further columns come
along unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import scratch

N_SHARDS = 40
SEED = 17
LEAST_BUCKET = 16 << 20  # bytes below which buckets are not cut just to keep all cores busy
BUCKET_SHARE = 8  # a core's share of the executor's memory holds so many buckets
ROW_BYTES = 16
BROADCAST_BUCKETS = 1_000_000
OUT_ROWS = 2048


def record_size(text) -> F.Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of 0 .. n - 1; numpy's shuffle is Fisher and Yates's: each place swaps with one up to it, last to first."""
    order = np.arange(n)
    rng.shuffle(order)
    return order


def bucket_size(spark: SparkSession) -> int:
    """Bytes of a bucket that fit one core's share of an executor's memory several times over."""
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    memory = spark.conf.get("spark.executor.memory", "1g").lower().removesuffix("b")
    size = int(memory[:-1]) << units[memory[-1]] if memory[-1] in units else int(memory)
    return max(LEAST_BUCKET, size // int(spark.conf.get("spark.executor.cores", "1")) // BUCKET_SHARE)


def shuffle_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All batches of a partition are one bucket."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    whole = pa.Table.from_batches(held)
    key, bucket = whole["_key"].to_numpy(), whole["_bucket"][0].as_py()
    order = np.argsort(key, kind="stable")[fisher_yates(len(key), np.random.default_rng([SEED, bucket]))]
    for first in range(0, len(order), OUT_ROWS):
        part = whole.take(pa.array(order[first : first + OUT_ROWS])).drop_columns(["_key"])
        part = part.append_column("_pos", pa.array(np.arange(first, first + part.num_rows, dtype=np.int64)))
        yield from part.combine_chunks().to_batches()


def shuffle(docs: DataFrame, n_shards: int = N_SHARDS, bucket_bytes: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` in columns of a struct ``record``, with ``shard`` and ``slot``."""
    total = docs.agg(F.sum(record_size(F.col(text)))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    n_buckets = max(1, math.ceil(total / (bucket_bytes or bucket_size(docs.sparkSession))), min(cores, total // LEAST_BUCKET))
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("record"), F.monotonically_increasing_id().alias("_row"))
    where = [F.col(f"record.{doc_id}"), F.col("_row")]
    keyed = keyed.select(
        "record",
        F.pmod(F.xxhash64(F.lit(SEED), *where), F.lit(n_buckets)).cast("int").alias("_bucket"),
        F.xxhash64(F.lit(SEED + 1), *where).alias("_key"),
    )
    schema = T.StructType([keyed.schema["record"], T.StructField("_bucket", T.IntegerType()), T.StructField("_pos", T.LongType())])
    shuffled = scratch.table(keyed.repartitionById(n_buckets, F.col("_bucket")).mapInArrow(shuffle_buckets, schema), "buckets")
    counts = shuffled.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_bucket").alias("_of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    if n_buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    rank = F.col("_before") + F.col("_pos")
    return shuffled.join(offsets, F.col("_bucket") == F.col("_of")).select(
        "record", (rank % n_shards).cast("int").alias("shard"), F.floor(rank / n_shards).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS) -> None:
    """One folder of Parquet files per shard, rows in slot order within a file."""
    out = shuffle(docs, n_shards)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select("record.*", "shard").write.partitionBy("shard").parquet(path)


def op9_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = F.col("record.text")
    return out.select(
        F.col("record.doc_id").alias("doc_id"),
        record_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op9_shuffle_shards": op9_shuffle_shards}
ORACLE_SQL: dict[str, str] = {}
