"""Exact deduplication with a two-pass Bloom filter, in DataFrame functions only.

The digests of the normalised texts are cut by hash into segments of about
``SEGMENT_ROWS`` rows, written as a folder each without a shuffle, and worked
off one after another, so a segment's filter has a fixed size at any size of
the corpus.

Pass one takes a 64-bit hash of each digest and counts it by a partially
aggregated group-by, so a hot text sends one row per task.  This moves about
eight bytes a row, and less is not possible for exact results: whether another
task has a hash too is not known before.  The hashes counted more than once set
``len(SEEDS)`` bits each in a Bloom filter of bitmaps.  Pass two probes it,
broadcast (at most ``FILTER_BITS / 8`` bytes): a row that misses a bit has a
text of its own and passes straight through; only the others shuffle, as
(digest, id), never as text.  False positives of the filter cost a shuffled row
and never change the result.

Defined cases: a null text equals the empty text; of equal texts every row
with the smallest id stays (one row, unless a row is repeated with its id);
null ids sort after all others and stay only if the group has no other id;
a text of any length is digested whole; further columns are kept as they are; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .text import SPACE_RE

SEEDS = (11, 29)
FILTER_BITS = 1 << 29  # 64 MB, of a segment
SEGMENT_ROWS = FILTER_BITS // 16  # at most half as many repeated hashes: 32 bits each or more
BROADCAST_LIMIT = 64 << 20
DROPPED_ROW_BYTES = GROUP_ROW_BYTES = 160


def digest(text) -> F.Column:
    """SHA-256 of the text with each run of white space made one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RE, " "), 256)


def _slots(key, bits: int) -> list:
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) for seed in SEEDS]


def repeated_filter(digests: DataFrame, key: str, bits: int) -> DataFrame:
    """Pass one: (bucket, bitmap) of the slots of hashes that more than one row has."""
    repeated = digests.groupBy(F.xxhash64(key).alias("_hash")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    slots = repeated.select(F.explode(F.array(*_slots(F.col("_hash"), bits))).alias("slot"))
    return slots.groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bitmap"))


def _bit_set(bitmap, slot) -> F.Column:
    """Whether the bitmap has the slot's bit; false where there is no bitmap."""
    position = F.expr(f"bitmap_bit_position({slot})")
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))


def possibly_repeated(digests: DataFrame, key: str, n_rows: int) -> DataFrame:
    """Pass two: ``digests`` with a boolean ``maybe``; false only for rows whose key is their own."""
    bits = min(FILTER_BITS, 1 << max(15, math.ceil(math.log2(max(1, n_rows) * 16))))
    found = scratch.table(repeated_filter(digests, key, bits), "filter")
    out = digests
    for i, slot in enumerate(_slots(F.xxhash64(key), bits)):
        side = F.broadcast(found.select(F.col("bucket").alias(f"_b{i}"), F.col("bitmap").alias(f"_m{i}")))
        out = out.withColumn(f"_s{i}", slot).join(side, F.expr(f"bitmap_bucket_number(_s{i})") == F.col(f"_b{i}"), "left")
    both = _bit_set(F.col("_m0"), "_s0") & _bit_set(F.col("_m1"), "_s1")
    return out.select(*digests.columns, both.alias("maybe"))


def segments(docs: DataFrame, text: str, doc_id: str, rows: int) -> list[tuple[DataFrame, int]]:
    """(doc_id, text_sha256) of each segment, and its number of rows."""
    own = docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("text_sha256"))
    n = max(1, math.ceil(docs.count() / rows))
    spark, path = docs.sparkSession, scratch.new_path(docs.sparkSession, "digests")
    own.withColumn("segment", F.pmod(F.xxhash64("text_sha256", F.lit(1)), F.lit(n)).cast("int")).write.partitionBy("segment").parquet(path)
    whole = spark.read.schema(T.StructType([*own.schema.fields, T.StructField("segment", T.IntegerType())])).parquet(path)
    parts = [whole.filter(F.col("segment") == i).drop("segment") for i in range(n)]
    return [(part, part.count()) for part in parts]


def duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", broadcast_limit: int = BROADCAST_LIMIT, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    out = None
    for digests, n_rows in segments(docs, text, doc_id, segment_rows):
        part = _segment_duplicates(digests, n_rows, broadcast_limit)
        out = part if out is None else out.unionByName(part)
    return out


def _segment_duplicates(digests: DataFrame, n_rows: int, broadcast_limit: int) -> DataFrame:
    marked = scratch.table(possibly_repeated(digests, "text_sha256", n_rows), "marked")
    single = marked.filter("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    maybe = marked.filter("maybe").drop("maybe")
    groups = maybe.groupBy(F.col("text_sha256").alias("_key")).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # written, so that the join has shuffles of its own, which a hot key's rows can be split in
    groups = scratch.table(groups, "groups")
    if groups.count() * GROUP_ROW_BYTES <= broadcast_limit:
        groups = F.broadcast(groups)
    grouped = maybe.join(groups, F.col("text_sha256") == F.col("_key")).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return single.unionByName(grouped)


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A dropped row is known by (id, digest), so rows that share an id and
    differ in text are told apart.
    """
    dropped = duplicates(docs, text, doc_id).filter("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    dropped = scratch.table(dropped.distinct(), "dropped")
    if dropped.count() * DROPPED_ROW_BYTES <= BROADCAST_LIMIT:
        dropped = F.broadcast(dropped)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(doc_id).alias("_own"), digest(F.col(text)).alias("_digest"))
    return rows.join(dropped, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_sha")), "left_anti").select("_row.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLE_SQL = {
    "op4_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)"""
}
