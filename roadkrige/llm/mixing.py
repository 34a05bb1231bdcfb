"""Mixing sources to target weights, in DataFrame functions only.

Words are summed per source, each source gets a target (its weight's share of
all words, at most ``MAX_REPEATS`` times its size, the excess shared again by
weight), and rate = target / size.  A document is emitted floor(rate) times
plus one Bernoulli copy whose probability is the rate's fraction.

The draw of most documents is a hash of the id and ``SEED`` below the fraction.
The ``HEAVY`` largest documents of each source, which would make its taken
words stray, are drawn together, in order of size: with the fraction f and a
number u hashed of the source, the r-th one gets a copy if
floor(f r + u) > floor(f (r - 1) + u).  So every document has its copy with
probability f exactly, and of the heavy ones' words as many are taken as f asks
for, give or take less than the largest one's.  (A source whose words are mostly
one document's must stray: that document has its copy or not.)

The levelling needs no loop.  With sources in order of cap / weight, those at
their cap are a prefix, so running sums find it exactly.  These windows run
over one row per source in one task, sorted and spilled by Spark: some ten
million sources are a matter of seconds.

Only tables with rows per source are joined to the documents: the rates,
broadcast while they have at most ``BROADCAST_SOURCES`` rows, and the heavy
documents, while they have at most ``BROADCAST_SOURCES``.  Beyond that they are
joined by shuffle.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; a source without words has target 0 and its documents are not
taken; rows that repeat an id share its draw where their sizes agree; null ids
share one draw; equal sizes are ordered by a hash of the id; a text of any
length is counted whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch
from .text import WORD_RE

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = 3
HEAVY = 256
BROADCAST_SOURCES = 100_000


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def draw(key) -> F.Column:
    """A number in [0, 1) made of a key and SEED: eight digits of a hash."""
    named = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{SEED}"))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(totals: DataFrame) -> DataFrame:
    """(source, source_size) with weight and target; one row a source, so one task suffices."""
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MAX_REPEATS)
    order = Window.orderBy((F.col("cap").cast("double") / F.col("weight").cast("double")).asc(), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    placed = (
        ranked.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("_caps", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("_weights", F.sum("weight").over(onward))
        .withColumn("at_cap", F.col("cap").cast("double") * F.col("_weights") <= F.col("weight").cast("double") * (F.col("total") - F.col("_caps")))
    )
    level = F.col("_left").cast("double") / F.col("_free").cast("double")
    return (
        placed.withColumn("_left", F.col("total") - F.coalesce(F.sum(F.when(F.col("at_cap"), F.col("cap"))).over(whole), F.lit(0)))
        .withColumn("_free", F.sum(F.when(~F.col("at_cap"), F.col("weight"))).over(whole))
        .withColumn("target", F.when(F.col("at_cap"), F.col("cap").cast("double")).otherwise(F.col("weight") * level))
        .select("source", "source_size", "weight", "target")
    )


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def rates(sizes: DataFrame) -> DataFrame:
    """Per source: source_size, target, base (whole copies) and part (probability of one more)."""
    goal = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    goal = goal.withColumn("base", F.floor(rate)).withColumn("part", rate - F.floor(rate))
    return scratch.table(goal.select(F.col("source").alias("_source"), "source_size", "target", "base", "part"), "rates")


def heavy(sizes: DataFrame, table: DataFrame) -> DataFrame:
    """The largest documents of each source, and whether they get one more copy."""
    order = Window.partitionBy("source").orderBy(F.col("size").desc(), draw(F.col("doc_id")), "doc_id")
    # the window keeps at most HEAVY rows of a source in each task before it shuffles
    ranked = sizes.select("source", "doc_id", "size").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= HEAVY)
    ranked = ranked.groupBy("source", "doc_id", "size").agg(F.min("rank").alias("rank"))
    ranked = ranked.join(small(table, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_source")))
    up_to = lambda r: F.floor(F.col("part") * r + draw(F.col("source")))
    more = up_to(F.col("rank")) > up_to(F.col("rank") - 1)
    return scratch.table(ranked.select(F.col("source").alias("_hs"), F.col("doc_id").alias("_hd"), F.col("size").alias("_hn"), more.alias("_more")), "heavy")


def with_copies(df: DataFrame, sizes: DataFrame, table: DataFrame, source: str = "source", doc_id: str = "doc_id", size: str = "size") -> DataFrame:
    """``df`` with source_size, target and how many copies of each row the mix has."""
    some = small(heavy(sizes, table), BROADCAST_SOURCES)
    same = F.col(source).eqNullSafe(F.col("_hs")) & F.col(doc_id).eqNullSafe(F.col("_hd")) & (F.col(size) == F.col("_hn"))
    joined = df.join(small(table, BROADCAST_SOURCES), F.col(source).eqNullSafe(F.col("_source"))).join(some, same, "left")
    extra = F.coalesce("_more", draw(F.col(doc_id)) < F.col("part")).cast("int")
    return joined.withColumn("copies", F.col("base") + extra).drop("_source", "base", "part", "_hs", "_hd", "_hn", "_more")


def size_table(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    return scratch.table(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")), "sizes"
    )


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the mix has, each as often as it has them."""
    sizes = size_table(docs, text, source, doc_id)
    table = rates(sizes)
    own = docs.select(F.struct(*map(F.col, docs.columns)).alias("_row"), F.col(source).alias("_s"), F.col(doc_id).alias("_d"), n_words(F.col(text)).alias("_n"))
    chosen = with_copies(own, sizes, table, "_s", "_d", "_n").filter("copies > 0")
    return chosen.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_n")).select("_row.*")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = size_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return with_copies(sizes, sizes, rates(sizes)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


QUERIES = {"op6_mix_sources": op6_mix_sources}
ORACLE_SQL = {
    "op6_mix_sources": rf"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
            FROM documents),
        t AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM t),
        w AS (SELECT *, rank % 3 + 1 AS weight, 3 * s AS cap FROM r),
        p AS (
            SELECT *, sum(s) OVER ()::BIGINT AS total,
                   coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS caps,
                   sum(weight) OVER (ORDER BY cap::DOUBLE / weight::DOUBLE, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weights
            FROM w),
        c AS (SELECT *, cap::DOUBLE * weights <= weight::DOUBLE * (total - caps) AS at_cap FROM p),
        l AS (
            SELECT *, total - coalesce(sum(cap) FILTER (at_cap) OVER (), 0)::BIGINT AS lft,
                   (sum(weight) FILTER (NOT at_cap) OVER ())::BIGINT AS free
            FROM c),
        g AS (
            SELECT source, s, CASE WHEN at_cap THEN cap::DOUBLE ELSE weight * (lft::DOUBLE / free::DOUBLE) END AS target FROM l),
        q AS (SELECT *, coalesce(target / nullif(s, 0)::DOUBLE, 0.0) AS rate FROM g),
        b AS (SELECT *, floor(rate) AS base, rate - floor(rate) AS part FROM q),
        e AS (
            SELECT d.doc_id, d.source, d.size, b.s, b.target, b.base, b.part,
                   ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || ':{SEED}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw,
                   ('0x' || substr(md5(coalesce(d.source, 'null') || ':{SEED}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
            FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
        h AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, draw, doc_id) AS own FROM e),
        m AS (SELECT *, min(own) OVER (PARTITION BY source, doc_id, size) AS rank FROM h),
        x AS (
            SELECT *, CASE WHEN rank <= {HEAVY} THEN floor(part * rank + start) > floor(part * (rank - 1) + start) ELSE draw < part END AS extra
            FROM m)
        SELECT doc_id, size, s AS source_size, target, ((base + extra::INT) * size)::BIGINT AS taken FROM x"""
}
