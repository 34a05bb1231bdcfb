"""Substring deduplication with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words.  Its print is the smallest of the
hashes of its GRAM-word runs, so equal windows have equal prints and
neighbouring windows mostly share one: an entry stands for the windows of a
document that share the occurrence of a print.  Its context is 128 bits of all
words of those windows.

The index holds immutable runs, bucketed and sorted, in two levels, each with
one row per distinct value, so neither a frequent passage nor a large group of
copies makes a bucket large:

* prints: the smallest document with the print, where it stands, its context,
  and whether the history has the print in several contexts;
* windows: 128 bits of every window below a print with several contexts, and
  the smallest document that has it.

A new batch, whose ids follow those of the history, goes through these steps.
Its entries are aggregated by print and merge-joined with the print runs,
which are read bucket by bucket and never shuffled:

1. A print that neither the history nor another document has needs no work.
2. Under a print with one context, equal to the history's, all entries but the
   first document's are repeated in all their windows.
3. Under a print with several, entries whose context a smaller document of the
   batch has are repeated.  The first entry of each other context is verified:
   its text is read, and every window's own 128 bits are merge-joined with the
   window runs and aggregated over the batch.  Where a print of the history is
   met in a second context for the first time, the history's entry is read and
   added, too.

The aggregated rows are the batch's runs.  A print's row carries on what the
older runs know of it, so the newest run that has a print is valid.  Beyond
``MAX_RUNS`` runs ``add`` compacts them into one, in one shuffle of the level.  An index with a ``path`` is
kept there and opened again by the same call; without one its runs lie in the
shared folder and end with ``close``.

Windows are told apart by 128 bits, made of 128 bits of each word: of 10**13
windows two different ones agree with a probability below 10**-12.

Defined cases: a null text has no words; rows without an id neither lose words
nor make others lose them; ids may have any type with an order; rows that
repeat an id are told apart by their text, and the same id is never the smaller
one; a text with fewer than WINDOW words has no window, one of any length is
read whole; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .text import Words, blocks, column_bytes, pair, ragged, run_hashes

WINDOW = 50
GRAM = 16
MAX_RUNS = 4  # of an index that is kept
BATCHES = 2  # of the query, which compacts after each batch
BATCH_RUNS = 1
CUT_SAMPLE = 2000  # ids that the cuts between batches are taken from; they decide nothing but the batches' sizes
PRINT_KEY, WINDOW_KEY = ("print",), ("w1", "w2")


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Item i is the minimum of x[i : i + width]."""
    size, out = 1, x
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def occurrences(words: Words) -> tuple[np.ndarray, ...]:
    """Of each run of windows with one print: text, first window, windows, print, context (two rows)."""
    n, span = len(words.starts), WINDOW - GRAM + 1
    none = (*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64)), np.zeros((2, 0), np.uint64))
    if n < WINDOW:
        return none
    hashes = words.hashes()
    grams = run_hashes(hashes, GRAM)[0]
    keyed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(keyed, span) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(anchor))
    text = np.searchsorted(words.first, start, side="right") - 1
    valid = start + WINDOW <= words.first[text + 1]
    start, anchor, text = start[valid], anchor[valid], text[valid]
    if not len(start):
        return none
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(start)))
    first, at = start[begin], anchor[begin]
    size = count + WINDOW - 1  # words of the context: two runs of 32 or of 64 words cover it
    context = np.empty((2, len(first)), dtype=np.uint64)
    for run, some in ((32, size <= 64), (64, size > 64)):
        if some.any():
            covers = run_hashes(hashes, run)
            context[:, some] = pair(covers[:, first[some]], covers[:, first[some] + size[some] - run])
    context = pair(context, np.broadcast_to(size.astype(np.uint64), context.shape))
    return text[begin], first - words.first[text[begin]], count, grams[at], context


def _blocks(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, int, Words]]:
    data, offsets = column_bytes(batch.column(batch.schema.names.index(name)))
    for a, b in blocks(offsets):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def identified(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, text_key and text; the first two tell documents apart."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"))


def entries(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first_row, _, words in _blocks(batch):
                text, first, count, print_, context = occurrences(words)
                rows = pa.array(text + first_row)
                hashes = [pa.array(x.view(np.int64)) for x in (print_, np.ascontiguousarray(context[0]), np.ascontiguousarray(context[1]))]
                yield pa.RecordBatch.from_arrays(
                    [*hashes, batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["print", "c1", "c2", "doc_id", "text_key", "first", "count"],
                )

    return docs.mapInArrow(run, f"print long, c1 long, c2 long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, first int, count int")


def window_hashes(docs: DataFrame) -> DataFrame:
    """``docs`` with an array ``spots`` of (first, count, new): a row for each window in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = batch.column(batch.schema.names.index("spots"))
            ends = spots.offsets.to_numpy()
            flat = spots.values
            first, count, new = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for a, b, words in _blocks(batch):
                hashes = run_hashes(words.hashes(), WINDOW)
                own = slice(ends[a], ends[b])
                row = np.repeat(np.arange(a, b), np.diff(ends[a : b + 1]))
                begin, size = first[own].astype(np.int64), count[own].astype(np.int64)
                at = ragged(begin, size)
                rows = np.repeat(row, size)
                halves = hashes[:, at + words.first[rows - a]].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(halves[0]), pa.array(halves[1]), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(at.astype(np.int32)), pa.array(np.repeat(new[own], size))],
                    names=["w1", "w2", "doc_id", "text_key", "first", "new"],
                )

    return docs.mapInArrow(run, f"w1 long, w2 long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, first int, new boolean")


class Run:
    """An immutable table of the index, bucketed and sorted by its key."""

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...], n: int, rows: DataFrame | None = None):
        self.spark, self.path, self.key, self.n, self.name = spark, path, key, n, f"run_{uuid.uuid4().hex}"
        if rows is not None:
            rows.write.format("parquet").bucketBy(n, *key).sortBy(*key).option("path", path).saveAsTable(self.name)
        else:
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
            by = ", ".join(key)
            spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {n} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def forget(self, and_remove: bool) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if and_remove:
            scratch.remove(self.spark, self.path)


class FingerprintIndex:
    """The runs; ``add`` deduplicates a batch against them and itself."""

    def __init__(self, spark: SparkSession, path: str | None = None, max_runs: int = MAX_RUNS):
        self.spark, self.path, self.max_runs, self.version = spark, path, max_runs, 0
        self.n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.prints: list[Run] = []
        self.windows: list[Run] = []
        if path and (saved := self._saved()):
            self.version = max(saved)
            meta = json.loads(spark.read.text(f"{path}/index-{self.version}").first()[0])
            self.n = meta["buckets"]
            self.prints = [Run(spark, f"{path}/{x}", PRINT_KEY, self.n) for x in meta["prints"]]
            self.windows = [Run(spark, f"{path}/{x}", WINDOW_KEY, self.n) for x in meta["windows"]]

    def _saved(self) -> list[int]:
        """The versions of the index whose list of runs is complete."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/index-*/_SUCCESS")
        found = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(place)
        return [int(f.getPath().getParent().getName().split("-")[1]) for f in found or []]

    def _save(self) -> None:
        """Write the list of runs; older lists stay valid until this one is complete."""
        if self.path:
            meta = {"buckets": self.n, **{k: [r.path.rsplit("/", 1)[1] for r in runs] for k, runs in (("prints", self.prints), ("windows", self.windows))}}
            self.version += 1
            self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.text(f"{self.path}/index-{self.version}")

    def _run(self, rows: DataFrame, key: tuple[str, ...]) -> Run:
        path = f"{self.path}/run-{uuid.uuid4().hex}" if self.path else scratch.new_path(self.spark, "run")
        return Run(self.spark, path, key, self.n, rows)

    def close(self) -> None:
        """Forget the runs, and remove them where the index has no path of its own."""
        for run in (*self.prints, *self.windows):
            run.forget(not self.path)
        self.prints, self.windows = [], []

    def merged(self, runs: list[Run], key: tuple[str, ...], columns: list[str]) -> DataFrame:
        """One row per key, that of the newest run which has it."""
        union = None
        for age, run in enumerate(runs):
            part = run.rows().select(*key, F.struct(F.lit(age).alias("age"), *columns).alias("_row"))
            union = part if union is None else union.unionByName(part)
        return union.groupBy(*key).agg(F.max_by("_row", "_row.age").alias("_row")).select(*key, *[f"_row.{c}" for c in columns])

    def compact(self) -> None:
        """All runs of a level into one."""
        for runs, key, columns in ((self.prints, PRINT_KEY, PRINT_COLUMNS), (self.windows, WINDOW_KEY, WINDOW_COLUMNS)):
            if len(runs) > 1:
                old = list(runs)
                runs[:] = [self._run(self.merged(old, key, columns), key)]
                self._save()
                for run in old:
                    run.forget(True)

    def _with_history(self, fresh: DataFrame, runs: list[Run], key: tuple[str, ...], columns: list[str]) -> DataFrame:
        """``fresh`` with a struct ``old``, what the newest run that has the key says of it."""
        names = []
        for i, run in enumerate(reversed(runs)):
            side = run.rows().select(*[F.col(k).alias(f"_{k}{i}") for k in key], F.struct(*columns).alias(f"_old{i}"))
            on = [F.col(k) == F.col(f"_{k}{i}") for k in key]
            fresh = fresh.join(side.hint("merge"), on, "left").drop(*[f"_{k}{i}" for k in key])
            names.append(f"_old{i}")
        if not names:
            kind = ", ".join(f"{c}: {t.simpleString()}" for c, t in ((c, fresh.schema[c].dataType) for c in columns))
            return fresh.withColumn("old", F.lit(None).cast(f"struct<{kind}>"))
        return fresh.withColumn("old", F.coalesce(*names)).drop(*names)

    def add(self, batch: DataFrame, corpus: DataFrame) -> DataFrame:
        """doc_id, text_key and the repeated ranges (word from, word before) of documents of ``batch``.

        ``batch`` and ``corpus`` are made by ``identified``; ``corpus`` has the
        texts of all batches so far, this one among them.
        """
        own = scratch.table(entries(batch.filter("doc_id is not null")), "entries")
        context = F.struct("c1", "c2")
        place = F.struct("doc_id", "text_key", "first", "count", "c1", "c2")
        fresh = own.groupBy("print").agg(F.min(place).alias("_p"), F.max("doc_id").alias("last"), (F.min(context) != F.max(context)).alias("several"))
        fresh = fresh.select("print", "_p.*", "last", "several")
        known = self._with_history(fresh, self.prints, PRINT_KEY, PRINT_COLUMNS)
        old = F.col("old")
        met = old.isNotNull()
        several = F.col("several") | F.coalesce(old["several"] | (old["c1"] != F.col("c1")) | (old["c2"] != F.col("c2")), F.lit(False))
        first = lambda c: F.when(met, old[c]).otherwise(F.col(c)).alias(c)  # noqa: E731  ids of the history are smaller
        known = known.select(
            "print", *[first(c) for c in PRINT_COLUMNS[:-1]], several.alias("several"),
            (met | (F.col("last") != F.col("doc_id")) | several).alias("live"), (met & several & ~F.coalesce(old["several"], F.lit(False))).alias("newly"), met.alias("met"),
        )
        run = self._run(known, PRINT_KEY)
        live = run.rows().filter("live").select(F.col("print").alias("_print"), F.when(F.col("met"), F.col("doc_id")).alias("older"), F.col("several").alias("_several"))
        live = scratch.table(own.join(scratch.table(live, "live"), F.col("print") == F.col("_print")).drop("_print"), "entries")
        holders = scratch.table(live.groupBy(F.col("c1").alias("_c1"), F.col("c2").alias("_c2")).agg(F.min("doc_id").alias("holder")), "contexts")
        placed = scratch.table(live.join(holders, (F.col("c1") == F.col("_c1")) & (F.col("c2") == F.col("_c2"))), "placed")
        repeated = (F.col("holder") < F.col("doc_id")) | (~F.col("_several") & F.col("older").isNotNull())
        whole = placed.filter(repeated).select("doc_id", "text_key", F.col("first").alias("a"), (F.col("first") + F.col("count") - 1 + WINDOW).alias("b"))

        spot = F.struct("first", "count", "new")
        reps = placed.filter("_several and holder = doc_id").select("doc_id", "text_key", "first", "count", F.lit(True).alias("new"))
        reps = reps.unionByName(run.rows().filter("newly").select("doc_id", "text_key", "first", "count", F.lit(False).alias("new")))
        spots = scratch.table(reps.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_list(spot).alias("spots")), "spots")
        texts = corpus.join(spots, (F.col("doc_id") == F.col("_id")) & (F.col("text_key") == F.col("_key"))).select("doc_id", "text_key", "text", "spots")
        windows = scratch.table(window_hashes(texts), "windows")
        seen = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last"))
        seen = self._with_history(seen, self.windows, WINDOW_KEY, WINDOW_COLUMNS)
        seen = seen.select("w1", "w2", F.least("holder", F.col("old.holder")).alias("holder"), "last")
        window_run = self._run(seen, WINDOW_KEY)
        held = window_run.rows().filter("holder <> last").select(F.col("w1").alias("_w1"), F.col("w2").alias("_w2"), "holder")
        held = scratch.table(held, "held")
        again = windows.filter("new").join(held, (F.col("w1") == F.col("_w1")) & (F.col("w2") == F.col("_w2")) & (F.col("holder") < F.col("doc_id")))
        ranges = whole.unionByName(again.select("doc_id", "text_key", F.col("first").alias("a"), (F.col("first") + WINDOW).alias("b")))
        out = scratch.table(ranges.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("a", "b")).alias("ranges")), "ranges")
        scratch.drop(own, live, holders, placed, spots, windows, held)
        self.prints.append(run)
        self.windows.append(window_run)
        self._save()
        if len(self.prints) > self.max_runs:
            self.compact()
        return out


PRINT_COLUMNS = ["doc_id", "text_key", "first", "count", "c1", "c2", "several"]
WINDOW_COLUMNS = ["holder"]


def removal(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space) of ``identified`` documents."""
    table = ranges.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "ranges")
    joined = docs.join(table, (F.col("doc_id") == F.col("_id")) & (F.col("text_key") == F.col("_key")), "left").select("doc_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = batch.column(2)
            ends, flat = spots.offsets.to_numpy(), spots.values
            low, high = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            for a, b, words in _blocks(batch):
                row = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                depth = np.zeros(len(words.starts) + 1, dtype=np.int64)
                np.add.at(depth, low[ends[a] : ends[b]] + words.first[row], 1)
                np.add.at(depth, high[ends[a] : ends[b]] + words.first[row], -1)
                keep = np.cumsum(depth)[:-1] == 0
                size = (words.ends - words.starts + 1)[keep]
                text = np.append(words.data, np.uint8(32))[ragged(words.starts[keep], size)]
                cuts = np.concatenate(([0], np.cumsum(size)))
                text[cuts[1:] - 1] = 32
                kept = np.concatenate(([0], np.cumsum(keep)))[words.first]
                raw, at = text.tobytes(), cuts[kept].tolist()
                texts = [raw[x : max(x, y - 1)] for x, y in zip(at[:-1], at[1:], strict=True)]
                n_words = words.counts
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n_words), pa.array(n_words - np.diff(kept)), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_text"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_text string")


def id_cuts(docs: DataFrame, batches: int) -> list:
    """Ids that cut the documents into about equal batches, from a bounded sample of ids."""
    some = docs.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id")).limit(CUT_SAMPLE)
    ids = [r[0] for r in some.orderBy("doc_id").collect()]
    cuts = [ids[len(ids) * i // batches] for i in range(1, batches)] if ids else []
    return [x for i, x in enumerate(cuts) if x not in cuts[:i]]


def repeated_ranges(docs: DataFrame, batches: int = BATCHES, max_runs: int = BATCH_RUNS) -> DataFrame:
    """Ranges of all ``identified`` documents, taken in batches of ascending ids."""
    index = FingerprintIndex(docs.sparkSession, max_runs=max_runs)
    cuts = id_cuts(docs, batches)
    out = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        so_far = docs if high is None else docs.filter(F.col("doc_id") <= F.lit(high))
        batch = so_far if low is None else so_far.filter(F.col("doc_id") > F.lit(low))
        part = index.add(batch, so_far)
        out = part if out is None else out.unionByName(part)
    index.close()
    return out


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", batches: int = BATCHES, max_runs: int = BATCH_RUNS) -> DataFrame:
    own = identified(docs, text, doc_id)
    return removal(own, repeated_ranges(own, batches, max_runs))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
