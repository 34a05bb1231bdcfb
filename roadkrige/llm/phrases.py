"""Phrase collocation mining over depth-limited count tries.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?]`` and at line ends,
and pieces into words ``[^\\x20\\x09]+``.  Every word starts one path: its
language, itself and up to four words that follow it in the piece.

1. A shard, ``SHARD`` bytes of text in one task, inserts its paths into a count
   trie.  The trie is kept as its sorted leaves: words are numbered in byte
   order, paths are rows of numbers, and equal rows are counted.
2. Tries are serialised in sorted chunks: each leaf states how many words it
   shares with the one before, the new words, and its count.  Chunks end at the
   bounds of prefix ranges.  The bounds are paths of the tries of a sample of
   about ``SAMPLE`` bytes of text; they decide the sizes of the ranges only.
3. A range is merged in one task: chunks of all shards come sorted by their
   first path, and whenever enough are there, all leaves before the newest first
   path are merged and their nodes counted.  A node with fewer than
   ``min_count`` occurrences goes, unless it is the first or last of its depth
   in what was merged; such nodes may go on elsewhere and are added up after.
4. The merged trie, in order, is walked by a running window: the last node of
   depth k before a node is its first k words (left parts; all of them are as
   frequent as the node at least, so none is missing).  Suffix links, a join on
   the words after the first k, lead to the right parts.

A longer candidate that makes a shorter one redundant does so through one that
is longer by one word, as counts do not rise with length; so a node is compared
with its children and with the nodes that link to it only.

Nothing is held whole: a shard and what overlaps a merge front are bounded by
parameters, and the bounds of ranges are one path for ``RANGE`` bytes of text.

Defined cases: a null text is empty; a null language is ``und``, one with a
language of that name; repeated rows and ids count as often as they are there;
a text longer than a shard is a shard of its own; an empty table, or one
without a frequent phrase, gives an empty result; equal scores go by count,
largest first, then by the phrase's bytes; further columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch
from .text import LOWER, Words, blocks, column_bytes

LONGEST = 5
MIN_COUNT = 100
KEEP_SHARE = 100  # per cent of a phrase's occurrences that lie in a longer one before it goes
TOP = 2000
UNKNOWN = "und"
SHARD = 6 << 20
CHUNK = 1 << 12  # leaves
FRONT = 1 << 18  # leaves that are gathered before a merge
RANGE = 24 << 20
SAMPLE = 24 << 20
SALTS = 32
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_CHUNK = "range int, head array<string>, words array<string>, shared binary, size binary, fresh binary, n binary"


def number(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in byte order, and the place of each in it."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary.cast(pa.large_binary()))
    rank = np.empty(len(order), dtype=np.int32)
    rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    return coded.dictionary.take(order), rank[coded.indices.to_numpy(zero_copy_only=False)]


def ordered(paths: np.ndarray, base: int) -> np.ndarray:
    """The order of rows of numbers below ``base``."""
    bits = max(1, int(base).bit_length())
    each = 63 // bits
    keys = []
    for a in range(0, paths.shape[1], max(1, each)):
        key = np.zeros(len(paths), dtype=np.int64)
        for c in paths[:, a : a + max(1, each)].T:
            key = (key << bits) | c
        keys.append(key)
    return np.lexsort(keys[::-1])


def shared_words(paths: np.ndarray) -> np.ndarray:
    """How many leading numbers each row has in common with the row before; 0 for the first."""
    out, same = np.zeros(len(paths), dtype=np.uint8), np.ones(max(0, len(paths) - 1), dtype=bool)
    for c in range(paths.shape[1]):
        same &= paths[1:, c] == paths[:-1, c]
        out[1:] += same
    return out


def counted(paths: np.ndarray, n: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows and the sums of ``n``: the leaves of a trie."""
    order = ordered(paths, base)
    paths, n = paths[order], n[order]
    first = np.flatnonzero(shared_words(paths) < paths.shape[1])
    return paths[first], np.add.reduceat(n, first) if len(first) else n


def trie(text: pa.Array, lang: pa.Array, longest: int = LONGEST) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A shard's words in byte order, its paths (language, words; numbers from 1, 0 where a path has ended) and their counts."""
    data, offsets = column_bytes(text)
    ends = _ENDS[data]
    words = Words(np.where(ends, 32, LOWER[data]).astype(np.uint8), offsets)
    total = len(words.starts)
    names = pc.cast(pa.concat_arrays([words.column(), lang.cast(pa.large_binary())]), pa.large_binary())
    known, rank = number(names)
    text_of = np.repeat(np.arange(len(text), dtype=np.int32), words.counts)
    # pieces end with a text, and where an end lies between two words
    piece = (np.cumsum(ends)[words.starts] if total else np.zeros(0, np.int64)) + np.int64(len(data) + 1) * text_of
    paths = np.zeros((total, longest + 1), dtype=np.int32)
    paths[:, 0] = rank[total:][text_of] + 1
    for k in range(min(longest, total)):
        on = piece[: total - k] == piece[k:]
        paths[: total - k, k + 1][on] = rank[k:total][on] + 1
    return known, *counted(paths, np.ones(total, dtype=np.int64), len(known) + 1)


def place(paths: np.ndarray, known: list[bytes], path: list[bytes]) -> int:
    """The first row of sorted ``paths`` that is not before ``path``."""
    a, b = 0, len(paths)
    for c in range(paths.shape[1]):
        if c == len(path):  # what begins with the path is not before it
            return a
        at = bisect_left(known, path[c])
        column = paths[a:b, c]
        if at == len(known) or known[at] != path[c]:
            return a + int(np.searchsorted(column, at + 1))
        a, b = a + int(np.searchsorted(column, at + 1)), a + int(np.searchsorted(column, at + 1, side="right"))
    return a


def chunk(known: pa.Array, paths: np.ndarray, n: np.ndarray) -> tuple:
    """Leaves in a row: head, words, and by leaf the words shared, the length, the new words and the count."""
    shared, size = shared_words(paths), (paths > 0).sum(1)
    new = (np.arange(paths.shape[1]) >= shared[:, None]) & (paths > 0)
    own, fresh = np.unique(paths[new], return_inverse=True)
    words = known.take(pa.array(own - 1)).cast(pa.string())
    head = known.take(pa.array(paths[0, : size[0]] - 1)).cast(pa.string()).to_pylist()
    return head, words, shared.tobytes(), size.astype(np.uint8).tobytes(), packed(fresh), packed(n)


def packed(x: np.ndarray) -> bytes:
    """Numbers of the narrowest width that holds them all."""
    return x.astype(f"<u{next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * w)}").tobytes()


def unpacked(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // count}") if count else np.zeros(0, np.uint8)


def opened(words: pa.Array, shared: bytes, size: bytes, fresh: bytes, n: bytes, depth: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words, paths and counts of a chunk."""
    shared, size = np.frombuffer(shared, np.uint8).astype(np.int64), np.frombuffer(size, np.uint8).astype(np.int64)
    column = np.arange(depth)
    paths = np.zeros((len(size), depth), dtype=np.int32)
    new = (column >= shared[:, None]) & (column < size[:, None])
    paths[new] = unpacked(fresh, int(new.sum())).astype(np.int32) + 1
    # a shared word was last new in the nearest row above that shares fewer words
    for c in range(depth):
        last = np.maximum.accumulate(np.where(shared <= c, np.arange(len(size)), 0))
        paths[:, c] = np.where(c < size, paths[last, c], 0)
    return words, paths, unpacked(n, len(size)).astype(np.int64)


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Texts and languages of about ``limit`` bytes at a time."""
    held, size = [], 0
    for b in batches:
        _, offsets = column_bytes(b.column(0))
        for first, last in blocks(offsets, limit):
            if held and size + offsets[last] - offsets[first] > limit:
                yield tuple(pa.concat_arrays([h.column(i) for h in held]) for i in (0, 1))
                held, size = [], 0
            held.append(b.slice(first, last - first))
            size += int(offsets[last] - offsets[first])
    if held:
        yield tuple(pa.concat_arrays([h.column(i) for h in held]) for i in (0, 1))


def texts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"))


@dataclass(frozen=True)
class Sizes:
    """What bounds memory: bytes of a shard and of a range's text, leaves of a chunk and of a merge front."""

    shard: int = SHARD
    range: int = RANGE
    chunk: int = CHUNK
    front: int = FRONT


def bounds(rows: DataFrame, longest: int, total: int, sizes: Sizes) -> list[list[bytes]]:
    """Paths that cut the corpus into ranges of about ``sizes.range`` bytes of text, from the tries of a sample."""
    ranges = -(-total // sizes.range)
    if ranges <= 1:
        return []
    part = F.pmod(F.xxhash64("text", "lang"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, SAMPLE / total)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, lang in _shards(batches, sizes.shard):
            known, paths, n = trie(text, lang, longest)
            at = np.flatnonzero(np.diff(np.cumsum(n) // 256, prepend=0))  # a head for 256 words
            head = [known.take(pa.array(p[p > 0] - 1)).cast(pa.string()).to_pylist() for p in paths[at]]
            yield pa.RecordBatch.from_arrays([pa.array(head, pa.list_(pa.string()))], names=["head"])

    heads = sorted([w.encode() for w in r.head] for r in rows.filter(part).mapInArrow(run, "head array<string>").toLocalIterator())
    cuts = [heads[len(heads) * i // ranges] for i in range(1, ranges)] if heads else []
    return [c for i, c in enumerate(cuts) if i == 0 or c != cuts[i - 1]]


def tries(rows: DataFrame, cuts: list[list[bytes]], longest: int, sizes: Sizes) -> DataFrame:
    """Serialised tries of all shards, in chunks that lie in one range each."""
    sent = rows.sparkSession.sparkContext.broadcast(cuts)  # one path for RANGE bytes of text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.binary()] * 4)
        names = ["range", "head", "words", "shared", "size", "fresh", "n"]
        for text, lang in _shards(batches, sizes.shard):
            known, paths, n = trie(text, lang, longest)
            words = known.to_pylist()
            edges = [0, *(place(paths, words, c) for c in sent.value), len(paths)]
            for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                for at in range(a, b, sizes.chunk):
                    row = chunk(known, paths[at : min(b, at + sizes.chunk)], n[at : min(b, at + sizes.chunk)])
                    cols = [pa.array([v], t) if not isinstance(v, pa.Array) else pa.ListArray.from_arrays([0, len(v)], v) for v, t in zip((i, *row), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, _CHUNK)


class Front:
    """Chunks of one range on their way through a merge."""

    def __init__(self, min_count: int, depth: int, leaves: int):
        self.min_count, self.depth, self.enough, self.held, self.leaves, self.left = min_count, depth, leaves, [], 0, 0

    def add(self, row: dict) -> None:
        part = opened(row["words"], row["shared"], row["size"], row["fresh"], row["n"], self.depth)
        self.held.append(part)
        self.leaves += len(part[2])

    def due(self) -> bool:
        return self.leaves >= max(self.enough, 2 * self.left)

    def merge(self, until: list[str] | None) -> Iterator[pa.RecordBatch]:
        """Nodes of all leaves before the path ``until``; the rest stays."""
        low, high = [], []
        for words, paths, n in self.held:
            at = len(paths) if until is None else place(paths, words.cast(pa.binary()).to_pylist(), [w.encode() for w in until])
            low += [(words, paths[:at], n[:at])] * (at > 0)
            high += [(words, paths[at:], n[at:])] * (at < len(paths))
        self.held, self.leaves = high, sum(len(n) for *_, n in high)
        self.left = self.leaves
        if not low:
            return
        known, rank = number(pa.concat_arrays([w for w, *_ in low]))
        starts = np.cumsum([0] + [len(w) for w, *_ in low])
        paths = np.concatenate([np.concatenate((np.zeros(1, np.int32), rank[s : s + len(w)] + 1))[p] for s, (w, p, _) in zip(starts, low, strict=False)])
        paths, n = counted(paths, np.concatenate([n for *_, n in low]), len(known) + 1)
        shared = shared_words(paths)
        for depth in range(1, self.depth + 1):
            deep = paths[:, depth - 1] > 0
            reach = np.flatnonzero(deep)
            if not len(reach):
                return
            new = np.searchsorted(reach, np.flatnonzero(deep & (shared < depth)))
            count = np.add.reduceat(n[reach], new)
            keep = count >= self.min_count
            keep[[0, -1]] = True  # may go on in another part
            at = paths[reach[new[keep]], :depth]
            lang = known.take(pa.array(at[:, 0] - 1))
            phrase = known.take(pa.array(at[:, 1:].ravel() - 1))
            phrase = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * (depth - 1)), phrase.cast(pa.string()))
            yield pa.RecordBatch.from_arrays([lang.cast(pa.string()), phrase, pa.array(count[keep])], names=["lang", "words", "a"])


def nodes(rows: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, sizes: Sizes = Sizes()) -> DataFrame:
    """lang, words, a: all phrases of at most ``longest`` words with ``min_count`` occurrences; without words, all words of the language."""
    total = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    cuts = bounds(rows, longest, total, sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        front, at = Front(min_count, longest + 1, sizes.front), None
        for b in batches:
            for i in range(b.num_rows):
                row = {name: b.column(name)[i].as_py() for name in ("range", "head", "shared", "size", "fresh", "n")}
                row["words"] = b.column("words")[i].values
                if front.held and row["range"] != at:
                    yield from front.merge(None)
                    front = Front(min_count, longest + 1, sizes.front)
                elif front.due():
                    yield from front.merge(row["head"])
                at = row["range"]
                front.add(row)
        if front.held:
            yield from front.merge(None)

    spread = tries(rows, cuts, longest, sizes).repartition(len(cuts) + 1, "range").sortWithinPartitions("range", "head")
    merged = spread.mapInArrow(run, "lang string, words array<string>, a long")
    return merged.groupBy("lang", "words").agg(F.sum("a").alias("a")).filter((F.col("a") >= min_count) | (F.size("words") == 0))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, keep_share: int = KEEP_SHARE, top: int = TOP, text: str = "text", lang: str = "lang", sizes: Sizes = Sizes()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each language."""
    found = scratch.table(nodes(texts(docs, text, lang), min_count, longest, sizes), "trie")
    size = F.size("words")
    order = Window.partitionBy("lang", F.element_at("words", 1)).orderBy("words").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = found.filter(size > 0).select("lang", "words", "a", *[F.last(F.when(size == k, F.col("a")), ignorenulls=True).over(order).alias(f"l{k}") for k in range(1, longest)])
    # cuts after the first k words, the right part by k suffix links
    cut = lambda k: F.struct(F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.slice("words", k + 1, F.lit(longest)).alias("right"))
    cuts = walked.filter(size > 1).select("lang", "words", "a", F.explode(F.slice(F.array(*[cut(k) for k in range(1, longest)]), 1, size - 1)).alias("c")).select("lang", "words", "a", "c.*")
    linked = cuts.join(found.select("lang", F.col("words").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    total = found.filter(size == 0).select("lang", F.col("a").alias("n"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    linked = linked.join(total, "lang").withColumns({"over": F.lit(1000).cast("decimal(4,0)") * wide("a"), "n19": wide("n"), "lr": wide("l") * wide("r")})
    scored = linked.withColumn("score", F.expr("cast(over * n19 as decimal(38,0)) div lr"))
    best = scored.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"), F.min(F.when(F.col("k") == 1, F.col("r"))).alias("link"), F.min(F.when(F.col("k") == size - 1, F.col("l"))).alias("parent"))
    best = scratch.table(best.select("lang", "words", "a", "n", "m.score", "m.l", "m.r", "link", "parent"), "scored")
    # a phrase that is the beginning or the end of one that is longer by a word, and nearly as frequent
    covers = lambda c: 100 * F.col("a") >= keep_share * F.col(c)
    longer = best.filter(size > 2)
    parts = F.filter(F.array(F.when(covers("parent"), F.slice("words", F.lit(1), size - 1)), F.when(covers("link"), F.slice("words", F.lit(2), size - 1))), lambda w: w.isNotNull())
    covered = longer.select("lang", F.explode(parts).alias("words")).distinct()
    kept = best.join(covered, ["lang", "words"], "left_anti").withColumn("phrase", F.array_join("words", " "))
    by = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    salt = F.pmod(F.xxhash64("words"), F.lit(SALTS))
    first = kept.withColumn("salt", salt).withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*by))).filter(F.col("at") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_phrases": op12_phrases}
ORACLE_SQL = {
    "op12_phrases": r"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
        s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
        g AS (SELECT lang, w[i : i + m - 1] AS w, m FROM s, range(1, 6) x(m) WHERE i + m - 1 <= len(w)),
        f AS MATERIALIZED (SELECT lang, w, m, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
        c AS (SELECT f.lang, f.w, f.m, f.a, l.a AS l, r.a AS r, n, k, (1000 * f.a::HUGEINT * n) // (l.a::HUGEINT * r.a) AS score
            FROM f JOIN range(1, 5) x(k) ON k < f.m JOIN f l ON l.lang = f.lang AND l.w = f.w[1 : k]
            JOIN f r ON r.lang = f.lang AND r.w = f.w[k + 1 : f.m] JOIN n ON n.lang = f.lang),
        least AS (SELECT lang, w, m, a, n, min({'score': score, 'k': k, 'l': l, 'r': r}) AS x FROM c GROUP BY lang, w, m, a, n),
        b AS (SELECT lang, w, m, a, n, x.score AS score, x.l AS l, x.r AS r FROM least),
        sub AS (SELECT lang, w, a, m, unnest(range(2, m)) AS q FROM b WHERE m > 2),
        inside AS (SELECT lang, a, w[i : i + q - 1] AS w FROM (SELECT *, unnest(range(1, m - q + 2)) AS i FROM sub)),
        kept AS (SELECT * FROM b WHERE NOT EXISTS (FROM inside WHERE inside.lang = b.lang AND inside.w = b.w AND 100 * inside.a >= 100 * b.a)),
        ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank, array_to_string(w, ' ') AS phrase, a, l, r, n, score FROM kept)
        SELECT lang, rank::INTEGER AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000"""
}
