"""N-gram Jaccard join with PartEnum signatures.

A document's set holds the 64-bit hashes of its distinct k-word shingles, made
from 128 bits of each word; equal sets have equal 128-bit keys, and from here on
a key stands for all documents with its set.

Signatures.  Sizes are cut into bands that grow by 1 / similarity, so the sets
of a link lie in one band or in two neighbouring ones.  Instance i serves the
links whose smaller set lies in band i; a set takes part in that of its own
band and in the one before.  With r and R the largest sizes of bands i and
i + 1, linked sets differ in at most
``d = floor((r + R) (1 - similarity) / (1 + similarity))`` shingles.  The
shingle domain is cut, by hash, into n1 parts of N2 second-level parts, n1 above
d / (FREE + 1).  A part with at most FREE of the differences has N2 - FREE
second-level parts that are the same in both sets.  So one signature is made for
each of the n1 parts and each choice of N2 - FREE of its second-level parts:
the hash of the shingles there.

A choice without shingles gives no signature, as all sets would share it.  With
x0 parts free of differences and x1 with 1 to FREE of them,
``x0 (FREE + 1) + x1 FREE >= (FREE + 1) n1 - d`` (every other part holds FREE + 1
differences or more).  Two linked sets miss each other only if the x0 parts are
empty and the x1 parts have an empty choice, in both sets.  A set with too few
such parts for that is safe.  Any other cuts the domain anew with another seed,
up to TRIES times, and after that emits one signature for all such sets.  That
loses no link: two linked sets that miss each other at one try both go on to
the next.

Candidates.  Signatures shuffle in buckets that a task can hold, packed to eight
bytes each with a list of short keys per bucket and block of texts; equal ones
are found by sorting, and each key is paired with its leader, the smallest key
of its signature.  All keys that share some signature under one leader form the
leader's group, so each candidate pair lies in a group.

Verification.  A group of at most ``BLOCK_ROWS`` keys and ``BLOCK_SHINGLES``
shingles is compared in one task.  Larger ones first lose the keys that can have
no link there.  A shingle that only one key of all large groups has is in no
intersection, so a key shares at most its other shingles, and a set of known
size and number of such others bounds the similarity.  A key whose bound is too
low for every size in its group leaves it.  In a group of copies around one
original these are the copies too far from it, which have no links but would be
compared with all others.  Keys of groups still large take two rounds, so that
the texts shipped grow with a group and not with its square:

1. Each of these keys goes to one large group, that of its smallest leader,
   which is cut into blocks by a hash.  The pivots, its first block and at most
   as many keys more that share most signatures with others (in a group of near
   copies the original among them), are compared with every other block, so at
   most three times the keys are shipped.
2. Components of the links found so far are formed.  Of each group with such
   keys that is in several components, those outside the largest are compared
   with the whole group.  Pairs inside one component need no comparison.

A task holds two blocks.  It counts shared shingles in an inverted list; before
a link counts, the words of the shared shingles are compared byte by byte.  Only
a spanning forest of the links leaves the task.  Components of the links and of
equal sets give the result.

Defined cases: null, empty and white texts have no set and are linked with
nothing; with fewer than k words the whole sequence is the one shingle; rows
that repeat an id are nodes by text, and component_id is the smallest id of
the component; a null id is never the smallest unless alone, then null; a text
of any length is compared whole; further columns are kept where rows are
returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch
from .components import connected_components
from .text import LOWER, Words, blocks, column_bytes, mix, ragged, run_hashes

N2 = 3
FREE = 1
TRIES = 6
BLOCK_ROWS = 128
BLOCK_SHINGLES = 2_000_000
KEY_BYTES = 32
MEMBER_BYTES = 96
BROADCAST_LIMIT = 64 << 20
PACK_SIGNATURES = 1_000_000
PACK_KEYS = 60_000
BUCKET_SHINGLES = 4_000_000
SEEN = 500_000  # keys a task remembers so as not to repeat their signatures


class Shingles:
    """The set of one text: sorted distinct hashes, the first word of each, and the words."""

    def __init__(self, values: np.ndarray, at: np.ndarray, k: int, words: pa.Array):
        self.values, self.at, self.k, self.words = values, at, k, words

    def __len__(self) -> int:
        return len(self.values)

    @property
    def key(self) -> bytes | None:
        """A 128-bit key of the set, null for an empty one."""
        return xxhash.xxh3_128_digest(self.values.tobytes()) if len(self.values) else None

    def common(self, other: Shingles) -> int:
        """How many shingles are shared, by their words."""
        if self.k != other.k:
            return 0
        _, a, b = np.intersect1d(self.values, other.values, assume_unique=True, return_indices=True)
        word = pa.concat_arrays([self.words, other.words]).dictionary_encode().indices.to_numpy()
        a, b = self.at[a], other.at[b] + len(self.words)
        same = np.ones(len(a), dtype=bool)
        for i in range(self.k):
            same &= word[a + i] == word[b + i]
        return int(same.sum())


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, exact: bool = False) -> list[Shingles]:
    """The shingles of each text, with its words where ``exact``."""
    words = Words(data, offsets)
    hashes = words.hashes(lower=True)
    column = words.column(LOWER[data]) if exact else pa.array([], pa.large_binary())
    runs = shingle_hash(run_hashes(hashes, k))
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        size = min(k, b - a)
        if size == k:
            values, at = np.unique(runs[a : b - k + 1], return_index=True)
        elif size:
            values, at = shingle_hash(run_hashes(hashes[:, a:b], size)) + np.uint64(size), np.zeros(1, np.int64)
        else:
            values, at = runs[:0], np.zeros(0, np.int64)
        out.append(Shingles(values, at, size, column.slice(a, b - a)))
    return out


def shingle_hash(halves: np.ndarray) -> np.ndarray:
    return halves[0] ^ mix(halves[1])


def short_key(key: bytes) -> int:
    """63 bits of a key, for candidates only."""
    return int.from_bytes(key[:8], "little") >> 1


CHOICES = np.array(list(combinations(range(N2), N2 - FREE)))


class Bands:
    """The size bands of a similarity (a fraction) and the instances a size takes part in."""

    def __init__(self, similarity: Fraction):
        self.similarity, self.tops = similarity, [0]

    def instances(self, size: int) -> list[tuple[int, int]]:
        """(instance, largest difference of sets linked in it) for a size.

        Instance i is for links whose smaller set lies in band i and whose
        larger one in band i or i + 1, so a set of band b takes part in b - 1 and b.
        """
        while len(self.tops) < 4 or self.tops[-3] < size:
            low = self.tops[-1] + 1
            self.tops.append(max(low, int(low / self.similarity)))
        own = int(np.searchsorted(self.tops, size))
        ratio = (1 - self.similarity) / (1 + self.similarity)
        return [(i, int(ratio * (self.tops[i] + self.tops[i + 1]))) for i in (own - 1, own) if i > 0]

    @cache
    def parts(self, instance: int, differences: int) -> tuple[int, int]:
        """n1 and ``sure``: as few parts as leave a set of the least size rarely with too many empty ones."""
        least, size = differences // (FREE + 1), self.tops[instance - 1] + 1
        sure = 1
        while sure < least + 8:
            n1 = least + sure
            some = n1 * min(1.0, len(CHOICES) * (1 - (N2 - FREE) / (N2 * n1)) ** size)
            if sure > (some + 2 * some**0.5) / (FREE + 1):
                break
            sure += 1
        return least + sure, sure


def signatures(values: np.ndarray, bands: Bands) -> np.ndarray:
    """The distinct signatures of one set."""
    out = []
    for band, differences in bands.instances(len(values)):
        if differences == 0:  # only equal sets, which share their key
            continue
        n1, sure = bands.parts(band, differences)
        for turn in range(TRIES):
            name = np.uint64((band << 8) + turn)
            spread = mix(values + name)
            part = (spread % np.uint64(n1 * N2)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(n1 * N2 + 1))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(spread[order]))))
            cells = (sums[cuts[1:]] - sums[cuts[:-1]]).reshape(n1, N2)
            filled = np.diff(cuts).reshape(n1, N2)[:, CHOICES].sum(2) > 0
            label = np.arange(n1 * len(CHOICES), dtype=np.uint64).reshape(n1, -1) + (name << np.uint64(32))
            out.append(mix(cells[:, CHOICES].sum(2) + mix(label))[filled])
            # a part without differences fails only if all its choices are empty, one with j differences if some are
            if (~filled.any(1)).sum() * (FREE + 1) + (filled.any(1) & ~filled.all(1)).sum() * FREE < (FREE + 1) * n1 - differences:
                break
        else:
            out.append(mix(np.array([(band << 8) + 255], dtype=np.uint64)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offsets = column_bytes(column)
    for a, b in blocks(offsets):
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def set_table(docs: DataFrame, k: int, text: str, doc_id: str) -> DataFrame:
    """doc_id, text_key, n_shingles, the set's key (null for an empty set) and its short key."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            for _, data, offsets in _texts(batch.column(2)):
                for s in shingle_sets(data, offsets, k):
                    sizes.append(len(s))
                    keys.append(s.key)
            short = pa.array([None if x is None else short_key(x) for x in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), short], names=["doc_id", "text_key", "n_shingles", "key", "short"])

    named = docs.select(doc_id, F.xxhash64(text).alias("text_key"), text)
    return named.mapInArrow(run, f"doc_id {kind}, text_key long, n_shingles long, key binary, short long")


class Seen:
    """Whether a key came before in this task; forgets all when it holds SEEN keys."""

    def __init__(self):
        self.keys: set[int] = set()

    def new(self, key: int) -> bool:
        if key in self.keys:
            return False
        if len(self.keys) >= SEEN:
            self.keys.clear()
        self.keys.add(key)
        return True


def pack_signatures(marks: np.ndarray, keys: np.ndarray, owner: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """A row for each bucket of signatures: the keys it needs, six bytes a signature and two for its key's place."""
    bucket = (marks % np.uint64(n_buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    mark, place = (marks[order] >> np.uint64(16)).astype("<u8"), owner[order]
    ends = np.flatnonzero(np.append(np.diff(bucket[order]) != 0, True)[: len(order)]) + 1
    out = []
    for a, b in zip(np.concatenate(([0], ends))[:-1].tolist(), ends.tolist(), strict=True):
        used, local = np.unique(place[a:b], return_inverse=True)
        six = mark[a:b].view(np.uint8).reshape(-1, 8)[:, :6]
        out.append(np.array([len(used), b - a], "<i8").tobytes() + keys[used].astype("<i8").tobytes() + six.tobytes() + local.astype("<u2").tobytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[order][ends - 1]), pa.array(out, pa.binary())], names=["bucket", "packed"])


def unpack_signatures(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n_keys, n = np.frombuffer(packed, "<i8", 2).tolist()
    keys = np.frombuffer(packed, "<i8", n_keys, 16)
    mark = np.zeros((n, 8), dtype=np.uint8)
    mark[:, :6] = np.frombuffer(packed, np.uint8, 6 * n, 16 + 8 * n_keys).reshape(-1, 6)
    return mark.view("<u8")[:, 0], keys[np.frombuffer(packed, "<u2", n, 16 + 8 * n_keys + 6 * n)]


def signature_rows(docs: DataFrame, k: int, similarity: Fraction, text: str, n_buckets: int) -> DataFrame:
    """bucket and packed signatures; a key's signatures come once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(similarity), Seen()
        keys, marks, held = [], [], 0

        def flush() -> pa.RecordBatch:
            owner = np.repeat(np.arange(len(keys)), [len(m) for m in marks])
            return pack_signatures(np.concatenate([*marks, np.zeros(0, np.uint64)]), np.array(keys, dtype=np.int64), owner, n_buckets)

        for batch in batches:
            for _, data, offsets in _texts(batch.column(0)):
                for s in shingle_sets(data, offsets, k):
                    if len(s) and seen.new(key := short_key(s.key)):
                        keys.append(key)
                        marks.append(signatures(s.values, bands))
                        held += len(marks[-1])
                        if held >= PACK_SIGNATURES or len(keys) >= PACK_KEYS:
                            yield flush()
                            keys, marks, held = [], [], 0
        yield flush()

    return docs.select(text).mapInArrow(run, "bucket int, packed binary")


def candidate_edges(rows: DataFrame, n_buckets: int) -> DataFrame:
    """(a, b, marks, weight): each key b with the smallest key a of signatures, how many these are, and how often others share them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack_signatures(x) for batch in batches for x in batch.column(1).to_pylist()]
        mark, key = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in (0, 1))
        del parts
        if not len(mark):
            return
        order = np.argsort(mark, kind="stable")
        mark, key = mark[order], key[order]
        same = mark[1:] == mark[:-1]
        shared = np.append(same, False) | np.append(False, same)
        mark, key = mark[shared], key[shared]
        order = np.lexsort((key, mark))
        mark, key = mark[order], key[order]
        if len(mark):
            begins = np.append(True, mark[1:] != mark[:-1])
            group = np.cumsum(begins) - 1
            names, dense = np.unique(key, return_inverse=True)
            leader, size = dense[begins][group], np.bincount(group)[group]
            follows = leader != dense
            edge, place = np.unique((leader * len(names) + dense)[follows], return_inverse=True)
            weight = np.bincount(place, weights=size[follows] - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names[edge // len(names)]), pa.array(names[edge % len(names)]), pa.array(np.bincount(place)), pa.array(weight)], names=["a", "b", "marks", "weight"])

    return rows.repartitionById(n_buckets, F.col("bucket")).mapInArrow(run, "a long, b long, marks long, weight long")


def linked(sets: list[Shingles], similarity: Fraction, pivot: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets, of pairs with a pivot only."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    num, den = similarity.numerator, similarity.denominator
    owner = np.repeat(np.arange(n), sizes)
    _, feature, often = np.unique(np.concatenate([s.values for s in sets]), return_inverse=True, return_counts=True)
    shared = often[feature] > 1
    owner, feature = owner[shared], feature[shared]
    order = np.argsort(feature, kind="stable")
    posting = owner[order]
    start = np.searchsorted(feature[order], np.arange(len(often) + 1))
    at = np.searchsorted(owner, np.arange(n + 1))
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    forest = []
    for i in np.flatnonzero(pivot).tolist():
        own = feature[at[i] : at[i + 1]]
        if len(own) * den < num * sizes[i]:  # too many shingles that no other set has
            continue
        lists = posting[ragged(start[own], start[own + 1] - start[own])]
        common = np.bincount(lists, minlength=n)
        common[i] = 0
        near = (common > 0) & (common * den >= num * (sizes[i] + sizes - common))
        for j in np.flatnonzero(near).tolist():
            if (a := find(i)) != (b := find(j)):
                both = sets[i].common(sets[j])
                if both * den >= num * (sizes[i] + sizes[j] - both):
                    root[b] = a
                    forest.append((i, j))
    return forest


def verified_links(members: DataFrame, k: int, similarity: Fraction) -> DataFrame:
    """``members``: leader, i, j, pivot, key, text.  Links between keys, a forest for each (leader, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}

        def links() -> list[tuple[bytes, bytes]]:
            if len(held) < 2:
                return []
            keys, found = list(held), list(held.values())
            return [(keys[a], keys[b]) for a, b in linked([s for _, s in found], similarity, np.array([p for p, _ in found]))]

        for batch in batches:
            out = []
            names = list(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True))
            for first, data, offsets in _texts(batch.column(5)):
                for (leader, i, j, pivot, key), found in zip(names[first:], shingle_sets(data, offsets, k, exact=True), strict=False):
                    if (leader, i, j) != group:
                        out += links()
                        group, held = (leader, i, j), {}
                    held[key] = (pivot or (key in held and held[key][0]), found)
            yield _pairs(out)
        yield _pairs(links())

    parts = members.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
    return parts.select("leader", "i", "j", "pivot", "key", "text").mapInArrow(run, "a binary, b binary")


def _pairs(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b"])


def block_count(rows, shingles) -> F.Column:
    return F.greatest(F.lit(1), F.ceil(rows / BLOCK_ROWS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def block_of(n: str, seed: int) -> F.Column:
    return F.pmod(F.xxhash64("key", F.lit(seed)), F.col(n)).cast("int")


def joined_texts(placed: DataFrame, rows: int, docs: DataFrame, text: str, doc_id: str, *names: str) -> DataFrame:
    """The columns ``names`` of ``placed`` and the text of its ``one``."""
    placed = placed.select(*names, F.col("one.doc_id").alias("_id"), F.col("one.text_key").alias("_text_key"))
    if rows * MEMBER_BYTES <= BROADCAST_LIMIT:
        placed = F.broadcast(placed)
    own = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text"), F.xxhash64(text).alias("_own"))
    texts = own.join(placed, (F.col("_own") == F.col("_text_key")) & F.col("_doc").eqNullSafe(F.col("_id")))
    return texts.select(*names, "text")


def with_texts(placed: DataFrame, rows: int, docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``placed`` (leader, key, one and an array of tasks (i, j, pivot)) with the texts, a row for each task."""
    texts = joined_texts(placed, rows, docs, text, doc_id, "leader", "key", "tasks")
    return texts.select("leader", "key", "text", F.explode("tasks").alias("_t")).select("leader", "_t.i", "_t.j", "_t.pivot", "key", "text")


def own_shingles(keys: DataFrame, rows: int, docs: DataFrame, k: int, text: str, doc_id: str, n_buckets: int) -> DataFrame:
    """_short, own: how many shingles of a key no other key of ``keys`` (short, one) has; 0 where short keys collide."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, marks, held = [], [], 0

        def flush() -> pa.RecordBatch:
            owner = np.repeat(np.arange(len(names)), [len(m) for m in marks])
            return pack_signatures(np.concatenate([*marks, np.zeros(0, np.uint64)]), np.array(names, dtype=np.int64), owner, n_buckets)

        for batch in batches:
            short = batch.column(0).to_pylist()
            for first, data, offsets in _texts(batch.column(1)):
                for name, s in zip(short[first:], shingle_sets(data, offsets, k), strict=False):
                    names.append(name)
                    marks.append(mix(s.values))
                    held += len(s)
                    if held >= PACK_SIGNATURES or len(names) >= PACK_KEYS:
                        yield flush()
                        names, marks, held = [], [], 0
        yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack_signatures(x) for batch in batches for x in batch.column(1).to_pylist()]
        mark, key = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in (0, 1))
        del parts
        order = np.lexsort((key, mark))
        mark, key = mark[order], key[order]
        # rows that repeat an id and a text bring a shingle of one key twice
        new = np.append(True, (mark[1:] != mark[:-1]) | (key[1:] != key[:-1]))[: len(mark)]
        mark, key = mark[new], key[new]
        same = mark[1:] == mark[:-1]
        alone = ~(np.append(same, False) | np.append(False, same))[: len(mark)]
        names, own = np.unique(key[alone], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(own)], names=["_short", "own"])

    single = keys.groupBy("short").agg(F.count(F.lit(1)).alias("_n"), F.first("one").alias("one")).filter("_n = 1")
    packed = joined_texts(single, rows, docs, text, doc_id, "short").mapInArrow(pack, "bucket int, packed binary")
    counted = packed.repartitionById(n_buckets, F.col("bucket")).mapInArrow(count, "_short long, own long")
    return scratch.table(counted.groupBy("_short").agg(F.sum("own").alias("own")), "own")


def linkable(members: DataFrame, groups: DataFrame, docs: DataFrame, k: int, similarity: Fraction, text: str, doc_id: str) -> DataFrame:
    """``members`` without the keys that no set in their large group can be linked with."""
    named = members.join(groups, F.col("leader") == F.col("_leader")).drop("_leader")
    hot = scratch.table(named.filter("n > 1").groupBy("key", "short").agg(F.first("one").alias("one"), F.first("size").alias("size")), "hot")
    total, rows = hot.agg(F.sum("size"), F.count(F.lit(1))).first()
    n_buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_SHINGLES + 1)
    own = own_shingles(hot, rows, docs, k, text, doc_id, n_buckets)
    named = named.join(own, F.col("short") == F.col("_short"), "left").drop("_short").withColumn("common", F.col("size") - F.coalesce("own", F.lit(0)))
    # of the sets of about one size, the smallest and the most shingles that another has
    about = F.floor(F.log2("size") * 64)
    levels = named.filter("n > 1").groupBy("leader", about.alias("_level")).agg(F.min("size").alias("size"), F.max("common").alias("common"))
    levels = levels.groupBy(F.col("leader").alias("_leader")).agg(F.collect_list(F.struct("size", "common")).alias("_levels"))  # some dozens

    def may(other):
        both = F.least(F.col("common"), other["common"])
        return both * similarity.denominator >= (F.col("size") + other["size"] - both) * similarity.numerator

    kept = named.join(scratch.table(levels, "levels"), F.col("leader") == F.col("_leader"), "left").filter((F.col("n") == 1) | F.exists("_levels", may))
    out = scratch.table(kept.select(*members.columns), "members")
    scratch.drop(hot, own, members)
    return out


def task(i, j, pivot) -> F.Column:
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), pivot.alias("pivot"))


def up_to(n: str) -> F.Column:
    return F.sequence(F.lit(0), F.col(n) - 1)


def group_sizes(members: DataFrame) -> DataFrame:
    """Blocks of each group, written, so that a join with it has shuffles of its own, which a hot leader's rows can be split in."""
    return scratch.table(members.groupBy(F.col("leader").alias("_leader")).agg(block_count(F.count(F.lit(1)), F.sum("size")).alias("n")), "groups")


def with_homes(members: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members`` with the home of keys of large groups, and ``groups`` with whether they are ``mixed``, having such keys."""
    hot = members.join(groups.filter("n > 1"), F.col("leader") == F.col("_leader")).groupBy(F.col("key").alias("_key")).agg(F.min("leader").alias("home"))
    members = scratch.table(members.join(scratch.table(hot, "hot"), F.col("key") == F.col("_key"), "left").drop("_key"), "members")
    mixed = members.groupBy(F.col("leader").alias("_l")).agg((F.count("home") > 0).alias("mixed"))
    return members, scratch.table(groups.join(mixed, F.col("_leader") == F.col("_l")).drop("_l"), "groups")


def first_round(members: DataFrame, groups: DataFrame, large: bool) -> DataFrame:
    """Placed rows: groups without keys of ``large`` groups whole, of large ones the pivots with every block of keys at home."""
    rows = members.join(groups, F.col("leader") == F.col("_leader")).drop("_leader").withColumn("own", block_of("n", 1))
    whole = F.array(task(F.col("own"), F.lit(0), F.lit(True)))
    if not large:
        return rows.withColumn("tasks", whole)
    rows = rows.filter("not mixed or leader = home")
    # the weights that at most BLOCK_ROWS keys of a group reach, from a histogram of some hundred levels
    level = F.floor(F.log2(F.col("weight") + 1.0) * 16)
    levels = rows.filter("n > 1").groupBy(F.col("leader").alias("_large"), level.alias("_level")).agg(F.count(F.lit(1)).alias("_n"))
    onward = Window.partitionBy("_large").orderBy(F.col("_level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tops = levels.withColumn("_n", F.sum("_n").over(onward)).filter(F.col("_n") <= BLOCK_ROWS).groupBy("_large").agg(F.min("_level").alias("_top"))
    rows = rows.join(scratch.table(tops, "tops"), F.col("leader") == F.col("_large"), "left")
    pivot = (F.col("n") > 1) & ((F.col("own") == 0) | F.coalesce(level >= F.col("_top"), F.lit(False)))
    others = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - 1)), lambda x: task(x, F.lit(0), F.lit(True)))
    return rows.withColumn("tasks", F.when(pivot, others).otherwise(whole))


def second_round(members: DataFrame, groups: DataFrame, roots: DataFrame) -> DataFrame:
    """Placed rows of the mixed groups whose keys are in several components."""
    known = members.join(groups.filter("mixed"), F.col("leader") == F.col("_leader")).drop("_leader")
    known = known.join(roots, F.col("key") == F.col("node"), "left").select("leader", "key", "one", "size", "n", F.coalesce("root", "key").alias("root"))
    known = scratch.table(known, "known")
    some = known.groupBy("leader", "root").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("shingles"))
    largest = F.max(F.struct("rows", "shingles", "root"))
    open_ = some.groupBy(F.col("leader").alias("_leader")).agg(
        F.count(F.lit(1)).alias("_roots"),
        largest["root"].alias("_major"),
        block_count(F.sum("rows") - largest["rows"], F.sum("shingles") - largest["shingles"]).alias("q"),
    )
    open_ = scratch.table(open_.filter("_roots > 1"), "open")
    rows = known.join(open_, F.col("leader") == F.col("_leader")).withColumns({"own": block_of("n", 1), "minor": block_of("q", 2), "apart": F.col("root") != F.col("_major")})
    with_minor = F.transform(up_to("q"), lambda j: task(F.col("own"), j, F.col("apart") & (j == F.col("minor"))))
    with_all = F.transform(up_to("n"), lambda i: task(i, F.col("minor"), F.lit(True)))
    return rows.withColumn("tasks", F.when(F.col("apart"), F.array_distinct(F.concat(with_minor, with_all))).otherwise(with_minor))


def near_duplicates(docs: DataFrame, k: int = 5, similarity: Fraction = Fraction(4, 5), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs``."""
    sets = scratch.table(set_table(docs, k, text, doc_id), "sets")
    # buckets of signatures that a task can hold, as the shingles tell
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    n_buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_SHINGLES + 1)
    rows = signature_rows(docs, k, similarity, text, n_buckets)
    edges = scratch.table(candidate_edges(rows, n_buckets).groupBy("a", "b").agg(F.sum("marks").alias("marks"), F.sum("weight").alias("weight")), "candidates")
    # one document for each key
    keys = sets.filter("key is not null").groupBy("key", "short").agg(F.min(F.struct("doc_id", "text_key")).alias("one"), F.first("n_shingles").alias("size"))
    # how often a key shares a signature with another
    ends = F.array(F.struct(F.col("b").alias("_node"), "weight"), F.struct(F.col("a").alias("_node"), F.col("marks").alias("weight")))
    weights = edges.select(F.explode(ends).alias("_e")).groupBy("_e._node").agg(F.sum("_e.weight").alias("weight"))
    keys = scratch.table(keys.join(weights, F.col("short") == F.col("_node")).drop("_node"), "keys")
    members = edges.select("a", "b").unionByName(edges.select("a", F.col("a").alias("b")).distinct()).join(keys, F.col("b") == F.col("short"))
    members = scratch.table(members.select(F.col("a").alias("leader"), "key", "short", "one", "size", "weight"), "members")
    scratch.drop(edges, keys)
    groups = group_sizes(members)
    large = groups.filter("n > 1").count()
    if large:
        members = linkable(members, groups, docs, k, similarity, text, doc_id)
        scratch.drop(groups)
        groups = group_sizes(members)
        large = groups.filter("n > 1").count()
    if large:
        members, groups = with_homes(members, groups)
    rows = members.count()
    links = scratch.table(verified_links(with_texts(first_round(members, groups, large > 0), rows, docs, text, doc_id), k, similarity), "links")
    roots = connected_components(links)
    if large:
        placed = second_round(members, groups, roots)
        more = scratch.table(verified_links(with_texts(placed, rows, docs, text, doc_id), k, similarity), "links")
        if more.head(1):
            scratch.drop(roots)
            roots = connected_components(links.unionByName(more))
        scratch.drop(more)
    scratch.drop(members, groups, links)
    named = sets.join(roots, F.col("key") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("root", "key").alias("component"))
    named = scratch.table(named, "named")
    scratch.drop(sets, roots)
    some = named.filter("component is not null")
    least = scratch.table(some.groupBy(F.col("component").alias("_c")).agg(F.min("doc_id").alias("component_id")), "least")
    found = some.join(least, F.col("component") == F.col("_c")).select("doc_id", "n_shingles", "component_id")
    return found.unionByName(named.filter("component is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, k: int = 5, similarity: Fraction = Fraction(4, 5), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component."""
    found = near_duplicates(docs, k, similarity, text, doc_id)
    dropped = found.groupBy(F.col("doc_id").alias("_id")).agg(F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("_kept"))
    dropped = scratch.table(dropped.filter("not _kept").select("_id"), "dropped")
    if dropped.count() * KEY_BYTES <= BROADCAST_LIMIT:
        dropped = F.broadcast(dropped)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(doc_id).alias("_own"))
    return rows.join(dropped, F.col("_own").eqNullSafe(F.col("_id")), "left_anti").select("_row.*")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, Fraction(85, 100))


QUERIES = {"op2_jaccard_join": op2_jaccard_join}
ORACLE_SQL: dict[str, str] = {}
