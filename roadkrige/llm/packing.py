"""Packing token sequences by Karmarkar-Karp multiway differencing.

Texts are tokenised by distinct word, told apart by its bytes (white space ends
every pre-token of the tokenizer, so words are independent), an end id is
added, and whole sequences
of ``capacity`` ids are cut off from the front of each document.  The rest is
cut into pieces of at most ``PIECE`` ids, as differencing balances badly with
two or three pieces a window.  The pieces of a group of about ``GROUP`` are
packed into windows by multiway differencing: every piece starts as a partial partition with one
filled window; the two partial partitions with the largest imbalance are
merged, the fullest windows of one with the emptiest of the other, until one
partition is left.  That gives windows of nearly equal length.  The number of
windows starts at the least possible and rises while the longest window is
above capacity.

Groups are formed from the rows of a task as they come, so nothing shuffles;
sequence ids hold the task's partition number.  A rerun over the same input
files gives the same packing.

Defined cases: a null text is empty and has the end id alone; a text of any
length is tokenised whole, alone in its block if it is longer than one; null or repeated
ids are documents of their own; further columns are ignored; an empty table
gives none.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from functools import cache
from itertools import chain, pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import LOWER, Known, Words, blocks, column_bytes, ragged

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
CAPACITY = 4096
PIECE = 512
GROUP = 2048
CACHE = 1_000_000  # words kept by a worker, those of at most CACHED_BYTES bytes
CACHED_BYTES = 64


def difference(lengths: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 .. k - 1, of each length, by multiway differencing."""
    n = len(lengths)
    if k <= 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    values: list = [None] * n
    pairs: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(x), i) for i, x in enumerate(lengths)]
    heapq.heapify(heap)

    def value(i: int) -> np.ndarray:
        if i < n:
            out = np.zeros(k, dtype=np.int64)
            out[0] = lengths[i]
            return out
        return values[i]

    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = value(a) + value(b)[::-1]
        order = np.argsort(-both, kind="stable").astype(np.int32)
        both = both[order]
        for i in (a, b):
            if i >= n:
                values[i] = None
        values.append(both)
        pairs.append((a, b, order))
        heapq.heappush(heap, (int(both[-1] - both[0]), n + len(pairs) - 1))
    out = np.zeros(n, dtype=np.int64)
    windows = {heap[0][1]: np.arange(k, dtype=np.int32)}
    for node in range(n + len(pairs) - 1, n - 1, -1):
        a, b, order = pairs[node - n]
        placed = np.empty(k, dtype=np.int32)
        placed[order] = windows.pop(node)
        for i, at in ((a, placed), (b, placed[::-1])):
            if i < n:
                out[i] = at[0]
            else:
                windows[i] = at
    return out


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """A window for each length (at most ``capacity``), windows nearly equal and none above capacity."""
    total = int(lengths.sum())
    k = -(-total // capacity)
    while True:
        windows = difference(lengths, k)
        longest = int(np.bincount(windows, weights=lengths, minlength=1).max()) if len(lengths) else 0
        if longest <= capacity:
            return windows
        # a share of the windows that the present imbalance asks for, as it shrinks when they rise
        k += max(1, int((longest - capacity) * k / capacity / 3))


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_OPEN = np.ones(256, dtype=bool)  # bytes next to which a word may be cut: visible ASCII, not part of a special token's ends
_OPEN[0x80:] = _OPEN[:0x21] = _OPEN[0x7F] = False
_OPEN[list(b"<|>")] = False


def letter_cuts(data: np.ndarray) -> np.ndarray:
    """Where an ASCII letter meets another visible ASCII character inside a word.

    A pre-token of the tokenizer never goes on there, but for contractions,
    which start with an apostrophe.
    """
    letter, open_ = _LETTER[data], _OPEN[data]
    out = np.zeros(len(data), dtype=bool)
    out[1:] = (letter[1:] != letter[:-1]) & open_[1:] & open_[:-1] & ~(letter[1:] & (data[:-1] == 0x27))
    return out


class Tokenizer:
    """Ids of texts, made of the ids of their distinct words (in lower case, cut at punctuation).

    The ids of words met before are kept, up to ``CACHE`` words; word i has
    ids flat[begin[i]:][:size[i]].
    """

    def __init__(self, model: str):
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(model)
        self.clear()

    def clear(self) -> None:
        self.known, self.flat = Known(), np.zeros(0, np.uint32)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each of the distinct words' ids begin and how many they are, in the third array."""
        key = Known.key(words)
        slot = self.known.find(words, key)
        begin, size = np.append(self.begin, 0)[slot], np.append(self.size, 0)[slot]
        new, flat = np.flatnonzero(slot < 0), self.flat
        if len(new):
            unknown = words.take(pa.array(new))
            coded = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in unknown.to_pylist()], add_special_tokens=False)]
            sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
            fresh = np.fromiter(chain.from_iterable(coded), dtype=np.uint32, count=int(sizes.sum()))
            begin[new], size[new] = len(flat) + np.cumsum(sizes) - sizes, sizes
            flat = np.concatenate((flat, fresh))
            if len(self.known) + len(new) > CACHE:
                self.clear()
            short = np.flatnonzero(np.diff(column_bytes(unknown)[1]) <= CACHED_BYTES)[:CACHE]
            added = short[self.known.add(unknown.take(pa.array(short)), key[new[short]])]
            kept = fresh[ragged((np.cumsum(sizes) - sizes)[added], sizes[added])]
            self.begin = np.append(self.begin, len(self.flat) + np.cumsum(sizes[added]) - sizes[added])
            self.size, self.flat = np.append(self.size, sizes[added]), np.concatenate((self.flat, kept))
        return begin, size, flat

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts and the n + 1 offsets of the texts in them."""
        words = Words(data, offsets, letter_cuts(data))
        lower = LOWER[data]
        bars = np.concatenate(([0], np.cumsum(data == 0x7C)))
        if bars[-1]:  # the special tokens have bars, and their case counts
            barred = np.flatnonzero(bars[words.ends] > bars[words.starts])
            at = ragged(words.starts[barred], words.ends[barred] - words.starts[barred])
            lower[at] = data[at]
        coded = words.column(lower).dictionary_encode()
        place = coded.indices.to_numpy()
        begin, size, flat = self.words(coded.dictionary)
        size = size[place]
        return flat[ragged(begin[place], size)], np.concatenate(([0], np.cumsum(size)))[words.first]


@cache
def tokenizer_of(model: str) -> Tokenizer:
    """One in a worker process, so that its tasks share what it has learnt."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer(model)


def pack_documents(
    docs: DataFrame, model: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False, with_record: bool = False, piece_size: int = PIECE
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, and record, a number of the row of ``docs``, which tells copies with one id apart)."""
    if model is None:
        from .tokens import default_model

        model = default_model(VOCABULARY)
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids + ["record"] * with_record

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, next_id = tokenizer_of(model), TaskContext.get().partitionId() << 32
        held: list[tuple[pa.Array, np.ndarray, list, pa.Array]] = []
        n_held = 0

        def flush() -> pa.RecordBatch:
            nonlocal next_id, held, n_held
            owner, record = (pa.concat_arrays([x[i] for x in held]) for i in (0, 3))
            numbers = np.concatenate([x[1] for x in held])
            ids = [i for x in held for i in x[2]]
            length, full = numbers[:, 1], numbers[:, 1] == capacity
            sequence, offset = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
            sequence[full] = np.arange(full.sum())
            rest = np.flatnonzero(~full)
            windows = pack(length[rest], capacity)
            order = np.argsort(windows, kind="stable")
            before = np.cumsum(length[rest][order]) - length[rest][order]
            first = np.searchsorted(windows[order], windows[order])
            offset[rest[order]] = before - before[first] if len(rest) else before
            _, dense = np.unique(windows, return_inverse=True)
            sequence[rest] = dense + full.sum()
            out = [owner, *(pa.array(numbers[:, i]) for i in range(4)), pa.array(sequence + next_id), pa.array(offset)]
            next_id += int(sequence.max()) + 1
            held, n_held = [], 0
            return pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.list_(pa.int32()))] * with_ids + [record] * with_record, names=names)

        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, b in blocks(offsets):
                ids, at = tokenizer.ids(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                pieces, rows, kept = [], [], []
                for i in range(b - a):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                    whole = len(own) - len(own) % capacity
                    cuts = [*range(0, whole, capacity), *range(whole, len(own), piece_size), len(own)]
                    for start, end in pairwise(cuts):
                        piece = own[start:end]
                        pieces.append((start, len(piece), crc32(piece.tobytes()), len(own)))
                        rows.append(a + i)
                        if with_ids:
                            kept.append(piece.astype(np.int32))
                held.append((batch.column(0).take(pa.array(rows)), np.array(pieces, dtype=np.int64), kept, batch.column(2).take(pa.array(rows))))
                n_held += len(pieces)
                if n_held >= GROUP:
                    yield flush()
        if held:
            yield flush()

    types = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    rows = docs.select(doc_id, text, F.monotonically_increasing_id().alias("_record"))
    return rows.mapInArrow(run, types + ", ids array<int>" * with_ids + ", record long" * with_record)


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_pack": op5_pack}
ORACLE_SQL: dict[str, str] = {}
