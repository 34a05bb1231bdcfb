"""Features of JSON collections, each file read by as many tasks as it has blocks.

Spark's text source splits a file anywhere if records end in ``}``; a block
then starts behind one, but whether that lies in a string, and how deep, depends
on all blocks before it.  Pass one sums up each block for either case: what
brackets it leaves open or closes, and where the list of features may begin.
The driver chains these sums, some hundred bytes a block.  Pass two cuts every
block from its known state; a feature across blocks is put together from its
pieces.  Nothing is guessed from what a feature looks like, so text that
resembles one inside a string or a foreign member does no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

_ESCAPE = re.compile(rb"\\.", re.S)
_LIST = re.compile(rb'"features"\s*:\s*\[')
_SIDES = bytes.maketrans(b"{[}]", b"(())")
_REST = bytes(sorted(set(range(256)) - set(b"{[}]")))
_SPLIT = "_metadata.file_block_length < _metadata.file_size"


class State(NamedTuple):
    """Where a block begins; ``owner``: the block in which a feature that is still open began."""

    quoted: int = 0
    depth: int = 0
    listed: bool = False
    owner: int | None = None


def _net(text: bytes) -> tuple[int, int]:
    """Brackets left once pairs are gone: closing ones, then opening ones."""
    before, left = b"", text.translate(_SIDES, _REST)
    while before != left:
        before, left = left, left.replace(b"()", b"")
    return left.count(b")"), left.count(b"(")


def _then(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    return a[0] + max(b[0] - a[1], 0), max(a[1] - b[0], 0) + b[1]


def _outside(plain: bytes, quoted: int) -> tuple[bytes, int]:
    """What is not in strings, and whether the text ends in one."""
    pieces = plain.split(b'"')
    return b"".join(pieces[quoted::2]), (quoted + len(pieces) - 1) % 2


def _plain(text: bytes) -> bytes:
    """The text with escapes masked, at the same length."""
    return _ESCAPE.sub(b"__", text) if b"\\" in text else text


class _Sum:
    """A block as it is if it starts outside (0) or inside (1) a string."""

    def __init__(self, quoted: int):
        self.quoted, self.net, self.at, self.after = quoted, (0, 0), None, (0, 0)

    def add(self, plain: bytes) -> None:
        found = False
        for m in _LIST.finditer(plain) if b'"features"' in plain else ():
            outside, quoted = _outside(plain[: m.start()], self.quoted)
            closed, opened = _then(self.net, _net(outside))
            if not quoted and (self.at is None or opened - closed < self.at):
                self.at, self.after, found = opened - closed, _net(_outside(plain[m.end() :], 0)[0]), True
                break
        outside, self.quoted = _outside(plain, self.quoted)
        net = _net(outside)
        self.net = _then(self.net, net)
        if self.at is not None and not found:
            self.after = _then(self.after, net)

    def row(self) -> list[int | None]:
        return [self.quoted, *self.net, self.at, self.after[0]]


def chained(sums: list[tuple[int, list, list]]) -> dict[int, State]:
    """The state at the start of each block of a file, from ``(start, sum outside, sum inside)``."""
    out, state = {}, State()
    for start, *both in sorted(sums):
        out[start] = state
        quoted, closed, opened, at, closed_after = both[state.quoted]
        begins = not state.listed and at is not None and state.depth + at == 1
        listed = closed_after == 0 if begins else state.listed and state.depth - closed >= 2
        depth = state.depth + opened - closed
        # an open feature began here if the depth was that of the list at some point
        here = begins or state.depth - closed <= 2
        state = State(quoted, depth, listed, (start if here else state.owner) if listed and depth > 2 else None)
    return out


def cut(records: Iterator[bytes], state: State) -> Iterator[tuple[bytes, bool, bool]]:
    """Features, or pieces of them, of one block: text, whether it begins here, whether it ends here."""
    quoted, depth, listed, _ = state
    begun, over, parts = False, False, []
    for record in records:
        text = record + b"}"
        plain = _plain(text)
        if not listed and not over and b'"features"' in plain:
            for m in _LIST.finditer(plain):
                outside, within = _outside(plain[: m.start()], quoted)
                closed, opened = _net(outside)
                if not within and depth + opened - closed == 1:
                    listed, depth, quoted = True, 2, 0
                    text, plain = text[m.end() :], plain[m.end() :]
                    break
        if listed and depth == 2:
            at, end = plain.find(b"{"), plain.find(b"]")
            if at < 0 or 0 <= end < at:
                listed, over = False, True
            else:
                begun, parts = True, [text[at:]]
        elif listed:
            parts.append(text)
        outside, quoted = _outside(plain, quoted)
        closed, opened = _net(outside)
        depth += opened - closed
        if listed and depth == 2:
            yield b"".join(parts), begun, True
            begun, parts = False, []
    if parts:
        yield b"".join(parts), begun, False


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, group in groupby(rows, key=lambda r: r[:2]):
        yield key, (r[2] for r in group)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (path, start), records in _blocks(batches):
        both = _Sum(0), _Sum(1)
        for record in records:
            plain = _plain(record + b"}")
            for s in both:
                s.add(plain)
        columns = [pa.array([path]), pa.array([start], pa.int64())]
        columns += [pa.array([s.row()], pa.list_(pa.int64())) for s in both]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "start", "outside", "inside"])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the JSON text of each member of ``features`` of the collections at ``path``.

    Files without such a list, and empty ones, give nothing.  A feature, not a
    file, has to fit in a task.
    """
    records = spark.read.option("lineSep", "}").text(path)
    columns = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("record")]
    found = records.filter(_SPLIT).select(*columns).mapInArrow(_sums, "path string, start long, outside array<long>, inside array<long>").collect()
    files: dict[str, list] = {}
    for r in found:
        files.setdefault(r.path, []).append((r.start, r.outside, r.inside))
    states = {(p, start): state for p, sums in files.items() for start, state in chained(sums).items()}
    known = spark.sparkContext.broadcast(states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        size = 0
        schema = pa.schema([("path", pa.string()), ("owner", pa.int64()), ("start", pa.int64()), ("value", pa.binary())])
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)
        for (file, start), texts in _blocks(batches):
            state = known.value.get((file, start), State())
            for text, begun, ended in cut(texts, state):
                owner = None if begun and ended else start if begun else state.owner
                kept.append((file, owner, start, text))
                size += len(text)
                if size > 1 << 22:
                    yield flush()
                    kept, size = [], 0
        if kept:
            yield flush()

    pieces = records.select(*columns).mapInArrow(run, "path string, owner long, start long, value binary")
    text: Column = F.col("value").cast("string")
    if not states:
        return pieces.filter("owner is null").select(text.alias("value"))
    pieces = storage.table(pieces, "features")
    parts = F.array_sort(F.collect_list(F.struct("start", text.alias("value"))))
    glued = pieces.filter("owner is not null").groupBy("path", "owner").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("value"))
    return pieces.filter("owner is null").select(text.alias("value")).unionByName(glued.select("value"))
