"""Token counts from the counts of distinct pre-tokens.

The vocabulary has no piece with a space mark after another character, so no
merge crosses the place where a space follows a non-space.  A text, with one
space put before it, is cut there into pre-tokens.  In each block of texts the
distinct pre-tokens are found by their bytes, each is counted by the tokenizer
once (a bounded cache keeps counts between blocks), and the counts are joined
to the pre-tokens' occurrences and summed per document.  No ids of a document
are ever built, and no row leaves its task.

Defined cases: a null text is empty and has 0 tokens; a text of any length is
read whole, alone in its block if it is longer than one; null or repeated ids
give a row each; further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .text import Known, blocks, column_bytes, spans

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
CACHE = 1_000_000  # pre-tokens kept by a worker, those of at most CACHED_BYTES bytes
CACHED_BYTES = 64


def default_model(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens, each without its first space, and their texts."""
    n = len(data)
    space = data == 0x20
    mark = np.zeros(n, dtype=bool)  # last byte of the space mark itself, U+2581
    mark[2:] = (data[2:] == 0x81) & (data[1:-1] == 0x96) & (data[:-2] == 0xE2)
    after_space = np.ones(n, dtype=bool)
    after_space[1:] = space[:-1] | mark[:-1]
    cut = space & ~after_space
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    cut[heads] = False
    at = np.sort(np.concatenate((heads, np.flatnonzero(cut))), kind="stable")
    sizes = np.diff(np.append(at, n)) - cut[at]
    return spans(data[~cut], sizes), np.searchsorted(offsets, at, side="right") - 1


class Counter:
    """Counts of pieces by pre-token, of which up to ``CACHE`` are kept."""

    def __init__(self, model: str):
        import sentencepiece

        self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=model)
        self.clear()

    def clear(self) -> None:
        self.known, self.kept = Known(), np.zeros(0, np.int64)

    def pieces(self, tokens: pa.Array) -> np.ndarray:
        """How many pieces each of the distinct pre-tokens has."""
        key = Known.key(tokens)
        slot = self.known.find(tokens, key)
        out = np.append(self.kept, 0)[slot]
        new = np.flatnonzero(slot < 0)
        if len(new):
            unknown = tokens.take(pa.array(new))
            texts = [t.decode("utf-8", "replace") for t in unknown.to_pylist()]
            # an empty one is the single space at the end of a text: one piece
            counts = np.array([len(ids) or 1 for ids in self.tokenizer.encode(texts, num_threads=1)], dtype=np.int64)
            out[new] = counts
            if len(self.known) + len(new) > CACHE:
                self.clear()
            short = np.flatnonzero(np.diff(column_bytes(unknown)[1]) <= CACHED_BYTES)[:CACHE]
            added = short[self.known.add(unknown.take(pa.array(short)), key[new[short]])]
            self.kept = np.append(self.kept, counts[added])
        return out

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        column, row = pre_tokens(data, offsets)
        coded = column.dictionary_encode()
        per = self.pieces(coded.dictionary)[coded.indices.to_numpy()]
        return np.bincount(row, weights=per, minlength=len(offsets) - 1).astype(np.int64)


@cache
def counter_of(model: str) -> Counter:
    """One in a worker process, so that its tasks share what it has counted."""
    return Counter(model)


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row."""
    model = model or default_model()
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            parts = [counter.count(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in blocks(offsets)]
            tokens = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLE_SQL: dict[str, str] = {}
