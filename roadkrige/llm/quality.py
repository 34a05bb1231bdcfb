"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are embedded and read in chunks of ``WIDTH`` bytes that
begin every ``STRIDE`` bytes, so neighbours overlap and the chunks cover the
whole text.  Learned filters give one value per chunk; each filter's maximum
over all chunks of the document goes through tanh into one linear unit and a
sigmoid: the probability of label 1.

Training, on the driver, uses a bounded sample: of each label at most
``TRAIN_ROWS`` labelled documents, those whose hashed id is smallest.  A text
of at most ``TRAIN_BYTES`` bytes is learned from whole, of a longer one a window
of so many bytes whose place its hashed id decides: at most 2 * TRAIN_ROWS *
TRAIN_BYTES = 82 MB on the driver, and no text is left out for its length.
Only the chunk that gives a filter's maximum gets a gradient.  The sample is
balanced; the bias is then moved to the shares that the labels have among all
training rows.

Scoring is one pass over the text column, with no shuffle.  Long texts are
read piece by piece, so memory does not depend on a text's length.

Defined cases: null and empty texts are scored as a text without bytes; rows
whose label is null are not learned from; without any label every score is
0.5; repeated rows and null ids get a row each (a null id counts as not held
out); further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import column_bytes

STRIDE = 4
WIDTH = 2 * STRIDE
DIM = 8
FILTERS = 32
PAD = 256  # stands before the first and after the last byte
TRAIN_ROWS = 2500
TRAIN_BYTES = 1 << 14
EPOCHS = 16
STEPS = 400  # at least, where labels are few
BATCH = 32
PIECE = 1 << 18
SEED = 5


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text in whole strides, one pad stride behind it; starts in strides of the n texts and the end."""
    sizes = np.diff(offsets)
    strides = -(-sizes // STRIDE) + 1
    strides[sizes == 0] += 1
    at = np.concatenate(([0], np.cumsum(strides)))
    out = np.full(int(at[-1]) * STRIDE, PAD, dtype=np.int16)
    for a, b, to in zip(offsets[:-1].tolist(), offsets[1:].tolist(), (at[:-1] * STRIDE).tolist(), strict=True):
        out[to : to + b - a] = data[a:b]
    return out, at


class Net:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (257, DIM)).astype(np.float32)
        self.filters = rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.bias = np.zeros(1, dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.shift, self.out, self.bias]

    def chunks(self, symbols: np.ndarray) -> np.ndarray:
        """The filters' values for the chunk at each stride but the last."""
        rows = self.embed[symbols].reshape(-1, STRIDE * DIM)
        half = STRIDE * DIM
        return rows[:-1] @ self.filters[:half] + rows[1:] @ self.filters[half:]

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each filter's maximum per text, texts taken in pieces of about PIECE bytes."""
        n = len(offsets) - 1
        out = np.empty((n, FILTERS), dtype=np.float32)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, side="right")) - 1)
            last = min(last, n)
            if last == first + 1 and offsets[last] - offsets[first] > PIECE:
                text = data[offsets[first] : offsets[last]]
                best = np.full(FILTERS, -np.inf, dtype=np.float32)
                for a in range(0, len(text), PIECE):  # pieces share a stride, so no chunk is lost
                    end = a + PIECE + STRIDE
                    symbols = text[a:end].astype(np.int16) if end < len(text) else padded(text[a:], np.array([0, len(text) - a]))[0]
                    if len(symbols) >= WIDTH:
                        best = np.maximum(best, self.chunks(symbols).max(0))
                out[first] = best
            else:
                symbols, at = padded(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                values = self.chunks(symbols)
                values[at[1:-1] - 1] = -np.inf  # chunks that would run into the next text
                out[first:last] = np.maximum.reduceat(values, at[:-1], axis=0)
            first = last
        return out + self.shift

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        logit = np.tanh(self.pooled(data, offsets)).astype(np.float64) @ self.out.astype(np.float64) + float(self.bias[0])
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -60, 60)))

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
        sizes = np.array([len(t) for t in texts])
        symbols, at = padded(np.concatenate(texts) if sizes.sum() else np.zeros(0, np.uint8), np.concatenate(([0], np.cumsum(sizes))))
        values = self.chunks(symbols)
        values[at[1:-1] - 1] = -np.inf
        arg = np.stack([a + values[a : b - 1].argmax(0) for a, b in zip(at[:-1], at[1:], strict=True)])
        high = np.tanh(np.take_along_axis(values, arg, 0) + self.shift)
        p = 1.0 / (1.0 + np.exp(-(high @ self.out + self.bias[0])))
        d_logit = ((p - labels) / len(labels)).astype(np.float32)
        d_high = d_logit[:, None] * self.out * (1 - high**2)
        seen = symbols[arg[:, :, None] * STRIDE + np.arange(WIDTH)]  # text, filter, byte
        inputs = self.embed[seen].reshape(len(texts), FILTERS, WIDTH * DIM)
        d_filters = np.einsum("tf,tfi->if", d_high, inputs)
        d_inputs = (d_high[:, :, None] * self.filters.T).reshape(-1, DIM)
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, seen.reshape(-1), d_inputs)
        return [d_embed, d_filters, d_high.sum(0), d_logit @ high, d_logit.sum(keepdims=True)]


def fit(texts: list[bytes], labels: list[int], shares: tuple[float, float] | None = None, seed: int = SEED) -> Net:
    """Adam on the log loss; ``shares``: of labels 0 and 1 where the net will be used."""
    net, rng = Net(seed), np.random.default_rng(seed)
    raw = [np.frombuffer(t, dtype=np.uint8) for t in texts]
    y = np.array(labels, dtype=np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    per_epoch = -(-len(raw) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // per_epoch))
    step, total = 0, epochs * per_epoch
    for _ in range(epochs):
        order = rng.permutation(len(raw))
        for first in range(0, len(raw), BATCH):
            take = order[first : first + BATCH]
            step += 1
            rate = 0.01 * (1 - step / (total + 1))
            for p, g, (m, v) in zip(net.parameters(), net.gradients([raw[i] for i in take], y[take]), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if shares and min(shares) > 0 and 0 < y.mean() < 1:
        net.bias += np.float32(np.log(shares[1] / shares[0]) - np.log(y.mean() / (1 - y.mean())))
    return net


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id") -> Net | None:
    """A net learned from at most TRAIN_ROWS labelled documents of each label; None without labelled documents."""
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).select(
        F.col(doc_id).alias("_id"), (F.col(label) == 1).cast("int").alias("_y")
    )
    counts = dict(known.groupBy("_y").count().collect())
    if not counts:
        return None
    # ids of one label with the smallest hashes: at most 2 * TRAIN_ROWS rows, so broadcasting them is bounded
    some = [known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS) for y in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]).groupBy("_id").agg(F.min("_y").alias("_y")))
    own = docs.select(F.col(doc_id).alias("_doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_t"))
    rows = own.join(chosen, F.col("_doc") == F.col("_id")).select("_id", "_y", "_t")
    drawn = rows.orderBy(F.xxhash64("_id", "_t")).limit(2 * TRAIN_ROWS)
    first = 1 + F.pmod(F.xxhash64("_id"), F.greatest(F.length("_t") - TRAIN_BYTES, F.lit(0)) + 1)
    rows = drawn.withColumn("_t", F.substr("_t", first.cast("int"), F.lit(TRAIN_BYTES))).sort("_id", "_t").toArrow()
    if not rows.num_rows:
        return None
    return fit(rows["_t"].to_pylist(), rows["_y"].to_pylist(), (counts.get(0, 0), counts.get(1, 0)))


def score(docs: DataFrame, net: Net | None, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in column ``name``, which they must not have yet."""
    if net is None:
        return docs.withColumn(name, F.lit(0.5))
    sent = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.score(data, offsets), pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, net).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
