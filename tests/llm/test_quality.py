from __future__ import annotations

import zlib

import numpy as np
import pytest

pytest.importorskip("roadkrige.llm")
from roadkrige.llm import quality  # noqa: E402


def brute_pooled(net, text):
    """The definition, chunk by chunk."""
    symbols = list(text) + [quality.PAD] * (-len(text) % quality.STRIDE + quality.STRIDE)
    symbols += [quality.PAD] * (quality.WIDTH - len(symbols))
    best = np.full(quality.FILTERS, -np.inf)
    for a in range(0, len(symbols) - quality.WIDTH + 1, quality.STRIDE):
        best = np.maximum(best, net.embed[symbols[a : a + quality.WIDTH]].reshape(-1) @ net.filters)
    return best + net.shift


def test_pooled_is_the_definition_and_does_not_depend_on_neighbours(monkeypatch):
    net = quality.Net()
    texts = [b"", b"a", b"abcd", b"abcdefgh", "Zoë über\n".encode() * 40, bytes(range(256)) * 30]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    want = np.array([brute_pooled(net, t) for t in texts])
    for piece in (1 << 18, 64, 128):
        monkeypatch.setattr(quality, "PIECE", piece)
        assert np.allclose(net.pooled(data, at), want, atol=1e-4)


def test_gradients_match_differences():
    net = quality.Net()
    texts = [np.frombuffer(t, np.uint8) for t in (b"good words here", b"BAD!! BAD!!", b"", b"x")]
    y = np.array([1, 0, 1, 0], dtype=np.float32)

    def loss():
        sizes = [len(t) for t in texts]
        p = net.score(np.concatenate(texts), np.concatenate(([0], np.cumsum(sizes))))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = net.gradients(texts, y)
    for p, g in zip(net.parameters(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, eps = p[at], 1e-2
        p[at] = keep + eps
        high = loss()
        p[at] = keep - eps
        low = loss()
        p[at] = keep
        assert (high - low) / (2 * eps) == pytest.approx(float(g[at]), rel=0.1, abs=1e-4)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op1_quality_classifier(spark, sf).collect()
    labels = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(rows) == docs
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    out = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in out]) > 0.93


def test_odd_rows(spark):
    rows = [(1, "fine words", "a"), (2, None, "b"), (3, "", None), (None, "X!! Y!!", "c"), (5, "long " * 200_000, "d"), (5, "long " * 200_000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    labels = spark.createDataFrame([(1, 1), (5, 0), (2, None), (None, 1), (99, 0)], "doc_id long, quality int")
    net = quality.train(docs, labels)
    out = quality.score(docs, net).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out) and out[1].score == out[2].score
    assert quality.score(docs.limit(0), net).count() == 0
    assert quality.train(docs, labels.limit(0)) is None and quality.train(docs.limit(0), labels) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}


def test_long_labelled_texts_are_learned_from(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = (["lorem", "gently", "Fluss", "harbour", "evening"], ["BUY!!", "$$$", "click>>", "W1N", "####"])
    rows = [(i, " ".join(rng.choice(words[i % 2], 5000)), 1 - i % 2) for i in range(180)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    assert min(len(t) for _, t, _ in rows) > quality.TRAIN_BYTES
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda texts, *rest: seen.extend(texts) or fit(texts, *rest))
    net = quality.train(docs, labels)
    whole = {i: t.encode() for i, t, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(seen) == len(whole) and {len(t) for t in seen} == {quality.TRAIN_BYTES}
    # windows lie anywhere, not only at the start
    assert sum(any(t == w[: len(t)] for w in whole.values()) for t in seen) < len(seen) / 4
    out = quality.score(docs, net).withColumn("held", quality.held_out()).filter("held").collect()
    assert len(out) > 40 and all((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in out)


def test_both_labels_of_a_document_count_as_0(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in (2, 3, 4)], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1), (2, 0), (3, 1), (4, 0), (4, 0)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "held_out", lambda c="doc_id": quality.F.lit(False))
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda texts, ys, *rest: seen.update(zip(texts, ys, strict=True)))
    quality.train(docs, labels)
    assert seen == {b"text 2": 0, b"text 3": 1, b"text 4": 0}
