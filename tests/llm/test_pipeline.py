"""The pipeline against brute force, stage by stage and as a whole."""

from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction

import pytest

pytest.importorskip("roadkrige.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_jaccard import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "mix_sources", "packing"]

    good = corpus_pipeline.quality_stage(spark, docs, SF)
    assert good.columns == columns
    kept = {r.doc_id for r in good.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(d in kept for d, q in labels.items() if q == 1) >= 0.95 * sum(labels.values())
    assert sum(d not in kept for d, q in labels.items() if q == 0) >= 0.5 * sum(q == 0 for q in labels.values())

    single = corpus_pipeline.exact_stage(spark, good, SF)
    first = {}
    for d in sorted(kept):
        first.setdefault(norm(before[d].text), d)
    assert single.columns == columns and {r.doc_id for r in single.collect()} == set(first.values())

    near = corpus_pipeline.near_stage(spark, single, SF)
    want = {c for _, _, c in brute([(d, before[d].text) for d in sorted(first.values())], 5, Fraction(4, 5))}
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == sorted(want)

    mixed = corpus_pipeline.mixing_stage(spark, near, SF)
    rows = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and set(rows) <= want and max(rows.values()) <= 3

    pieces = corpus_pipeline.packing_stage(spark, mixed, SF).collect()
    ids = Counter()
    for r in pieces:
        ids[r.doc_id] += r.length
    assert set(ids) == set(rows)
    tokens = {r.doc_id: r.doc_tokens for r in pieces}
    assert all(ids[d] == tokens[d] * rows[d] for d in rows)


def test_run_is_the_stages_in_turn(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda rows: Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(got) == key(docs.collect())


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, stage):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns, and no rows at all."""
    long = "many words in one long text " * 20_000
    names = "_id _score _row _own _digest _key key block component size shard _t".split()
    rows = [(1, "a plain text of a few words", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (3, "", "en", "s"), (4, long, None, "s"), (5, long, "de", None), (None, "no id here", "en", "t")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(*r, 1, *names) for r in rows], kind)
    out = stage(spark, docs, SF)
    if stage is not corpus_pipeline.packing_stage:
        assert out.columns == docs.columns
        assert all(r._id == "_id" and r.size == "size" for r in out.collect())
    else:
        assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, 5, None}
    assert stage(spark, docs.limit(0), SF).count() == 0
