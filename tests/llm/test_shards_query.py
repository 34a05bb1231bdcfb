from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("roadkrige.llm")
from roadkrige.llm import shards  # noqa: E402


def check(rows, docs):
    """The law of rows: counts at most one apart, slots gapless, every record once, with its size and checksum."""
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert {r.law for r in rows} <= {"rows"} and all(r.grown_shard is None for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(40)]
    assert max(counts) - min(counts) <= 1


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = shards.op9_shuffle_shards(spark, sf).collect()
    check(rows, docs)
    # shuffled: neighbours by id are not neighbours in a shard
    place = {r.doc_id: (r.shard, r.slot) for r in rows}
    ids = sorted(place)
    assert sum(abs(place[a][1] * 40 + place[a][0] - place[b][1] * 40 - place[b][0]) == 1 for a, b in zip(ids, ids[1:], strict=False)) < len(ids) / 10
    assert {r.doc_id: (r.shard, r.slot) for r in shards.op9_shuffle_shards(spark, sf).collect()} == place


def test_query_on_odd_rows(spark, tmp_path):
    docs = [(1, None), (2, ""), (3, "ä€😀"), (3, "ä€😀"), (4, "x" * 300_000)] + [(i, "same") for i in range(10, 100)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string"
    for name, own in (("odd", docs), ("none", [])):
        spark.createDataFrame([(i, t, "en", None, 1, "clash") for i, t in own], schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        check(shards.op9_shuffle_shards(spark, f"{tmp_path}/{name}").collect(), own)
