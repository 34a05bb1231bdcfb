from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("roadkrige.llm")
from roadkrige.llm import phrases  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, low, top, keep_share=100):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, count in f.items():
        found = {}
        for w, a in count.items():
            if len(w) > 1 and a >= low:
                cuts = [(1000 * a * n[lang] // (count[w[:k]] * count[w[k:]]), k, count[w[:k]], count[w[k:]]) for k in range(1, len(w))]
                found[w] = (a, *min(cuts))
        gone = {w[i : i + m] for w, (a, *_) in found.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if 100 * a >= keep_share * count[w[i : i + m]]}
        rank = sorted((-s, -a, " ".join(w).encode(), left, right) for w, (a, s, _, left, right) in found.items() if w not in gone)
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(rank[:top])]
    return sorted(out)


def corpus():
    rng = np.random.default_rng(5)
    words = ["the", "The", "a", "new", "york", "times", "zu", "été", "\x01", "x\x00y", "of", "ÉTÉ", "los angeles"]
    rows = []
    for i in range(300):
        w = [words[j] for j in rng.zipf(1.5, rng.integers(0, 60)) % len(words)]
        rows.append((str(rng.choice([" ", "  ", "\t"])).join(w).replace("a new", "a, new" if i % 3 else "a\nnew"), ["en", "de", None, "und"][i % 4]))
    rows += [("a b a b a b a b", "en")] * 20 + [(None, "en"), ("", None), ("!?;", "de"), ("one", "fr")]
    rows += [("lorem ipsum dolor sit amet " * 400, "en")]
    return rows


@pytest.mark.parametrize("low, sizes", [(10, phrases.Sizes()), (3, phrases.Sizes(shard=700, range=900, chunk=7, front=60)), (1, phrases.Sizes(shard=3000, range=2500, chunk=40, front=500))])
def test_equals_brute_force(spark, low, sizes):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "text string, lang string, words string").repartition(6)
    for share, top in ((100, 2000), (60, 7)):
        got = phrases.collocations(docs, min_count=low, keep_share=share, top=top, sizes=sizes).collect()
        assert sorted(map(tuple, got)) == brute(rows, low, top, share)


def test_no_phrase(spark):
    docs = spark.createDataFrame([("a b", "en"), (None, None)], "text string, lang string")
    assert phrases.collocations(docs).count() == 0 and phrases.collocations(docs.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    """Counts that no small corpus has, through the arithmetic of the score."""
    a, n, left, right = 9 * 10**15, 8 * 10**17, 10**16 + 7, 3 * 10**16 + 1
    row = spark.sql(f"SELECT cast(cast(1000 AS decimal(4,0)) * cast({a}L AS decimal(19,0)) * cast({n}L AS decimal(19,0)) AS decimal(38,0)) div (cast({left}L AS decimal(19,0)) * cast({right}L AS decimal(19,0))) AS s")
    assert row.first().s == 1000 * a * n // (left * right)


def test_chunks_round_trip():
    text = pa.array(["b a b a c. a b", "a b c d e f g", None, "a"])
    known, paths, n = phrases.trie(text, pa.array(["en", "de", "en", "en"]))
    assert n.sum() == 15
    want = [(tuple(known[x - 1].as_py() for x in p if x), c) for p, c in zip(paths.tolist(), n.tolist(), strict=True)]
    assert want == sorted(want)
    got = []
    for at in range(0, len(paths), 4):
        head, *rest = phrases.chunk(known, paths[at : at + 4], n[at : at + 4])
        w, p, c = phrases.opened(*rest, 6)
        got += [(tuple(w[x - 1].as_py().encode() for x in q if x), k) for q, k in zip(p.tolist(), c.tolist(), strict=True)]
        assert tuple(h.encode() for h in head) == got[at][0]
    assert got == want


def test_query_equals_sql(spark):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    want = con.sql(phrases.ORACLE_SQL["op12_phrases"])
    got = phrases.op12_phrases(spark, sf).select(*want.columns).collect()
    assert got and sorted(map(tuple, got)) == sorted(want.fetchall())
