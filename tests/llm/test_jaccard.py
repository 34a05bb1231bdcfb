from __future__ import annotations

import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("roadkrige.llm")
from roadkrige.llm import components, jaccard, scratch  # noqa: E402

SF = "/root/testdata/sf0.001"


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, similarity):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None) if sets[i] else d))
    return sorted(out, key=str)


def noisy(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.integers(len(words))] = f"w{rng.integers(10**6)}"
    return words


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(11)
    rows, at = [], 0
    for size in (1, 2, 3, 4, 5, 6, 8, 9, 12, 15, 20, 30, 50, 90, 150, 400, 1500):
        for _ in range(3):
            base = [f"v{x}" for x in rng.integers(0, 3000, size)]
            for copies in range(6):
                words = noisy(rng, base, int(rng.integers(0, max(2, size // 25 + 2))) if copies else 0)
                words = words[: max(1, len(words) - int(rng.integers(0, size // 12 + 1)))]
                rows.append((at, " ".join(words)))
                at += 1
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "One TWO three"), (5004, "one two  three"), (5005, "ÀB c"), (5006, "àb c")]
    rows += [(5007, rows[60][1]), (5007, rows[60][1]), (5007, rows[90][1]), (None, rows[100][1])]
    return rows


@pytest.mark.parametrize("k,similarity", [(4, Fraction(85, 100)), (5, Fraction(4, 5))])
@pytest.mark.parametrize("block", [512, 4])
def test_all_links_are_found(spark, planted, monkeypatch, k, similarity, block):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    df = spark.createDataFrame(planted, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as key", "1 as n")
    got = sorted(map(tuple, jaccard.near_duplicates(df, k, similarity).collect()), key=str)
    assert got == brute(planted, k, similarity)


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    got = sorted(map(tuple, jaccard.near_duplicates(df, 4, Fraction(85, 100)).collect()), key=str)
    assert got == brute(rows, 4, Fraction(85, 100))
    kept = {r.doc_id for r in jaccard.keep_one(df, 4, Fraction(85, 100)).collect()}
    assert kept == {c for _, _, c in got}


def test_signatures_survive_packing():
    rng = np.random.default_rng(1)
    marks, owner, keys = rng.integers(0, 2**64, 5000, dtype=np.uint64), rng.integers(0, 70, 5000), rng.integers(0, 2**62, 70)
    batch = jaccard.pack_signatures(marks, keys, np.sort(owner), 7)
    got = {(int(b), int(m), int(k)) for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m, k in zip(*jaccard.unpack_signatures(x), strict=True)}
    assert got == {(int(m % np.uint64(7)), int(m >> np.uint64(16)), int(keys[o])) for m, o in zip(marks, np.sort(owner), strict=True)}
    assert jaccard.pack_signatures(marks[:0], keys[:0], owner[:0], 7).num_rows == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(df).count() == 0 and jaccard.keep_one(df).count() == 0


@pytest.mark.parametrize("tries", [6, 0])
def test_linked_sets_share_a_signature(monkeypatch, tries):
    """The guarantee, over random linked pairs of all sizes (tries 0: the common signature alone)."""
    monkeypatch.setattr(jaccard, "TRIES", tries)
    rng, similarity = np.random.default_rng(2), Fraction(85, 100)
    bands = jaccard.Bands(similarity)
    checked = 0
    for _ in range(1500):
        size = int(rng.choice([7, 10, 14, 20, 40, 100, 300]))
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        drop = int(rng.integers(0, size * 16 // 100 + 1))
        b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, int(rng.integers(0, drop + 1)), dtype=np.uint64))))
        common = len(np.intersect1d(a, b))
        if 100 * common < 85 * (len(a) + len(b) - common) or np.array_equal(a, b):
            continue
        checked += 1
        assert len(np.intersect1d(jaccard.signatures(a, bands), jaccard.signatures(b, bands)))
    assert checked > 300


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = np.random.default_rng(4)
    edges = {"path": [(i, i + 1) for i in range(300)], "star": [(500, i) for i in range(300)], "random": [tuple(map(int, rng.integers(0, 400, 2))) for _ in range(250)]}[shape]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    seen = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == seen
    for a in seen:
        for b in list(seen)[:60]:
            assert (got[a] == got[b]) == (find(a) == find(b))


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_that_a_polynomial_hash_confuses(spark):
    """Thue-Morse words and their complements, as whole documents and inside shingles."""
    rows = []
    for n in (1024, 2048):
        for i, letters in enumerate(("ab", "ba")):
            rows += [(n + i, f"one two {thue_morse(n, letters)} four"), (n + 10 + i, thue_morse(n, letters)), (n + 20 + i, " ".join(thue_morse(n, letters)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(df, 4, Fraction(85, 100)).collect()), key=str) == brute(rows, 4, 0.85)


def test_shared_shingles_are_compared_by_their_words():
    """Sets whose hashes collide are not linked."""
    words = pa.array([f"w{i}".encode() for i in range(30)], pa.large_binary())
    other = pa.array([f"v{i}".encode() for i in range(30)], pa.large_binary())
    values, at = np.arange(1, 28, dtype=np.uint64), np.arange(27)
    a, b, c = (jaccard.Shingles(values, at, 4, w) for w in (words, other, words))
    assert jaccard.linked([a, b, c], Fraction(85, 100), np.ones(3, bool)) == [(0, 2)]


def hot_group(n, size=200, edits=3):
    rng = np.random.default_rng(7)
    base = [f"v{x}" for x in rng.integers(0, 10**6, size)]
    return [(i, " ".join(noisy(rng, base, edits if i else 0))) for i in range(n)]


def test_hot_group_ships_texts_in_proportion(spark, monkeypatch):
    """Rows of text to verify grow with the group, not with its square."""
    shipped = []
    real = jaccard.verified_links

    def counted(members, k, similarity):
        members = scratch.table(members, "test")
        shipped.append(members.count())
        return real(members, k, similarity)

    monkeypatch.setattr(jaccard, "verified_links", counted)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 32)
    rows = {}
    for n in (300, 1200):
        shipped.clear()
        df = spark.createDataFrame(hot_group(n), "doc_id long, text string")
        assert {r.component_id for r in jaccard.near_duplicates(df, 5, Fraction(4, 5)).collect()} == {0}
        rows[n] = sum(shipped)
    assert rows[1200] < 6 * rows[300] and rows[1200] < 5 * 1200, rows


def test_copies_too_far_from_all_others_are_not_compared(spark, monkeypatch):
    """Copies with so many shingles of their own that they have no link stay out of the second round."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 401):
        words = list(base)
        for p in rng.choice(150, 2 if i % 4 == 0 else 7, replace=False).tolist():
            words[p] = f"x{i}p{p}"
        rows.append((i, " ".join(words)))
    shipped, real = [], jaccard.verified_links

    def counted(members, *rest):
        shipped.append(members.count())
        return real(members, *rest)

    monkeypatch.setattr(jaccard, "verified_links", counted)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 32)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.near_duplicates(docs, 4, Fraction(85, 100)).collect()
    assert sorted(map(tuple, found)) == sorted(brute(rows, 4, Fraction(85, 100)))
    assert len({r.component_id for r in found}) > 200
    assert sum(shipped) <= 6 * len(rows)
