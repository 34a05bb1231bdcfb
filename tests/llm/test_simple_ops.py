"""exact, mixing, shards, tokens, packing against brute force on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("roadkrige.llm")
from roadkrige.llm import exact, mixing, packing, shards, text, tokens  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, copies string"
LONG = "Wörd  über\tlöng " * 20_000
ROWS = [
    (1, "a b\tc", "en", "s1", 5, "x", "y"),
    (2, "a b  c", "en", "s1", 6, None, None),
    (3, None, None, None, None, None, None),
    (4, "", "en", "s2", 0, "", ""),
    (5, LONG, "de", "s2", len(LONG), "", ""),
    (5, LONG, "de", "s2", len(LONG), "", ""),
    (6, LONG, "de", "ű", len(LONG), "", ""),
    (7, "  \n ", "en", "\U00010000", 4, "", ""),
    (8, "x▁ y <|endoftext|> </s> it's\x1cok İΣ é z", "en", "s3", 9, "", ""),
    (9, "a b c", "en", "s3", 5, "", ""),
    (None, "only one", "en", "s3", 8, "", ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("limit,segment", [(exact.BROADCAST_LIMIT, exact.SEGMENT_ROWS), (0, 60)])
def test_exact(odd, docs, limit, segment):
    for df in (odd, docs):
        rows = df.collect()
        groups = defaultdict(list)
        for r in rows:
            groups[norm(r.text)].append(r.doc_id)
        want = Counter()
        for r in rows:
            g = groups[norm(r.text)]
            keep = min((x for x in g if x is not None), default=None)
            want[(r.doc_id, keep, len(g), r.doc_id == keep, hashlib.sha256(norm(r.text).encode()).hexdigest())] += 1
        assert Counter(map(tuple, exact.duplicates(df, broadcast_limit=limit, segment_rows=segment).collect())) == want
        left = exact.deduplicate(df)
        assert left.columns == df.columns
        assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(str(r.doc_id) for r in rows if r.doc_id == min((x for x in groups[norm(r.text)] if x is not None), default=None))


def test_filter_passes_most_single_rows(spark):
    df = spark.range(5000).selectExpr("cast(id as string) as k").union(spark.createDataFrame([("7",)], "k string"))
    got = exact.possibly_repeated(df, "k", 5001)
    assert got.filter("k = '7' and maybe").count() == 2
    assert got.filter("maybe").count() < 20


def test_filter_works_beyond_any_size(spark, monkeypatch):
    """A filter of its least size still lets single rows pass: only repeated hashes are in it."""
    monkeypatch.setattr(exact, "FILTER_BITS", 1 << 15)
    df = spark.range(20_000).selectExpr("cast(id % 19900 as string) as k")
    got = exact.possibly_repeated(df, "k", 10**11)
    assert got.filter("maybe and cast(k as int) < 100").count() == 200
    assert got.filter("maybe").count() < 400


def test_empty_tables(odd):
    none = odd.limit(0)
    assert exact.duplicates(none).count() == 0 and exact.deduplicate(none).count() == 0
    assert mixing.mix(none).count() == 0 and shards.shuffle(none).count() == 0
    assert tokens.count_tokens(none).count() == 0 and packing.pack_documents(none).count() == 0


def brute_targets(size):
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [s for s in size if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        free = [s for s in size if s not in capped]
        left = total - sum(3 * size[s] for s in capped)
        got = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if got[s] > 3 * size[s] + 1e-9}
        if not over:
            return got | {s: 3.0 * size[s] for s in capped}
        capped |= over


def test_mixing(odd, docs):
    for df in (odd, docs):
        sizes = mixing.size_table(df)
        out = mixing.with_copies(sizes, sizes, mixing.rates(sizes)).collect()
        size = Counter()
        for r in df.collect():
            size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        want = brute_targets(dict(size))
        assert len(out) == df.count()
        for r in out:
            assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
            assert 0 <= r.copies <= 3
        again = {(r.doc_id, r.copies) for r in mixing.with_copies(sizes, sizes, mixing.rates(sizes)).collect()}
        assert again == {(r.doc_id, r.copies) for r in out}
        mixed = mixing.mix(df)
        assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in out)
    taken, largest = Counter(), Counter()
    for r in out:
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    # all documents of these sources are heavy, so no source strays by its largest one
    assert all(abs(taken[s] - want[s]) < largest[s] for s in want)


def test_copies_have_their_probability(spark, monkeypatch):
    """Over many sources, a copy is as frequent as the fraction of the rate, for heavy and other documents alike."""
    monkeypatch.setattr(mixing, "HEAVY", 2)
    n = 1500
    sizes = spark.range(n * 5).selectExpr("id as doc_id", f"concat('s', id % {n}) as source", f"cast(1 + id div {n} as long) as size")
    for part in (0.25, 0.5, 0.749):
        table = spark.range(n).selectExpr("concat('s', id) as _source", "15L as source_size", "0.0D as target", "0L as base", f"{part}D as part")
        got = mixing.with_copies(sizes, sizes, table).groupBy("size").avg("copies").collect()
        assert len(got) == 5 and all(abs(r[1] - part) < 0.05 for r in got), got
        sums = mixing.with_copies(sizes, sizes, table).filter("size > 3").groupBy("source").sum("copies").collect()
        assert {r[1] for r in sums} <= {int(2 * part), int(2 * part) + 1}


def test_mixing_equals_its_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.01/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    for name, query in (("op6_mix_sources", mixing.op6_mix_sources), ("op4_exact_dedup", exact.op4_exact_dedup)):
        df = query(spark, "/root/testdata/sf0.01")
        sql = (mixing.ORACLE_SQL | exact.ORACLE_SQL)[name]
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        assert Counter(map(tuple, df.collect())) == Counter(want), name


def test_shards(spark, odd, docs):
    for df, n in ((odd, 3), (docs, 40)):
        out = shards.shuffle(df, n, bucket_bytes=50_000).collect()
        assert Counter(tuple(r.record) for r in out) == Counter(map(tuple, df.collect()))
        by = defaultdict(list)
        for r in out:
            by[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        assert max(map(len, by.values())) - min(len(by[i]) for i in range(n)) <= 1
    first = [(r.record.doc_id, r.shard, r.slot) for r in out]
    assert sorted(first) == sorted((r.record.doc_id, r.shard, r.slot) for r in shards.shuffle(docs, 40, bucket_bytes=50_000).collect())
    assert [x[0] for x in sorted(first, key=lambda x: x[1:])] != sorted(x[0] for x in first)


def test_write_shards(spark, docs, tmp_path):
    shards.write_shards(docs, f"{tmp_path}/out", 4)
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("shard").count().count() == 4


def test_fisher_yates_is_uniform():
    rng = np.random.default_rng(1)
    seen = Counter(tuple(shards.fisher_yates(3, rng)) for _ in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850


def test_tokens(odd, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.default_model())
    for df in (odd, docs):
        want = Counter()
        for r in df.collect():
            n = len(sp.encode(r.text or ""))
            want[(r.doc_id, len((r.text or "").encode()), n, n > 4096)] += 1
        assert Counter(map(tuple, tokens.count_tokens(df).collect())) == want


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_that_a_polynomial_hash_confuses(spark):
    import sentencepiece
    import tokenizers

    rows = [(n + i, f"{n} {thue_morse(n, x)} b") for n in (32, 64, 1024, 2048) for i, x in enumerate(("ab", "ba"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.default_model())
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()} == {i: len(sp.encode(t)) for i, t in rows}
    tok = tokenizers.Tokenizer.from_file(tokens.default_model(packing.VOCABULARY))
    got = {i: [] for i, _ in rows}
    for r in sorted(packing.pack_documents(df, with_ids=True).collect(), key=lambda r: r.start):
        got[r.doc_id] += r.ids
    assert got == {i: [*tok.encode(t, add_special_tokens=False).ids, 2] for i, t in rows}


def test_known_strings_with_equal_keys():
    """A hit is compared by its bytes; of strings with equal keys one is kept."""
    known, words = text.Known(), pa.array([b"a", b"b", b"c"], pa.large_binary())
    assert known.add(words, np.array([7, 7, 9], np.uint64)).tolist() == [0, 2]
    assert known.find(words, np.array([7, 7, 9], np.uint64)).tolist() == [0, -1, 1]
    assert known.add(words.slice(1, 1), np.array([7], np.uint64)).tolist() == [] and len(known) == 2


def test_full_caches_change_nothing(monkeypatch, docs):
    rows = [r.text or "" for r in docs.select("text").collect()][:60]
    at = np.concatenate(([0], np.cumsum([len(t.encode()) for t in rows])))
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    models = tokens.default_model(), tokens.default_model(packing.VOCABULARY)
    runs = []
    for size in (10**6, 40):
        monkeypatch.setattr(tokens, "CACHE", size)
        monkeypatch.setattr(packing, "CACHE", size)
        counter, tokenizer = tokens.Counter(models[0]), packing.Tokenizer(models[1])
        parts = [(data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in text.blocks(at, 3000)]
        runs.append([*(counter.count(*p).tolist() for p in parts), *(x.tolist() for p in parts for x in tokenizer.ids(*p))])
    assert runs[0] == runs[1]


@pytest.mark.parametrize("text", ["  a", "a  ", "▁", "▁▁ a", "a ▁ b", " ▁a", "a▁", "\x00 \x00", "a  \n  b", "日本 語  x", "😀 <s> </s>", " "])
def test_token_edges(text):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.default_model())
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    assert tokens.Counter(tokens.default_model()).count(data, np.array([0, len(data)])).tolist() == [len(sp.encode(text))]


def test_packing(odd, docs):
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(tokens.default_model(packing.VOCABULARY))
    for df in (odd, docs):
        want = Counter()
        for r in df.collect():
            ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
            whole = len(ids) // 4096 * 4096
            cuts = [*range(0, whole, 4096), *range(whole, len(ids), packing.PIECE), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                piece = ids[a:b]
                want[(r.doc_id, a, len(piece), zlib.crc32(np.array(piece, dtype="<u4").tobytes()), len(ids))] += 1
        out = packing.pack_documents(df, with_ids=True).collect()
        assert Counter(tuple(r)[:5] for r in out) == want
        sequences = defaultdict(list)
        for r in out:
            assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
            sequences[r.sequence_id].append((r.offset, r.length))
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 4096
    assert sum(r.length for r in out) / (4096 * len(sequences)) > 0.97


def test_cut_words_give_the_same_ids():
    import tokenizers

    model = tokens.default_model(packing.VOCABULARY)
    tok, own = tokenizers.Tokenizer.from_file(model), packing.Tokenizer(model)
    rng = np.random.default_rng(12)
    parts = ["it's", "IT'S", "we'll", "'re", "a.'s", "x'", "'", "''s", "don't!", "(word", "3d", "d3", "é,", ",é", "e\u0301.", "…,", "<|endoftext|>", "<|EndOfText|>", "a<|startoftext|>b", "|", "a|b", "<", "!!", "***", "Σ", "ΑΣ.", "İ", "日本", "\x1c", "\x7f", "ﬁ", "_", "a_b", "１2", "½", "s", "re", "\u00a0", "\u3000x"]
    texts = ["".join(parts[i] + (" " if rng.random() < 0.3 else "") for i in rng.integers(0, len(parts), 12)) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    ids, ends = own.ids(np.frombuffer(b"".join(raw), np.uint8), at)
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_differencing_balances():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 1024, 3000)
    windows = packing.pack(lengths)
    sums = np.bincount(windows, weights=lengths)
    assert sums.max() <= 4096 and len(sums) <= np.ceil(lengths.sum() / 4096) * 1.01
    assert len(set(packing.pack(np.full(5, 3000)))) == 5
