from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("roadkrige.llm")
from roadkrige.llm import substring  # noqa: E402

W = 50


def brute(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words, strict=True):
        if d is not None:
            for i in range(len(w) - W + 1):
                key = tuple(w[i : i + W])
                least[key] = min(d, least.get(key, d))
    out = Counter()
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        if d is not None:
            for i in range(len(w) - W + 1):
                if least[tuple(w[i : i + W])] < d:
                    gone.update(range(i, i + W))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[(d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def digests(df):
    return Counter(map(tuple, df.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()))


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(8)
    word = lambda n: [f"wörd{x}" for x in rng.integers(0, 40, n)]
    passages = [word(n) for n in (49, 50, 51, 60, 75, 120, 400)]
    rows = []
    for d in range(90):
        text = word(int(rng.integers(0, 130)))
        for _ in range(int(rng.integers(0, 3))):
            p = passages[rng.integers(len(passages))]
            cut = int(rng.integers(0, 12)) if rng.random() < 0.5 else 0
            text += p[cut : len(p) - cut] + word(int(rng.integers(0, 20)))
        rows.append((int(d * 7 % 90), "  ".join(text)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, " ".join(["same"] * 300)), (204, " ".join(["same"] * 120)), (205, "\t".join(["same"] * 50))]
    rows += [(206, rows[3][1]), (206, rows[3][1]), (206, rows[4][1]), (None, rows[5][1]), (None, "null id " * 40), (207, "null id " * 40), (208, " ".join(word(5000) + passages[6]))]
    return rows


@pytest.mark.parametrize("batches,max_runs", [(1, 4), (4, 1), (5, 2)])
def test_planted(spark, planted, batches, max_runs):
    df = spark.createDataFrame(planted, "doc_id long, text string").selectExpr("doc_id", "text", "1 as first", "2 as text_key")
    assert digests(substring.deduplicate(df, batches=batches, max_runs=max_runs)) == brute(planted)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert digests(substring.deduplicate(df)) == brute([tuple(r) for r in df.collect()])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.deduplicate(df).count() == 0


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_that_a_polynomial_hash_confuses(spark):
    rows = []
    for n in (1024, 2048):
        for i, letters in enumerate(("ab", "ba")):
            rows.append((n + i, " ".join([*map(str, range(n, n + 30)), thue_morse(n, letters), *map(str, range(30))])))
    rows += [(i, thue_morse(128, letters).replace("a", "a ").replace("b", "b ")) for i, letters in enumerate(("ab", "ba"))]
    assert digests(substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_ids_of_any_type(spark, planted):
    rows = [(None if d is None else f"id{d:05d}", t) for d, t in planted]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert digests(substring.deduplicate(df, batches=3)) == brute(rows)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_index_opens_again_and_its_runs_never_shuffle(spark, planted, tmp_path):
    """Batches added by separate openings; more runs do not add exchanges, neither to a batch nor to compaction."""
    own = substring.identified(spark.createDataFrame(planted, "doc_id long, text string"), "text", "doc_id")
    cuts = [None, 20, 45, 60, 80, None]
    found, plans = None, []
    for low, high in zip(cuts, cuts[1:], strict=False):
        index = substring.FingerprintIndex(spark, f"file://{tmp_path}/index", max_runs=9)
        so_far = own if high is None else own.filter(f"doc_id <= {high}")
        batch = so_far if low is None else so_far.filter(f"doc_id > {low}")
        fresh = substring.entries(batch).groupBy("print").agg(*[F.first(c).alias(c) for c in substring.PRINT_COLUMNS[:-1]]).withColumn("several", F.lit(True))
        plans.append(exchanges(index._with_history(fresh, index.prints, substring.PRINT_KEY, substring.PRINT_COLUMNS)))
        part = index.add(batch, so_far)
        found = part if found is None else found.unionByName(part)
        assert len(index.prints) == len(plans)
        index.close()
    assert digests(substring.removal(own, found)) == brute(planted)
    assert set(plans) == {1}
    index = substring.FingerprintIndex(spark, f"file://{tmp_path}/index")
    merges = [exchanges(index.merged(index.prints[:i], substring.PRINT_KEY, substring.PRINT_COLUMNS)) for i in (2, 5)]
    assert merges[0] == merges[1] <= 1
    index.compact()
    assert len(index.prints) == len(index.windows) == 1
    rows = index.prints[0].rows()
    assert rows.count() == rows.select("print").distinct().count() == substring.entries(own.filter("doc_id is not null")).select("print").distinct().count()
    index.close()


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 100, 200)
    for width in (1, 2, 3, 26, 35, 64):
        assert substring.sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(len(x) - width + 1)]
