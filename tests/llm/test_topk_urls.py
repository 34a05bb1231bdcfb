from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("roadkrige.llm")
from roadkrige.llm import topk, urls  # noqa: E402


def brute(rows, asked, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i in asked}):
        qv = min(v for i, v in ok if i == q)
        score = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in ok if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(score)]
    return Counter(out)


@pytest.mark.parametrize("block", [3 * 8 * 40, topk.QUERY_BYTES])
def test_top_k(spark, monkeypatch, block):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 40)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(20)] + [(400, None), (401, [None] * 40), (402, [float("nan")] * 40), (403, [float("inf")] * 40), (None, rows[0][1]), (404, []), (405, rows[3][1][:9]), (10, rows[11][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = {i for i, _ in rows if i is not None and i % 20 == 0}
    got = topk.top_k(df, df.filter("vec_id % 20 = 0"), query_bytes=block).collect()
    assert Counter(map(tuple, got)) == brute(rows, asked, 10)


def test_top_k_large_components_and_few_candidates(spark):
    rows = [(0, [3e8, 1.0]), (1, [3e8, -1.0]), (2, [-3e8, 2.0]), (3, [1e4, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = sorted((q, i, clip(s)) for q, _, i, s in brute(rows, {0, 1, 2, 3}, 10))
    got = topk.top_k(df, df).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == want
    for q in range(4):  # by score, equal ones by id, ranks from 1
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3]
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_bounds_leave_few_candidates():
    """On clustered vectors most pairs are gone after the first block of dimensions, and the result is exact."""
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (20, 64)) * 0.8 ** np.arange(64)
    v = np.floor(1024 * (centres[rng.integers(0, 20, 12_000)] + rng.normal(0, 0.02, (12_000, 64))))
    ids, asked = np.arange(12_000), np.arange(0, 12_000, 100)
    best = topk.search(asked, v[asked], 10, ((ids[a : a + 5000], v[a : a + 5000]) for a in range(0, 12_000, 5000)))
    pairs, left = best.alive[0]
    assert pairs > 0 and left < pairs / 2, best.alive
    shares = [best.alive[i][1] for i in sorted(best.alive)]
    assert shares[-1] < shares[0] / 2
    for row, q in enumerate(asked):
        scores = v @ v[q]
        scores[q] = -np.inf
        order = np.lexsort((ids, -scores))[:10]
        own = best.row == row
        assert sorted(zip(-best.score[own], best.id[own], strict=True)) == [(-scores[i], i) for i in order]


def test_top_k_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    want = con.execute(f"SELECT query_id, rank, vec_id, score FROM ({topk.ORACLE_SQL['op8_topk_search']})").fetchall()
    assert Counter(map(tuple, topk.op8_topk_search(spark, "/root/testdata/sf0.01").collect())) == Counter(want)


URLS = [
    (1, "http://A.NET/x", "a.net", "/x", "net/", "block"),
    (2, "https://www.Example.net/en/1?q=/de/", "www.example.net", "/en/1", "example.net/en/", "allow"),
    (3, "http://example.net/fr/", "example.net", "/fr/", "net/", "block"),
    (4, "http://example.com/de/#x", "example.com", "/de/", "example.com/de/", "block"),
    (5, "http://a.org/fr/1", "a.org", "/fr/1", "org/fr/", "allow"),
    (6, "http://notexample.com/de/", "notexample.com", "/de/", None, None),
    (7, "http://internet/", "internet", "/", None, None),
    (8, "http://a.net", "a.net", "", None, None),
    (9, None, "", "", None, None),
    (10, "no scheme a.net/x", "", "", None, None),
    (11, "x://y?u=http://a.net/", "y", "", None, None),
    (12, "", "", "", None, None),
    (None, "http://a.net/x", "a.net", "/x", "net/", "block"),
    (13, "http://net/" + "y" * 100_000, "net", "/" + "y" * 100_000, "net/", "block"),
]


def test_urls(spark):
    df = spark.createDataFrame([(r[0], r[1], "h", "clash") for r in URLS], "page_id long, url string, html string, host string")
    got = {(r.page.page_id, r.host, r.path, r.rule): r.verdict for r in urls.judge(df).collect()}
    for i, _, host, path, rule, verdict in URLS:
        says = got.pop((i, host, path, rule))
        assert says in ("allow", "block") and (verdict is None or says == verdict)
    assert not got
    assert urls.judge(df.limit(0)).count() == 0


def test_trees_learn_from_labelled_urls(spark):
    """Held-out accuracy on URLs whose label follows from their look."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows = [(f"http://{word()}.example.com/en/{rng.integers(999)}", 0.0) for _ in range(300)]
    rows += [(f"http://{word()}-{word()}{rng.integers(99)}.example.com/en/{rng.integers(999)}?a=1", 1.0) for _ in range(300)]
    df = urls.with_lexical(urls.with_rule(urls.with_parts(spark.createDataFrame(rows, "url string, label double"))))
    df = df.withColumns({"share1": F.lit(0.1), "share2": F.lit(0.1), "weight": F.lit(1.0), "fold": F.abs(F.hash("url")) % 3})
    model = urls.train(df.filter("fold > 0"))
    out = model.transform(VectorAssembler(inputCols=list(urls.FEATURES), outputCol="features").transform(df.filter("fold = 0")))
    assert out.select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.95


def test_undecided_urls_get_both_verdicts(spark):
    """Host, path and rule as SQL has them; held-out hosts of known label; both verdicts for the rest."""
    import duckdb

    con = duckdb.connect()
    path = "/root/testdata/sf0.1/pages.parquet"
    want = con.execute(rf"""
        WITH p AS (
            SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM '{path}')
        SELECT page_id, host, path,
               CASE WHEN '.' || host LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                    WHEN '.' || host LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                    WHEN '.' || host LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                    WHEN '.' || host LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM p""").fetchall()
    says = dict(urls.RULES)
    out = urls.op7_url_filter(spark, "/root/testdata/sf0.1").collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in out) == Counter(want)
    assert all(r.verdict == says[r.rule] for r in out if r.rule)
    assert min(Counter(r.verdict for r in out if not r.rule)[v] for v in ("allow", "block")) > 50
    measured = urls.report(spark.read.parquet(path))
    # the features do not show the language in the path, which decides under .net: at best some 0.8 can be right, 0.58 by one verdict for all
    assert measured["urls"] > 100 and measured["recall"] > 0.5 and measured["precision"] > 0.6 and measured["right"] > 0.65, measured


def test_entropy(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("aabb",), ("",), ("aaaa",), ("abcd.",)], "s string").select(urls.entropy(F.col("s"))).collect()
    assert [round(r[0], 6) for r in got] == [1.0, 0.0, 0.0, round(math.log2(5), 6)]


def test_clean_hosts_stay(spark):
    pages = [(i, f"https://{h}.example.com/en/{i}") for i, h in enumerate(["thon", "blog.ther", "m.tiontion"] * 60)]
    pages += [(2000 + i, f"http://a{i}.net/en/") for i in range(40)]
    out = urls.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()
    assert all(r.verdict == ("allow" if r.page.page_id < 1000 else "block") for r in out)
