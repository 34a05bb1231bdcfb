from __future__ import annotations

import hashlib
import math
import re
import time
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("roadkrige.llm")
from roadkrige.llm import pii  # noqa: E402

FORMS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def fits(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == 1:
        return all(int(p) <= 255 for p in found.split("."))
    if kind == 2:
        twice = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def plain(text):
    return sorted((m.start(), k, m.end()) for k, form in enumerate(FORMS) for m in re.finditer(form, text) if fits(k, m.group()))


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["1", "0", "42", ".", ".", "@", "a", "é", "-", " ", "+", "(", ")", "4111111111111111", "255", "256", "%", "１", "\n", "_"]), max_size=30).map("".join))
def test_forms_equal_the_plain_expressions(text):
    assert pii.base_spans(text) == plain(text)
    spans = [(a, b) for a, _, b in plain(text)]
    for a, b in pii.tokens(text, plain(text)):
        assert all(b <= x or y <= a for x, y in spans) and text[a:b].strip()


@pytest.mark.parametrize("text", ["a" * 10**6, "1" * 10**6, "1." * 10**6, "@" * 10**6, "a@" * 10**6, "+1" * 10**6, "1 " * 10**6, "+1" + "(" * 10**6, "a." * 10**6 + "@", "ab 1 " * 10**5])
def test_linear_in_the_text(text):
    began = time.time()
    pii.finds(text)
    assert time.time() - began < 30


def brute(rows, rounds, support, confident):
    """The same bootstrap with dictionaries."""
    docs = [pii.finds(t or "")[0] for t in rows]
    edges = defaultdict(dict)
    for finds in docs:
        for f in finds:
            for p in f["patterns"]:
                edges[p][f["value"]] = (f["kind"], f["shapes"])
    edges = {p: e for p, e in edges.items() if len(e) > support}
    known = {}

    def counting():
        out = {}
        for p, e in edges.items():
            best = []
            for k in range(4):
                own = [1.0 if kind == k else known[v][1] for v, (kind, _) in e.items() if kind == k or (kind < 0 and known.get(v, (None,))[0] == k)]
                best.append((sum(own) / len(e) if len(own) >= support else 0.0, -k))
            if max(best)[0] >= confident:
                out[p] = (-max(best)[1], max(best)[0])
        return out

    for _ in range(rounds):
        doubt = defaultdict(lambda: 1.0)
        for p, (k, conf) in counting().items():
            for v, (kind, shapes) in edges[p].items():
                if kind < 0 and shapes >> k & 1:
                    doubt[v, k] *= 1 - min(conf, pii.LARGEST_SCORE)
        known = {}
        for (v, k), d in sorted(doubt.items(), key=lambda x: x[0][1]):
            if 1 - d >= confident and (v not in known or 1 - d > known[v][1] + 1e-12):
                known[v] = (k, 1 - d)
    last, out = counting(), []
    for finds in docs:
        spans = [(f["start"], f["kind"], f["end"]) for f in finds if f["kind"] >= 0]
        for f in finds:
            of = [(last[p][1], -last[p][0]) for p in f["patterns"] if f["kind"] < 0 and p in last and f["shapes"] >> last[p][0] & 1]
            if of:
                spans.append((f["start"], -max(of)[1], f["end"]))
        out.append(sorted(spans))
    return out


def corpus():
    rows = [f"Some words. Call me at +1 (555) 010-{i:04d} today, it is {i * 7919 % 10000} now." for i in range(1000, 1012)]
    rows += ["Hello, call me at 555-010-7777 today", "They call me at 555 0199 for lunch", "call me at 12 or at five", "it is 555-010-7777 now"]
    rows += [f"reach my office line {n} soon" for n in ("555-010-7777", "555 0199", "555-010-8888", "555-010-9999", "555-010-1234 x")]
    rows += [f"write to user{i}@mail.example.com please" for i in range(8)] + ["write to bob@localhost please", "write to 2024-11-05 please"]
    rows += [f"year {y} was good" for y in range(1990, 2010)]  # numbers in a context of their own
    return rows + ["plain words only", "", None, "call me at +1 (555) 010-1000 today"] * 2


def test_contexts_discover_unseen_identifiers(spark):
    rows = corpus()
    df = spark.createDataFrame([(i % 50, t, "x") for i, t in enumerate(rows)], "doc_id int, text string, key string").repartition(5)
    found, patterns = pii.discover(df)
    got = [tuple(sorted((f["start"], f["kind"], f["end"]) for f in [*[f for f in r.finds if f["kind"] >= 0], *r.added])) for r in found.collect()]
    want = [tuple(s) for s in brute(rows, pii.ROUNDS, pii.SUPPORT, pii.CONFIDENT)]
    assert sorted(got) == sorted(want)
    by = dict(zip(rows, want, strict=True))
    at = lambda t, value, kind: (t.index(value), kind, t.index(value) + len(value))
    assert at(rows[12], "555-010-7777", 3) in by[rows[12]] and at(rows[13], "555 0199", 3) in by[rows[13]]
    assert (9, 0, 22) in by["write to bob@localhost please"] and not by["write to 2024-11-05 please"]
    assert not by["call me at 12 or at five"] and not by["plain words only"] and not any(by[f"year {y} was good"] for y in range(1990, 2010))
    assert patterns.filter("pattern = '3|call me at' and of = 3").count() == 1


def test_query(spark, tmp_path):
    rows = [(i, t, "en") for i, t in enumerate(corpus())] + [(None, "a@b.c and 10.0.0.256", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.doc_id, r.base_sha256, r.spans): r for r in pii.op13_pii(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    spans = brute([t for _, t, _ in rows], pii.ROUNDS, pii.SUPPORT, pii.CONFIDENT)
    write = lambda s: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in s)
    for (i, t, _), own in zip(rows, spans, strict=True):
        base = plain(t or "")
        r = found[i, hashlib.sha256(write(base).encode()).hexdigest(), write(own)]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]
        assert r.n_added == len(own) - len(base)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.discover(empty)[0].count() == 0


def test_scores(spark):
    edges = [("p", f"0:{i}", 0, 0) for i in range(4)] + [("p", "-1:x", -1, 1), ("q", "-1:x", -1, 1), ("q", "-1:y", -1, 2), ("q", "0:1", 0, 0)]
    df = spark.createDataFrame(edges, "pattern string, value string, kind int, shapes int")
    first = pii.known_patterns(df, None)
    assert [tuple(r) for r in first.collect()] == [("p", 0, 0.8)]
    (value,) = pii.known_values(df, first, 0.79).collect()
    assert value.value == "-1:x" and value.of == 0 and math.isclose(value.score, 0.8)
