"""Personal data: exact forms, and what stands in the same contexts.

The base spans are those of four forms (email, ip, card, phone).  They are the
seeds of a bootstrap:

1. One pass over the texts finds the seeds and, outside of them, tokens that
   could be identifiers (an ``@`` between other characters, or four digits at
   least), each with its lexical patterns: one, two or three words before it,
   and the words around it, lower-cased.
2. Patterns and values are the two sides of a graph.  Round by round Spark
   scores a pattern, per kind, by the share of its distinct values that are known
   to be of the kind (a value found before counts with its score), and a value by
   1 - prod(1 - score of its patterns).  A pattern counts from ``SUPPORT`` distinct
   known values and a score of ``CONFIDENT`` on; a value is known from
   ``CONFIDENT`` on.
3. In the end, tokens in a pattern that counts become spans of its kind if they
   have the shape of that kind at all (``shapes``).

Every edge of the graph is kept once, so a value or pattern that stands in a
third of all rows costs one edge for each of its partners, and all sums are
pre-aggregated.  Patterns with no more than ``SUPPORT`` distinct values are left
out first: they can have no known values beside an unknown one.  Nothing is
broadcast or collected but by Spark's own choice; the rounds pass tables in the
shared folder.

Every form is matched in time linear in the text: possessive repeats where the
plain ones could not give anything back, and for addresses a walk from ``@`` to
``@``.

Defined cases: a null text is empty; empty texts and texts without finds have no
spans and the digest of an empty string; rows that repeat an id or a text are
documents each, and copies of a value are one node; of equal scores the kind
listed first counts; offsets are code points; words of context that reach beyond
``WINDOW`` code points are left out; an empty table gives an empty result;
further columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3
CONFIDENT = 0.8
ROUNDS = 3
WINDOW = 80
LARGEST_SCORE = 0.999

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_REST = re.compile(r"[^\x20\x09-\x0D]*+(?:\x20[().+-]*+[0-9][0-9().+-]*+(?![^\x20\x09-\x0D]))*+")
_SPACE = frozenset("\x20\x09\x0a\x0b\x0c\x0d")
_EDGE = ".,;:!?\"'<>[]{}|*#$%&="
_WORD_EDGE = _EDGE + "()"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        head = text[low:at]
        start = low + len(head.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        low = at + 1  # no local part holds an @
        if domain:
            yield start, domain.end()
            low = domain.end()
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four forms, in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def shapes(value: str) -> int:
    """Which kinds a token could be of, as bits."""
    digits, letters = sum(c in "0123456789" for c in value), any(map(str.isalpha, value))
    parts = value.replace(":", ".").count(".")
    email = "@" in value.strip("@")
    return email * 1 + (not email and digits >= 4 and 3 <= parts <= 7) * 2 + (not letters and digits >= 12) * 4 + (not letters and 7 <= digits <= 15 and parts < 3) * 8


def tokens(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Spans outside the base ones that could be identifiers; groups of digits after one another are one."""
    spans = sorted((a, b) for a, _, b in base)
    starts = [a for a, _ in spans]
    reach, ends = 0, []
    for _, b in spans:
        reach = max(reach, b)
        ends.append(reach)
    low = 0
    hint = _HINT.search(text)
    while hint:
        start = hint.start()
        while start > low and text[start - 1] not in _SPACE:
            start -= 1
        end = _REST.match(text, hint.start()).end()
        low = end
        a, b = end - len(text[start:end].lstrip(_EDGE)), start + len(text[start:end].rstrip(_EDGE))
        k = bisect_right(starts, b - 1) - 1
        if a < b and (k < 0 or ends[k] <= a):
            value = text[a:b]
            if "@" in value.strip("@") or sum(c in "0123456789" for c in value) >= 4:
                yield a, b
        hint = _HINT.search(text, end)


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a span."""
    left, right = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    before, after = left.split(), right.split()
    if start > WINDOW and left[:1] and not left[0].isspace():
        before = before[1:]
    if len(text) > end + WINDOW and right[-1:] and not right[-1].isspace():
        after = after[:-1]
    if left[-1:] and not left[-1].isspace():  # what touches the span is no word of its own
        before = before[:-1]
    if right[:1] and not right[0].isspace():
        after = after[1:]
    before, after = ([w.strip(_WORD_EDGE) or w for w in words] for words in ([w.lower() for w in before[-3:]], [w.lower() for w in after[:1]]))
    out = [f"{k}|" + " ".join(before[-k:]) for k in (1, 2, 3) if len(before) >= k]
    return [*out, f"around|{before[-1]}|{after[0]}"] if before and after else out


_FIND = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("shapes", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])
_FOUND = "key long, doc_id {id}, finds array<struct<start:long,kind:int,end:long,shapes:int,value:string,patterns:array<string>>>, base_sha256 string"


def finds(text: str) -> tuple[list[dict], str]:
    """All seeds (with a kind) and tokens (kind -1) of a text, and the digest of the seeds."""
    base = base_spans(text) if _HINT.search(text) else []
    digest = hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
    out = [(a, k, b, 0) for a, k, b in base] + [(a, -1, b, shapes(text[a:b])) for a, b in tokens(text, base)]
    row = lambda a, k, b, s: {"start": a, "kind": k, "end": b, "shapes": s, "value": f"{k}:{text[a:b].lower()}", "patterns": patterns(text, a, b)}
    return [row(*f) for f in out], digest


def mentions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: its seeds and tokens with their patterns."""
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [finds(t.as_py()) for t in b.column(2)]
            cols = [b.column(0), b.column(1), pa.array([f for f, _ in both], pa.list_(_FIND)), pa.array([d for _, d in both], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "doc_id", "finds", "base_sha256"])

    return rows.mapInArrow(run, _FOUND.format(id=rows.schema["doc_id"].dataType.simpleString()))


def graph(found: DataFrame, support: int = SUPPORT) -> DataFrame:
    """pattern, value, kind (-1: a token), shapes: distinct edges of patterns with more than ``support`` values."""
    each = found.select(F.explode("finds").alias("f")).select("f.kind", "f.shapes", "f.value", F.explode("f.patterns").alias("pattern"))
    edges = scratch.table(each.distinct(), "edges")
    wide = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > support)
    return scratch.table(edges.join(wide.select("pattern"), "pattern", "left_semi"), "graph")


def known_patterns(edges: DataFrame, known: DataFrame | None, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """pattern, of (its kind), conf: the patterns that count, given the tokens that are ``known`` (value, of, score)."""
    kind, score = F.col("kind"), F.lit(1.0)
    if known is not None:
        edges = edges.join(known, "value", "left")
        kind, score = F.when(F.col("kind") >= 0, F.col("kind")).otherwise(F.coalesce("of", F.lit(-1))), F.when(F.col("kind") >= 0, 1.0).otherwise(F.col("score"))
    sums = [x for k in range(len(KINDS)) for x in (F.sum(F.when(kind == k, score)).alias(f"s{k}"), F.count(F.when(kind == k, 1)).alias(f"n{k}"))]
    totals = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *sums)
    best = F.array_max(F.array(*[F.struct((F.when(F.col(f"n{k}") >= support, F.col(f"s{k}")).otherwise(0.0) / F.col("n")).alias("conf"), F.lit(-k).alias("k")) for k in range(len(KINDS))]))
    return totals.select("pattern", best.alias("b")).select("pattern", (-F.col("b.k")).alias("of"), F.col("b.conf").alias("conf")).filter(F.col("conf") >= confident)


def known_values(edges: DataFrame, patterns: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """value, of, score: the tokens that the patterns make known."""
    met = edges.filter("kind < 0").join(patterns, "pattern").filter(F.col("shapes").bitwiseAND(F.expr("shiftleft(1, of)")) != 0)
    doubt = F.exp(F.sum(F.log1p(-F.least("conf", F.lit(LARGEST_SCORE)))))
    scored = met.groupBy("value", "of").agg((1 - doubt).alias("score"))
    best = scored.groupBy("value").agg(F.max(F.struct("score", (-F.col("of")).alias("of"))).alias("b"))
    return best.select("value", (-F.col("b.of")).alias("of"), F.col("b.score").alias("score")).filter(F.col("score") >= confident)


def discover(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, finds, base_sha256, added) of every document, and the patterns that count in the end."""
    found = scratch.table(mentions(docs, doc_id, text), "mentions")
    edges, known = graph(found, support), None
    for _ in range(rounds):
        counted = scratch.table(known_patterns(edges, known, support, confident), "patterns")
        known = scratch.table(known_values(edges, counted, confident), "known")
    last = scratch.table(known_patterns(edges, known, support, confident), "patterns")
    token = found.select("key", F.explode(F.filter("finds", lambda f: f["kind"] < 0)).alias("f")).select("key", "f.start", "f.end", "f.shapes", F.explode("f.patterns").alias("pattern"))
    hit = token.join(last, "pattern").filter(F.col("shapes").bitwiseAND(F.expr("shiftleft(1, of)")) != 0)
    span = hit.groupBy("key", "start", "end").agg(F.max(F.struct("conf", (-F.col("of")).alias("of"))).alias("b"))
    span = span.select("key", F.struct("start", (-F.col("b.of")).cast("int").alias("kind"), "end").alias("s"))
    added = span.groupBy("key").agg(F.collect_list("s").alias("added"))  # of one document
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return found.join(added, "key", "left").withColumn("added", F.coalesce("added", empty)).drop("key"), last


def spans_text(spans) -> F.Column:
    """kind:start:end of spans (start, kind, end), in order."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = discover(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.transform(F.filter("finds", lambda f: f["kind"] >= 0), lambda f: F.struct(f["start"].alias("start"), f["kind"].alias("kind"), f["end"].alias("end")))
    count = lambda k: F.size(F.filter("finds", lambda f: f["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(len(KINDS))], "base_sha256", spans_text(F.concat(base, "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


QUERIES = {"op13_pii": op13_pii}
#: Bootstrapping is iterative; a test holds it, and the exact forms, against brute force.
ORACLE_SQL: dict[str, str] = {}
