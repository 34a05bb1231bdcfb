"""URL filter: rules by host and path, boosted trees on lexical features for the rest.

A rule decides a URL whose host is the rule's or one below it and whose path
starts with the rule's; the longest fitting rule wins.  URLs that no rule
decides get their verdict from gradient-boosted trees over length, depth,
digit ratio, entropy, parameter counts and statistics of the host's suffixes.

The trees learn from labelled URLs only: those that a rule decides.  Of each
label at most ``TRAIN_ROWS`` are taken, those with the smallest hash (equal URLs
in any order, as they have equal features), each with the weight of the rows it
stands for.  Everything runs in DataFrame functions and the JVM's tree learner;
scoring is a projection.

Suffix statistics are the smoothed shares of blocked URLs among all labelled
ones with the same last, or last two, labels of the host.  Hosts are dealt into
``FOLDS`` folds by hash, and a labelled URL gets the shares that the other
folds give, so no URL and no host helps to explain its own label.  ``report``
measures the trees on hosts that they have not seen.  The shares are joined by
suffix, broadcast while there are at most ``BROADCAST_SUFFIXES``.

Defined cases: a null URL or one without ``://`` has empty host and path and
is judged by the trees like any other; where the rules give labels of one kind
only nothing can be learned, and undecided URLs are allowed; a URL of any
length is read whole; repeated rows and null ids get a row each; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
FOLDS = 5
TRAIN_ROWS = 4000
SMOOTH = 20.0
BROADCAST_SUFFIXES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEXICAL = (
    "n_chars", "n_host", "n_path", "depth", "labels", "hyphens", "digit_share", "host_digits", "entropy", "host_entropy",
    "parameters", "n_query",
)
FEATURES = (*LEXICAL, "share1", "share2")


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    get = lambda i: F.coalesce(F.regexp_extract(F.col(url), parts, i), F.lit(""))
    return pages.withColumn("host", F.translate(get(1), UPPER, LOWER)).withColumn("path", get(2))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """``rule`` and its ``verdict`` for rows with host and path, null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        host, slash, path = text.partition("/")
        dotted = F.concat(F.lit("."), F.col("host"))
        fits = dotted.endswith("." + host) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("by_rule", verdict)


def entropy(text) -> F.Column:
    """Bits per character."""
    n = F.char_length(text).cast("double")
    share = lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n
    return F.when(n == 0, 0.0).otherwise(
        F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda acc, c: F.when(c == "", acc).otherwise(acc - share(c) * F.log2(share(c))))
    )


def with_lexical(pages: DataFrame, url: str = "url") -> DataFrame:
    text = F.coalesce(F.col(url), F.lit(""))
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    values = {
        "n_chars": F.char_length(text).cast("double"),
        "n_host": F.char_length(host).cast("double"),
        "n_path": F.char_length(path).cast("double"),
        "depth": count(path, "/"),
        "labels": count(host, r"\.") + 1,
        "hyphens": count(host, "-"),
        "digit_share": count(text, "[0-9]") / F.greatest(F.char_length(text), F.lit(1)),
        "host_digits": count(host, "[0-9]"),
        "entropy": entropy(text),
        "host_entropy": entropy(host),
        "parameters": count(query, "[^&=]+=") + 0.0,
        "n_query": F.char_length(query).cast("double"),
    }
    out = pages.withColumns(values)
    return out.withColumn("suffix1", F.substring_index("host", ".", -1)).withColumn("suffix2", F.substring_index("host", ".", -2))


def with_fold(urls: DataFrame) -> DataFrame:
    return urls.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"))


def suffix_counts(labelled: DataFrame, suffix: str) -> DataFrame:
    """Per suffix the blocked and all labelled URLs, by fold."""
    blocked = (F.col("by_rule") == "block").cast("long")
    of = lambda value: F.array(*[F.sum(F.when(F.col("fold") == i, value).otherwise(0)) for i in range(FOLDS)])
    return labelled.groupBy(F.col(suffix).alias(f"_{suffix}")).agg(of(blocked).alias(f"_{suffix}_b"), of(F.lit(1)).alias(f"_{suffix}_n"))


def with_shares(urls: DataFrame, tables: dict[str, DataFrame], prior: float, without: int | None = None) -> DataFrame:
    """``share1`` and ``share2``: of all folds but a labelled URL's own one, and but ``without``."""
    for suffix, table in tables.items():
        side = F.broadcast(table) if table.count() <= BROADCAST_SUFFIXES else table
        urls = urls.join(side, F.col(suffix) == F.col(f"_{suffix}"), "left")
        used = lambda i: (F.lit(i) != F.lit(without)) & (F.col("by_rule").isNull() | (F.col("fold") != i)) if without is not None else F.col("by_rule").isNull() | (F.col("fold") != i)
        total = lambda c: sum(F.when(used(i), F.coalesce(F.col(c)[i], F.lit(0))).otherwise(0) for i in range(FOLDS))
        share = (total(f"_{suffix}_b") + prior * SMOOTH) / (total(f"_{suffix}_n") + SMOOTH)
        urls = urls.withColumn(suffix.replace("suffix", "share"), share).drop(f"_{suffix}", f"_{suffix}_b", f"_{suffix}_n")
    return urls


def train(labelled: DataFrame) -> GBTClassificationModel:
    """``labelled``: FEATURES, label (1 to block) and weight."""
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled).select("features", "label", "weight")
    return GBTClassifier(weightCol="weight", maxIter=10, maxDepth=3, minInstancesPerNode=5, stepSize=0.3, maxBins=64, seed=7).fit(data)


class Learned:
    """The trees and the suffix counts of a table of URLs; ``model`` is None where nothing can be learned.

    ``without``: a fold whose hosts are left out.
    """

    def __init__(self, urls: DataFrame, without: int | None = None):
        labelled = urls.filter("by_rule is not null" if without is None else f"by_rule is not null and fold <> {without}")
        counts = dict(labelled.groupBy("by_rule").count().collect())
        self.model, self.without = None, without
        if len(counts) < 2:
            return
        self.prior = counts["block"] / sum(counts.values())
        self.tables = {s: scratch.table(suffix_counts(labelled, s), s) for s in ("suffix1", "suffix2")}
        taken = None
        for verdict, n in counts.items():
            # a sampled row stands for its share of all rows of its kind
            rows = labelled.filter(F.col("by_rule") == verdict).orderBy(F.xxhash64("_url")).limit(TRAIN_ROWS)
            rows = rows.withColumn("label", F.lit(float(verdict == "block"))).withColumn("weight", F.lit(max(1.0, n / TRAIN_ROWS)))
            taken = rows if taken is None else taken.unionByName(rows)
        taken = with_shares(taken, self.tables, self.prior, without).select(*FEATURES, "label", "weight")
        self.model = train(scratch.table(taken.coalesce(2), "training"))

    def blocks(self, urls: DataFrame) -> DataFrame:
        """``urls`` with a boolean ``trees_block``."""
        if self.model is None:
            return urls.withColumn("trees_block", F.lit(False))
        scored = with_shares(urls, self.tables, self.prior, self.without)
        scored = self.model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(scored))
        return scored.select(*urls.columns, (F.col("prediction") == 1.0).alias("trees_block"))


def prepared(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """``pages`` in a struct ``page``, with host, path, rule, its verdict, features and fold."""
    own = pages.select(F.struct(*[F.col(c) for c in pages.columns]).alias("page"), F.col(url).alias("_url"))
    return with_fold(with_lexical(with_rule(with_parts(own, "_url"), rules), "_url"))


def judge(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """``pages`` in a struct ``page``, with host, path, rule, verdict and trees_block (what the trees say)."""
    urls = prepared(pages, rules, url)
    learned = Learned(scratch.table(urls.drop("page", "path", "rule"), "urls"))
    guess = F.when(F.col("trees_block"), "block").otherwise("allow")
    return learned.blocks(urls).select("page", "host", "path", "rule", F.coalesce("by_rule", guess).alias("verdict"), "trees_block")


def report(pages: DataFrame, rules=RULES, url: str = "url", fold: int = 0) -> dict[str, float]:
    """Precision and recall of blocking, and the share judged right, on labelled URLs of hosts of a fold that was left out of training."""
    urls = scratch.table(prepared(pages, rules, url).drop("page", "path", "rule"), "urls")
    seen = Learned(urls, fold).blocks(urls.filter(f"by_rule is not null and fold = {fold}"))
    bad, hit = F.col("by_rule") == "block", F.col("trees_block")
    n, n_bad, n_hit, both = seen.agg(F.count(F.lit(1)), F.count_if(bad), F.count_if(hit), F.count_if(bad & hit)).first()
    return {"urls": n, "precision": both / max(1, n_hit), "recall": both / max(1, n_bad), "right": (n - n_bad - n_hit + 2 * both) / max(1, n)}


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return out.select("page.page_id", "host", "path", "rule", "verdict")


QUERIES = {"op7_url_filter": op7_url_filter}
ORACLE_SQL: dict[str, str] = {}
