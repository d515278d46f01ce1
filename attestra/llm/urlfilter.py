"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for all other URLs.

A rule such as `example.org/es/` fits its host and all its subdomains where the
URL's path starts with the rule's; of all that fit the longest wins. URLs that no
rule fits are judged by boosted trees (logistic loss, histogram splits, in
numpy) on lengths, path depth, shares of digits, letters and signs, entropies, counts of
parameters and labels, and suffix statistics: the smoothed share of blocked URLs among
those of the same public suffix and of the same registered name's length. Trees are trained on
labelled URLs: in op2 those that a rule decides, at most MAX_ROWS of them in the order of
a hash of the URL, each URL once.

Cases: a null URL and one without :// have an empty host and path, fit no rule and are judged
by their features all the same; without labels of both classes the verdict is
the one class known, or allow; repeated rows are judged alike; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import split_for, tune

#: Rules of op2: (verdict, host and path).
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
MAX_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST = 60, 3, 0.2, 32, 5


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):
        name, slash, rest = r.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


FEATURES = 24


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def lexical(url: str | None) -> tuple[list[float], str, int]:
    """Features without suffix statistics; suffix; length of the registered name."""
    url = url or ""
    rest = url.partition("://")[2]
    host, path, query = re.match(r"([^/?#]*)([^?#]*)(.*)", rest, re.S).groups()
    host = host.lower()
    labels = [x for x in host.split(".") if x]
    suffix = ".".join(labels[-2:]) if len(labels) > 1 else host
    name = labels[-3] if len(labels) > 2 else labels[0] if labels else ""
    segments = [x for x in path.split("/") if x]
    n = max(1, len(url))
    digits = lambda s: sum(c.isdigit() for c in s)
    vowels = sum(c in "aeiou" for c in name)
    numbers = digits(query)
    return (
        [
            len(url), len(host), len(path), len(query), len(segments), digits(url) / n, digits(host) / max(1, len(host)), digits(path) / max(1, len(path)),
            entropy(url), entropy(host), entropy(path), query.count("="), query.count("&"), len(labels), host.count("-"), path.count("-") + path.count("_"),
            max(map(len, segments), default=0), len(name), vowels / max(1, len(name)), sum(not c.isalnum() for c in url) / n, url.startswith("https"), numbers / max(1, len(query)),
        ],
        suffix,
        len(name),
    )


#: Folds by which training rows get the shares of their suffix and names.
FOLDS = 5


@dataclass
class Trees:
    """Boosted trees of one depth, each as arrays of split features, thresholds and leaf values."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    suffixes: dict[str, float] = field(default_factory=dict)
    names: dict[int, float] = field(default_factory=dict)
    prior: float = 0.5

    def features(self, urls: list[str | None]) -> np.ndarray:
        out = np.empty((len(urls), FEATURES))
        for i, u in enumerate(urls):
            x, suffix, n = lexical(u)
            out[i] = [*x, self.suffixes.get(suffix, self.prior), self.names.get(n, self.prior)]
        return out

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1).astype(np.int16)

    def raw(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.base)
        rows = np.arange(len(b))
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(b), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out

    def score(self, urls: list[str | None]) -> np.ndarray:
        """The probability that the URL is to be blocked."""
        if not self.trees:
            return np.full(len(urls), 1 / (1 + math.exp(-self.base)))
        return 1 / (1 + np.exp(-self.raw(self.binned(self.features(urls)))))


def fit(urls: list[str | None], blocked: list[int]) -> Trees:
    y = np.array(blocked, float)
    if not len(y) or y.min() == y.max():
        return Trees(base=30.0 if len(y) and y[0] else -30.0)
    model = Trees(prior=float(y.mean()))
    keys = [lexical(u)[1:] for u in urls]

    def shares(rows: range | list[int], which: int) -> dict:
        """Share of blocked URLs by suffix or by number of names, drawn to the prior."""
        seen: dict = {}
        for i in rows:
            a = seen.setdefault(keys[i][which], [0, 0])
            a[0] += blocked[i]
            a[1] += 1
        return {k: (a + 10 * model.prior) / (n + 10) for k, (a, n) in seen.items()}

    model.suffixes, model.names = (shares(range(len(urls)), w) for w in (0, 1))
    x = model.features(urls)
    # a row's own label must not stand in what it is trained on: its shares are those of the other folds
    for k in range(FOLDS):
        own, rest = range(k, len(urls), FOLDS), [i for i in range(len(urls)) if i % FOLDS != k]
        for w in (0, 1):
            of = shares(rest, w)
            for i in own:
                x[i, FEATURES - 2 + w] = of.get(keys[i][w], model.prior)
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(FEATURES)]
    b = model.binned(x)
    model.base = math.log(y.mean() / (1 - y.mean()))
    raw = np.full(len(y), model.base)
    flat = b.astype(np.int64) + np.arange(FEATURES) * BINS
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first = 2**level - 1
            for node in range(first, 2 * first + 1):
                own = at == node
                if own.sum() >= 2 * LEAST:
                    f = flat[own].ravel()
                    sums = [np.bincount(f, np.repeat(w[own], FEATURES), FEATURES * BINS).reshape(FEATURES, BINS) for w in (g, h, np.ones(len(y)))]
                    left = [s.cumsum(1) for s in sums]
                    G, H, N = g[own].sum(), h[own].sum(), own.sum()
                    gain = left[0] ** 2 / (left[1] + 1) + (G - left[0]) ** 2 / (H - left[1] + 1) - G * G / (H + 1)
                    gain[(left[2] < LEAST) | (N - left[2] < LEAST)] = -1
                    k = int(np.argmax(gain))
                    if gain.flat[k] > 1e-6:
                        feature[node], cut[node] = divmod(k, BINS)
            at = 2 * at + 1 + (b[np.arange(len(b)), feature[at]] > cut[at])
        leaf = at - inner
        values = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        raw += values[leaf]
        model.trees.append((feature, cut, values))
    return model


def train(labelled: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    """From url and blocked (0 or 1): each URL once, at most max_rows, in the order of a hash."""
    rows = labelled.where("url is not null and blocked is not null").groupBy("url").agg(F.max("blocked").alias("blocked"))
    got = rows.orderBy(F.xxhash64("url"), "url").limit(max_rows).collect()
    return fit([r["url"] for r in got], [r["blocked"] for r in got])


def score(pages: DataFrame, model: Trees, column: str = "block_score") -> DataFrame:
    """pages with the probability that their url is to be blocked, in a column named `column` (with underscores behind it where pages has that name)."""
    column = split_for(pages, column)
    tune(pages.sparkSession)
    shipped = pages.sparkSession.sparkContext.broadcast(model)  # trees of fixed size
    at = pages.columns.index("url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shipped.value.score(b.column(at).to_pylist()), pa.float64())], names=[*b.schema.names, column])

    return pages.mapInArrow(run, StructType([*pages.schema.fields, StructField(column, DoubleType())]))


def judged(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, url, host, path, rule, ruled (the rule's verdict)."""
    host, path = host_path(F.col("url"))
    p = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return p.withColumn("rule", rule).withColumn("ruled", verdict)


def op2_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
    model = train(pages.where("ruled is not null").select("url", (F.col("ruled") == "block").cast("int").alias("blocked")))
    out = score(pages, model)
    verdict = F.coalesce("ruled", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")
