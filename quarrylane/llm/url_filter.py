"""URL filter: allow and block rules, and gradient-boosted trees on lexical features for the rest.

Features are JVM expressions.  Statistics of host suffixes (how many distinct URLs
there are, and which share of the labelled ones is to be blocked) are exact tables a
suffix, pre-aggregated and joined to the URLs.  A labelled URL's share is counted on
the other folds, so that its label is not in its own features.  Trees are learned by
histograms in numpy from a bounded sample of distinct labelled URLs, of which only
the features reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.shared import ascii_lower, settle

#: Bound of the labelled sample: distinct URLs of each verdict, the first by hash.
MAX_TRAIN_PER_VERDICT = 10_000
#: Folds of labelled URLs for the shares of suffixes.
FOLDS = 5
MAX_RULES = 1000
TREES, DEPTH, BINS, RATE, LEAST_LEAF, SMOOTHING = 60, 4, 64, 0.2, 10, 1.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null without one.

    A rule ``host/path`` fits its host and all subdomains if the path starts with
    the rule's.  Of rules of equal length the one with the longer host wins, then
    the one later by code point.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found.append(
            F.when(fits, F.struct(F.lit(len(rule)).alias("n"), F.lit(len(name)).alias("m"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
        )
    none = F.lit(None).cast("struct<n:int,m:int,rule:string,verdict:string>")
    return F.greatest(none, none, *found)


FEATURES = (
    "length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "parameters", "query_length", "has_fragment",
    "hyphens", "longest_digits", "https", "upper_ratio", "other_ratio", "last_segment", "suffix_log_count", "domain_log_count", "suffix_rate", "domain_rate",
)


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    """The features of a URL that need no statistics, in the order of ``FEATURES``."""
    n = F.greatest(F.char_length(url), F.lit(1))
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))
    without_fragment = F.substring_index(url, "#", 1)
    query = F.when(F.instr(without_fragment, "?") > 0, F.expr("substr(_plain, instr(_plain, '?') + 1)")).otherwise("")
    times = lambda c: (F.char_length(url) - F.char_length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(F.array_distinct(F.split(url, "")), lambda c: c != ""), F.lit(0.0), lambda total, c: total - times(c) * F.log2(times(c)))
    runs = F.transform(F.regexp_extract_all(url, F.lit("[0-9]+"), F.lit(0)), F.char_length)
    return [
        F.char_length(url), F.char_length(host), F.char_length(path), count(path, "/"), count(host, r"\.") + 1, count(url, "[0-9]") / n, entropy,
        count(query, "[=&]"), F.char_length(query), F.contains(url, F.lit("#")).cast("int"), count(url, "[-_]"), F.coalesce(F.array_max(runs), F.lit(0)),
        F.startswith(url, F.lit("https:")).cast("int"), count(url, "[A-Z]") / n, count(url, "[^\\x00-\\x7E]|%") / n, F.char_length(F.substring_index(path, "/", -1)),
    ]


@dataclass(frozen=True)
class Tree:
    """A complete binary tree of ``DEPTH`` levels: a feature and a threshold a node (go left at or under it), a value a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            right = x[np.arange(len(x)), self.feature[node]] > self.threshold[node]
            node = 2 * node + 1 + right
        return self.value[node - len(self.feature)]


@dataclass(frozen=True)
class UrlModel:
    """Boosted trees over rows of ``FEATURES``."""

    base: float
    trees: list[Tree]

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Probability that the URL is to be blocked."""
        total = np.full(len(x), self.base)
        for tree in self.trees:
            total += RATE * tree.predict(x)
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list[Tree]]:
    """Newton boosting of the logistic loss with histogram splits; the same rows give the same trees."""
    if not len(y) or y.min() == y.max():
        return (0.0 if not len(y) else (4.0 if y[0] else -4.0)), []
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T)], 1)
    base = math.log(y.mean() / (1 - y.mean()))
    total, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = p - y, p * (1 - p)
        feature, threshold = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            width, start = 2**level, 2**level - 1
            place = node - start
            best, split = np.zeros(width), [(0, -1)] * width
            for j in range(x.shape[1]):
                cell = place * BINS + binned[:, j]
                sums = [np.cumsum(np.bincount(cell, w, width * BINS).reshape(width, BINS), 1) for w in (gradient, hessian, np.ones(len(y)))]
                (gl, hl, nl), (g, h, n) = sums, (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + SMOOTHING) + (g - gl) ** 2 / (h - hl + SMOOTHING) - g**2 / (h + SMOOTHING)
                gain[(nl < LEAST_LEAF) | (n - nl < LEAST_LEAF)] = 0
                at = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(width), at] > best + 1e-9):
                    best[k], split[k] = gain[k, at[k]], (j, int(at[k]))
            right = np.zeros(len(y), bool)
            for k, (j, cut) in enumerate(split):
                if cut >= 0 and cut < len(cuts[j]):
                    feature[start + k], threshold[start + k] = j, cuts[j][cut]
                    mine = place == k
                    right[mine] = binned[mine, j] > cut
            node = 2 * node + 1 + right
        leaf = node - (2**DEPTH - 1)
        value = -np.bincount(leaf, gradient, 2**DEPTH) / (np.bincount(leaf, hessian, 2**DEPTH) + SMOOTHING)
        trees.append(Tree(feature, threshold, value))
        total += RATE * value[leaf]
    return base, trees


def parsed(pages: DataFrame, url_column: str) -> DataFrame:
    """``pages`` with working columns for the URL, its host, path, suffixes and fold."""
    url = F.col(f"`{url_column}`")
    parts = pages.withColumns({"_url": F.coalesce(url, F.lit("")), "_host": host_of(url), "_path": path_of(url)})
    return parts.withColumns(
        {
            "_one": F.substring_index("_host", ".", -1), "_two": F.substring_index("_host", ".", -2),
            "_fold": F.pmod(F.xxhash64(F.lit("fold"), "_url"), F.lit(FOLDS)).cast("int"), "_plain": F.substring_index("_url", "#", 1),
        }
    )


def with_features(urls: DataFrame) -> DataFrame:
    """Parsed rows with ``_blocked`` (1, 0 or null: not labelled) and ``_x``, their features.

    Suffix statistics count distinct URLs of all rows, so copies of one URL weigh
    once.  The share of a labelled URL leaves its fold out.  The tables have a row a
    suffix; a suffix of many URLs is pre-aggregated before it is shuffled, and the
    joins back are plain ones, whose skewed partitions adaptive execution splits.
    """
    distinct = urls.groupBy("_url", "_one", "_two", "_fold").agg(F.max("_blocked").alias("_blocked"))
    counts = {"n": F.count("*")} | {
        f"{name}{i}": F.sum(F.when(F.col("_fold") == i, value).otherwise(0))
        for name, value in (("labelled", F.col("_blocked").isNotNull().cast("int")), ("blocked", F.coalesce("_blocked", F.lit(0))))
        for i in range(FOLDS)
    }
    both = distinct.withColumn("of", F.explode(F.array(F.struct(F.lit(1).alias("k"), F.col("_one").alias("s")), F.struct(F.lit(2).alias("k"), F.col("_two").alias("s")))))
    table = settle(both.groupBy("of.k", "of.s").agg(*[c.alias(n) for n, c in counts.items()]))
    rates, joined = [], urls
    for k, column in ((1, "_one"), (2, "_two")):
        of = table.where(F.col("k") == k).select(F.col("s").alias(f"_s{k}"), F.struct(*counts).alias(f"_stats{k}"))
        joined = joined.join(of, F.col(column) == F.col(f"_s{k}"))
        total = lambda name: sum(
            (F.when(F.col("_blocked").isNotNull() & (F.col("_fold") == i), 0).otherwise(F.col(f"_stats{k}.{name}{i}")) for i in range(FOLDS)), F.lit(0)  # noqa: B023
        )
        rates.append((F.log1p(F.col(f"_stats{k}.n").cast("double")), (total("blocked") + 1) / (total("labelled") + 2)))
    plain = lexical(F.col("_url"), F.col("_host"), F.col("_path"))
    values = [*plain, *(r[0] for r in rates), *(r[1] for r in rates)]
    return joined.withColumn("_x", F.array(*[v.cast("double") for v in values])).drop("_s1", "_s2", "_stats1", "_stats2")


def fit(urls: DataFrame, per_verdict: int = MAX_TRAIN_PER_VERDICT) -> UrlModel:
    """Learns from rows ``with_features``, of which ``_blocked`` is the label where there is one.

    The trees learn from at most ``per_verdict`` distinct URLs of each verdict, the
    first by hash; copies of a URL are one.  Without labels of both kinds there are
    no trees and the prior decides.
    """
    kinds = urls.agg(*[F.approx_count_distinct(F.when(F.col("_blocked") == v, F.col("_url")), 0.02).alias(f"n{v}") for v in (0, 1)]).first()
    x, y = [], []
    for verdict in (0, 1):
        of = urls.where(F.col("_blocked") == verdict).select(F.xxhash64("_url").alias("h"), "_x")
        share = min(1.0, 2 * per_verdict / max(kinds[f"n{verdict}"], 1))
        # Only URLs under the threshold are told apart and compete.
        within = of if share >= 1 else of.where(F.col("h") < -(1 << 63) + int((1 << 64) * share))
        found = within.groupBy("h").agg(F.min("_x").alias("x")).orderBy("h").limit(per_verdict).collect()
        x += [r["x"] for r in found]
        y += [float(verdict)] * len(found)
    return UrlModel(*boost(np.array(x, float).reshape(-1, len(FEATURES)), np.array(y)))


def judge(pages: DataFrame, rules: list[tuple[str, str]], url_column: str = "url", per_verdict: int = MAX_TRAIN_PER_VERDICT, threshold: float = 0.5) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``block_probability`` added.

    The longest rule that fits decides; the trees, learned from the URLs that rules
    label, decide the rest.  A null URL, or one without ``://``, has an empty host
    and path, fits no rule and is decided by the trees.  Very long URLs are judged
    whole.  All rows stay, repeated ones too, with equal verdicts for equal URLs;
    columns named like the added ones are replaced; an empty table stays empty.
    """
    given = pages.drop("host", "path", "rule", "verdict", "block_probability")
    work = parsed(given, url_column)
    work = work.withColumn("_fit", match_rules(F.col("_host"), F.col("_path"), rules))
    work = with_features(work.withColumn("_blocked", F.when(F.col("_fit").isNotNull(), (F.col("_fit.verdict") == "block").cast("int"))))
    shared = pages.sparkSession.sparkContext.broadcast(fit(work, per_verdict))

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(shared.value.probability(np.array(x.tolist(), float).reshape(-1, len(FEATURES))), dtype=float)

    work = work.withColumn("block_probability", probability("_x"))
    by_trees = F.when(F.col("block_probability") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return work.select(
        *[F.col(f"`{c}`") for c in given.columns],
        F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_fit.rule").alias("rule"),
        F.coalesce(F.col("_fit.verdict"), by_trees).alias("verdict"), "block_probability",
    )
