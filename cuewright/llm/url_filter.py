"""URL verdicts: listed rules first, gradient-boosted trees for the rest.

A rule is a host and the beginning of a path. It fits its host and all
subdomains; the longest fitting rule decides. URLs that no rule fits are judged
by Spark ML's gradient-boosted trees on lexical features: length, depth, digit
ratio, entropy, parameter counts, host shape, and smoothed statistics of the
host's suffixes and of the first path segment among the labelled URLs.

The trees are fitted on at most ``SAMPLE`` labelled URLs, drawn by a hash of the
URL; the suffix statistics cover all labelled URLs. Without two labels the share
of blocked ones decides; without any label such a URL is allowed.

A null URL or one without ``://`` has an empty host and path and fits no rule.
Repeated rows are judged alike. An empty table gives an empty result. Extra
columns pass through; columns with the results' names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

#: Production parameters: bound of the fitted sample, trees, depth, prior rows of a suffix statistic.
SAMPLE = 20_000
TREES = 20
DEPTH = 4
PRIOR = 20.0

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RESULTS = ("host", "path", "rule", "verdict", "block_probability")
#: Keys of the smoothed statistics.
SUFFIXES = ("suffix1", "suffix2", "segment")
NUMBERS = (
    "f_length", "f_depth", "f_digits", "f_entropy", "f_parameters", "f_query", "f_labels", "f_host", "f_hyphens", "f_secure", "f_fragment",
    *[f"f_{s}_{k}" for s in SUFFIXES for k in ("rate", "seen")],
)


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    whole = F.coalesce(F.col(url), F.lit(""))
    return df.withColumn("host", F.translate(F.regexp_extract(whole, PARTS, 1), UPPER, LOWER)).withColumn("path", F.regexp_extract(whole, PARTS, 2))


def fits(rule: UrlRule) -> Column:
    host = F.concat(F.lit("."), F.col("host"))
    return host.endswith("." + rule.host) & F.col("path").startswith(rule.path)


def apply_rules(df: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """Adds rule and its verdict; null where none fits. The list is written into the plan, so it must be short."""
    found, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        found, verdict = found.when(fits(rule), F.lit(rule.text)), verdict.when(fits(rule), F.lit(rule.verdict))
    return df.withColumn("rule", found).withColumn("verdict", verdict)


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features and the keys of the suffix statistics; needs host and path."""
    whole = F.coalesce(F.col(url), F.lit(""))
    size = F.length(whole)
    labels = F.split("host", r"\.")
    query = F.regexp_extract(whole, r"\?([^#]*)", 1)
    out = df.withColumn("_signs", F.array_distinct(F.split(whole, "")))
    share = lambda c: (size - F.length(F.replace(whole, c, F.lit("")))) / F.greatest(size, F.lit(1))
    entropy = F.aggregate(
        F.transform(F.filter("_signs", lambda c: c != ""), share), F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    )
    return out.withColumns(
        {
            "f_length": size.cast("double"),
            "f_depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
            "f_digits": F.regexp_count(whole, F.lit("[0-9]")) / F.greatest(size, F.lit(1)),
            "f_entropy": entropy,
            "f_parameters": F.regexp_count(query, F.lit("[^&]+")).cast("double"),
            "f_query": F.length(query).cast("double"),
            "f_labels": F.size(labels).cast("double"),
            "f_host": F.length("host").cast("double"),
            "f_hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
            "f_secure": F.lower(F.substring(whole, 1, 6)).eqNullSafe("https:").cast("double"),
            "f_fragment": whole.contains("#").cast("double"),
            "suffix1": F.substring_index("host", ".", -1),
            "suffix2": F.substring_index("host", ".", -2),
            "segment": F.regexp_extract("path", "^/([^/]*)/", 1),
        }
    ).drop("_signs")


def suffix_statistics(labelled: DataFrame, key: str, prior: float) -> DataFrame:
    """Smoothed share of blocked URLs and log count per suffix."""
    return labelled.groupBy(key).agg(
        ((F.sum("label") + PRIOR * F.lit(prior)) / (F.count(F.lit(1)) + PRIOR)).alias(f"f_{key}_rate"), F.log1p(F.count(F.lit(1)).cast("double")).alias(f"f_{key}_seen")
    )


def with_statistics(df: DataFrame, statistics: dict[str, DataFrame], prior: float) -> DataFrame:
    for key, table in statistics.items():
        df = df.join(table, key, "left").fillna({f"f_{key}_rate": prior, f"f_{key}_seen": 0.0})
    return df


class UrlModel:
    """Suffix statistics and boosted trees of labelled URLs."""

    def __init__(self, labelled: DataFrame, url: str = "url", sample: int = SAMPLE):
        """``labelled`` has the URL and ``label``, 1.0 for URLs to block."""
        rows = lexical(split_url(labelled.where(F.col("label").isNotNull()).select(F.col(url).alias("url"), F.col("label").cast("double")))).drop("path")
        rows = stored(rows, "labelled-urls")
        total, blocked = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
        self.prior = (blocked / total) if total else 0.0
        self.statistics = {k: suffix_statistics(rows, k, self.prior) for k in SUFFIXES}
        self.trees = None
        if total and 0 < blocked < total:
            drawn = rows.orderBy(F.xxhash64("url"), "url", "label").limit(sample)
            ready = stored(assembled(with_statistics(drawn, self.statistics, self.prior)).select("features", "label"), "drawn-urls")
            self.trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=11, cacheNodeIds=False).fit(ready)

    def judge(self, df: DataFrame, url: str = "url") -> DataFrame:
        """Adds block_probability; needs host and path."""
        if self.trees is None:
            return df.withColumn("block_probability", F.lit(self.prior))
        rows = assembled(with_statistics(lexical(df, url), self.statistics, self.prior))
        judged = self.trees.transform(rows)
        return judged.withColumn("block_probability", vector_to_array("probability")[1]).select(*df.columns, "block_probability")


def assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(NUMBERS), outputCol="features").transform(df)


def filter_urls(df: DataFrame, rules: list[UrlRule], labelled: DataFrame | None = None, url: str = "url", sample: int = SAMPLE) -> DataFrame:
    """Adds host, path, rule, verdict and block_probability (null where a rule decided).

    ``labelled`` (url, label) defaults to the rows that a rule decides.
    """
    rows = apply_rules(split_url(df.drop(*RESULTS), url), rules)
    if labelled is None:
        decided = rows.where(F.col("rule").isNotNull())
        labelled = decided.select(F.col(url).alias("url"), (F.col("verdict") == BLOCK).cast("double").alias("label"))
        model = UrlModel(labelled, "url", sample)
    else:
        model = UrlModel(labelled, url, sample)
    judged = model.judge(rows.where(F.col("rule").isNull()), url)
    by_tree = judged.withColumn("verdict", F.when(F.col("block_probability") >= 0.5, BLOCK).otherwise(ALLOW))
    by_rule = rows.where(F.col("rule").isNotNull()).withColumn("block_probability", F.lit(None).cast("double"))
    return by_rule.unionByName(by_tree)
