"""URL filter: rules first, then empirical-Bayes host reputation. DataFrame functions only.

Labelled page outcomes are counted per host before anything is shuffled by host, summed to registered
domains and suffixes, and each level's rate is shrunk towards its parent through a beta prior whose
strength is fitted to that level's overdispersion (beta-binomial moments). A host is blocked when the
lower posterior bound of its bad-page rate passes a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import fresh, store

#: One-sided normal quantile of the posterior bound, and the bad-page rate that the bound has to pass.
Z, THRESHOLD = 1.0, 0.5
#: Second-level labels that are part of the suffix before a country code (co.uk, com.vn).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ? or # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest (verdict, host, path) rule that fits, else null.

    A rule fits its host and all subdomains when the path starts with the rule's path. Equally long
    rules: block wins. The list is a parameter of the call, so it is part of the plan, not a table.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    order = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "block", r[1], r[2]))
    for verdict, rule_host, rule_path in order:
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _below_country(host: Column, second: Sequence[str]) -> Column:
    return host.rlike(rf"(^|\.)({'|'.join(second)})\.[a-z][a-z]\z")


def host_suffix(host: Column, second: Sequence[str] = SECOND_LEVEL) -> Column:
    """The last label; the last two where those of `second` stand before a country code of two letters."""
    return F.when(_below_country(host, second), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def host_domain(host: Column, second: Sequence[str] = SECOND_LEVEL) -> Column:
    """Registered domain: the suffix and the label before it; the host itself where it has no more."""
    return F.when(_below_country(host, second), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _strength(level: DataFrame) -> DataFrame:
    """Pseudo-count of the beta prior of a level (columns n, k, m: pages, bad pages, the parent's mean).

    rho = sum((k - n m)^2 - n m (1 - m)) / sum(n (n - 1) m (1 - m)), held in [0.001, 0.999];
    the pseudo-count is 1 / rho - 1. One row; a level with no spread to learn from gets rho 0.5.
    """
    n, k, m = F.col("n"), F.col("k"), F.col("m")
    over, base = F.sum((k - n * m) * (k - n * m) - n * m * (1 - m)), F.sum(n * (n - 1) * m * (1 - m))
    rho = F.when(base > 0, F.greatest(F.lit(0.001), F.least(F.lit(0.999), over / base))).otherwise(F.lit(0.5))
    return level.agg((1 / rho - 1).alias("strength"))


def reputation(pages: DataFrame, host: str = "host", bad: str = "bad") -> DataFrame:
    """host, n, k, mean, sd: the posterior of each host's bad-page rate.

    `bad` is a nullable boolean: null pages carry no label but make their host known. Empty input gives
    no rows; without any label every host has mean 0.5. Three one-row aggregates (prior strengths) are
    scalar subqueries, so nothing is crossed or collected.
    """
    label = F.col(bad)
    hosts = pages.groupBy(F.col(host).alias("host")).agg(F.count(label).alias("n"), F.count_if(label).alias("k"))
    hosts = store(hosts.select("host", host_domain(F.col("host")).alias("domain"), host_suffix(F.col("host")).alias("suffix"), "n", "k"), "hosts")
    total = hosts.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m")).scalar()
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("m", total)

    def shrink(level: DataFrame) -> DataFrame:
        strength = _strength(level).scalar()
        return level.withColumn("strength", strength).withColumn("post", (F.col("k") + F.col("strength") * F.col("m")) / (F.col("n") + F.col("strength")))

    suffixes = shrink(suffixes)
    domains = shrink(domains.join(suffixes.select("suffix", F.col("post").alias("m")), "suffix"))
    hosts = shrink(hosts.join(domains.select("domain", F.col("post").alias("m")), "domain"))
    mean, size = F.col("post"), F.col("n") + F.col("strength")
    return hosts.select("host", "n", "k", mean.alias("mean"), F.sqrt(mean * (1 - mean) / (size + 1)).alias("sd"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url", z: float = Z, threshold: float = THRESHOLD) -> DataFrame:
    """`pages` with host, path, rule, verdict: the longest fitting rule's verdict, else the host's reputation.

    Pages that a rule decides are the labelled outcomes. Null or odd urls have an empty host, which is
    judged like any other host. Repeated rows are judged alike. Extra columns stay; columns named like
    the new ones are replaced. The host table joins by sort-merge (hot hosts are split by adaptive
    execution) unless Spark has measured it to be small enough to broadcast.
    """
    made = ("host", "path", "rule", "verdict")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in made]
    fit, low = fresh(pages, "_rule", "_bad")
    base = pages.select(*kept, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    base = base.withColumn(fit, rule_column(F.col("host"), F.col("path"), rules))
    labels = base.select("host", (F.col(f"{fit}.verdict") == "block").alias("bad"))
    known = reputation(labels)
    known = store(known.select("host", (F.col("mean") - z * F.col("sd") > threshold).alias(low)), "reputation")
    verdict = F.coalesce(F.col(f"{fit}.verdict"), F.when(F.col(low), "block").otherwise("allow"))
    out = base.join(known, "host", "left").withColumn("rule", F.col(f"{fit}.rule")).withColumn("verdict", verdict)
    return out.select(*kept, *made)
