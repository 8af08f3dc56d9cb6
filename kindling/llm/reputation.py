"""URL filters with DataFrame functions only: allow and block rules, then empirical-Bayes host reputation.

Labelled outcomes of pages (good or not) are counted per host, registered domain and suffix. Each level is a
beta-binomial: its prior has the posterior mean of the level above and a strength that the method of moments takes
from the spread of the units' rates. A host is blocked if even the upper posterior bound of its good share is low.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1000.0
#: suffixes of more than one label under which domains are registered (a parameter; one label is the default)
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z in lower case; empty without "://" or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to "?", "#" or the end; empty without "://" or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_document(url: Column) -> Column:
    """The number that the second part of the path is, up to an extension: 7817 of /en/7817, /en/7817/ and
    /en/7817.html; null for any other path."""
    return F.regexp_extract(url_path(url), r"^/[^/]+/([0-9]{1,18})(\.[A-Za-z]+)?/?\z", 1).try_cast("long")


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does.

    A rule "host/path" fits its host and all subdomains if the path starts with "/path". The rule list is part of the
    query (a few entries); of equally long rules that fit, the first in the list counts.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(reversed(rules), key=lambda r: len(r[0])):  # later ones win
        h, _, rest = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def suffix_and_domain(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> tuple[Column, Column]:
    """Public suffix (the last label, or a listed longer one) and registered domain (one label more)."""
    two = F.substring_index(host, ".", -2)
    long_ = two.isin(list(long_suffixes))
    return (F.when(long_, two).otherwise(F.substring_index(host, ".", -1)),
            F.when(long_, F.substring_index(host, ".", -3)).otherwise(two))


def _strength(units: DataFrame) -> float:
    """The strength of the prior of a level, by the method of moments from its units' n, good and prior mean.

    The n-weighted spread of the rates has the mean of sum mu (1 - mu) (1 + (n - 1) / (strength + 1)). Three sums of
    the level are all that reaches the driver.
    """
    mu = F.col("prior")
    s, w, v = units.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - mu, 2)), F.sum(mu * (1 - mu)),
        F.sum(F.col("n") * mu * (1 - mu))).first()
    if s is None or v <= w or s <= w:
        return MAX_STRENGTH
    return min(MAX_STRENGTH, max(MIN_STRENGTH, (v - w) / (s - w) - 1))


def host_reputation(outcomes: DataFrame, hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, n, good, reputation, upper) for every host of ``hosts``.

    ``outcomes`` has host, n and good: labelled pages and good ones per host. Hosts without outcomes inherit their
    domain's posterior mean, domains their suffix's, suffixes the overall rate (0.5 if there are no outcomes).
    ``upper`` is the posterior mean plus z posterior standard deviations.
    """
    suffix, domain = suffix_and_domain(F.col("host"))
    units = hosts.select("host").distinct().withColumns({"suffix": suffix, "domain": domain}).join(outcomes, "host", "left")
    units = units.fillna(0, ["n", "good"])
    n, good = units.agg(F.sum("n"), F.sum("good")).first()
    overall = ((good or 0) + 1) / ((n or 0) + 2)

    def shrink(level: DataFrame) -> DataFrame:
        """Posterior mean and prior strength of each unit, given its ``prior``."""
        return level.withColumn("k", F.lit(_strength(level))).withColumn(
            "mean", (F.col("k") * F.col("prior") + F.col("good")) / (F.col("k") + F.col("n")))

    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    s = shrink(units.groupBy("suffix").agg(*sums).withColumn("prior", F.lit(overall)))
    d = shrink(units.groupBy("domain", "suffix").agg(*sums).join(s.select("suffix", F.col("mean").alias("prior")), "suffix"))
    h = shrink(units.select("host", "domain", "n", "good").join(d.select("domain", F.col("mean").alias("prior")), "domain"))
    total = F.col("k") + F.col("n")
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (total + 1))
    return h.select("host", "n", "good", F.col("mean").alias("reputation"), (F.col("mean") + z * sd).alias("upper"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id",
                url_col: str = "url", good_col: str = "good", min_good: float = 0.5, by: Column | None = None,
                by_col: str | None = None) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, reputation, upper.

    ``outcomes`` has the page id and a label (1 good, 0 not; others and nulls are left out; a page with several labels
    counts each); labels of something else are matched by ``by``, a column of ``pages``, and their ``by_col``, and a page
    where ``by`` is null has no outcome. The verdict is the longest fitting rule's, else "block" if the host's upper bound is below
    ``min_good``, else "allow". Pages without a host (null or malformed urls) share the empty host. Pages are counted
    per host before anything is joined by host. An empty table gives an empty result.
    """
    p = pages.select(pages[id_col].alias("id"), url_host(pages[url_col]).alias("host"), url_path(pages[url_col]).alias("path"),
                     (pages[id_col] if by is None else by).alias("by"))
    good = outcomes.select(outcomes[by_col or id_col].alias("by"), outcomes[good_col].cast("int").alias("good")).where("good in (0, 1)")
    seen = p.join(good, "by").groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    known = host_reputation(seen, p)
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    out = p.join(known.select("host", "reputation", "upper"), "host")
    return out.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"),
                      F.coalesce(verdict, F.when(F.col("upper") < min_good, "block").otherwise("allow")).alias("verdict"),
                      "reputation", "upper")
