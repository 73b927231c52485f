"""URL filter by rules and by empirical-Bayes host reputation, in DataFrame operations only.

Labelled page outcomes (1 good, 0 bad) are summed by host, registered domain and suffix. Each level's rate is drawn
towards its parent's posterior mean with a beta-binomial prior, whose strength is the moment estimate over all units
of that level. A host's verdict is its posterior mean less `z` posterior deviations, held against `threshold`.

Null or malformed urls have empty host and path and are judged by the overall rate; a page that is labelled twice
counts once, as bad if any label says so; null outcomes count for nothing. Without any label the prior mean is 1/2.
Extra columns of the inputs are ignored. The largest host may hold any share of rows: sums are combined before the
shuffle, and the join of pages to hosts is an ordinary equi-join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Public suffixes of two labels that the registered domain stands above.
TWO_LABEL_SUFFIXES = [
    "ac.uk", "co.at", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au",
    "com.br", "com.cn", "com.co", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pl", "com.sg", "com.tr", "com.tw",
    "com.ua", "com.vn", "edu.au", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk",
]
#: The rules of the query: verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null and where no :// stands."""
    rest = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and its verdict; both null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix by the labels of a host without its port; an address in digits is its own."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    labels = F.split(bare, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), ".")
    address = bare.rlike(r"^[0-9]+(\.[0-9]+)*$")
    two = last(2).isin(TWO_LABEL_SUFFIXES)
    domain = F.when(address, bare).when(two, last(3)).otherwise(last(2))
    return domain, F.when(address, bare).when(two, last(2)).otherwise(last(1))


def _strength(units: DataFrame, low: float, high: float) -> Column:
    """Moment estimate of the prior's strength over all units (n, good, prior mean m) of a level, as a scalar subquery's column."""
    spread = F.col("m") * (1 - F.col("m"))
    above = F.sum(F.pow(F.col("good") - F.col("n") * F.col("m"), 2) - F.col("n") * spread)
    below = F.sum(F.col("n") * (F.col("n") - 1) * spread)
    share = F.when(below > 0, above / F.when(below > 0, below)).otherwise(F.lit(0.0))
    row = units.where("n > 0").agg(share.alias("s")).first()
    rho = row["s"] if row["s"] is not None else 0.0
    rho = min(max(rho, 1.0 / (high + 1)), 1.0 / (low + 1))
    return F.lit(1.0 / rho - 1.0)


def reputation(pages: DataFrame, outcomes: DataFrame, low: float = 1.0, high: float = 1000.0, z: float = 1.645) -> DataFrame:
    """host, n labelled, good, posterior mean and lower bound, for every host of pages (page_id, host); outcomes: page_id, good (0 or 1)."""
    good = outcomes.where("good IS NOT NULL AND page_id IS NOT NULL").groupBy("page_id").agg(F.min("good").cast("double").alias("good"))
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = (
        pages.join(good, "page_id", "left").groupBy("host").agg(F.count("good").cast("double").alias("n"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("good"))
        .withColumns({"domain": domain, "suffix": suffix})
    )
    from .common import written

    hosts = written(hosts, "hosts")
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = ((total["good"] or 0.0) + 1.0) / ((total["n"] or 0.0) + 2.0)

    def posterior(units: DataFrame, name: str) -> DataFrame:
        k = _strength(units, low, high)
        return units.withColumn(name, (F.col("good") + k * F.col("m")) / (F.col("n") + k)).withColumn("k", k)

    suffixes = posterior(suffixes.withColumn("m", F.lit(overall)), "mean").select("suffix", F.col("mean").alias("m"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    domains = posterior(domains.join(suffixes, "suffix"), "mean").select("domain", F.col("mean").alias("m"))
    found = posterior(hosts.join(domains, "domain"), "mean")
    bound = F.col("mean") - F.lit(z) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("k") + 1))
    return found.select("host", "n", "good", "mean", bound.alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = 0.6) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's labelled pages and bound, one row for each row of pages."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    known = reputation(urls.select("page_id", "host"), outcomes)
    method = F.when(F.col("bound") >= threshold, "allow").otherwise("block")
    return (
        urls.join(known, "host", "left")
        .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.col("n").cast("long").alias("host_labelled"), F.round("bound", 6).alias("host_bound"))
    )
