"""URL filter by empirical-Bayes host reputation, with domain rules.

Labelled page outcomes (good or bad) are counted by host, registered domain (the suffix and the label before it) and suffix
(the last label, or two labels where those are a public suffix, a parameter). Each level is shrunk to the one above through a beta-binomial prior:

    mean = (good + strength * mean of the level above) / (n + strength)

The strength of a level is fitted by moments from the spread of its units around their parents: units that differ no more
than chance give a strong prior, units that differ much a weak one. A url is blocked if the upper posterior bound
``mean + z sd`` of its host is below the limit: a host goes only if it is bad beyond doubt, few labels never condemn it. A
host without labels has its domain's posterior, else its suffix's, else the overall one. Rules come first; the longest
that fits wins.

All is sums and equi-joins. Which label belongs to a page is a parameter, too: by default labels of documents meet pages by
the number that ends the url's path. Outcomes are counted once, by host, and written; the levels are sums of that table. A hot
host is a few partial sums and one row of the table that pages are joined with, and its pages may be split by adaptive
execution.

Defined results: null urls and urls without "://" have an empty host and path, no rule, and the overall posterior; pages
without labels count nowhere; repeated rows count as often as they occur; labels that are null are no outcome; without any
label the prior is uniform and all is allowed; an empty table gives no rows; columns named like the results are replaced, all
others pass, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.store import materialize, quoted

#: Suffixes of two labels under which names are registered; all others have one label.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "co.in", "co.za", "com.br", "com.cn", "com.mx")
#: (rule, verdict): host, a slash, and the path's beginning.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
LIMIT = 0.5
Z = 1.645
#: Bounds of a level's fitted strength (labelled pages that the level above counts for).
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 200.0


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or without ://: empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, _, begins = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + begins)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def page_number(path: Column) -> Column:
    """The number that ends a path (before an extension), which the labels of documents are met by."""
    return F.regexp_extract(path, r"/([0-9]+)[^/]*/?$", 1).try_cast("bigint")


def registered(host: Column, suffixes: Sequence[str]) -> tuple[Column, Column]:
    """The registered domain and the suffix of a host."""
    labels = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    two = last(2).isin(list(suffixes)) & (F.size(labels) >= 2)
    return F.when(two, last(3)).otherwise(last(2)), F.when(two, last(2)).otherwise(last(1))


def _shrunk(units: DataFrame, parents: DataFrame, unit: str, parent: str) -> DataFrame:
    """units (unit, parent, n, good) with mean and sd after shrinking to parents (parent, mean)."""
    met = units.join(parents.select(parent, F.col("mean").alias("up")), parent)
    rate = F.col("good") / F.col("n")
    between = F.col("up") * (1 - F.col("up"))
    # E[n (rate - up)^2] = up (1 - up) (1 + (n - 1) rho), rho = 1 / (strength + 1)
    q, b, d = met.agg(F.sum(F.col("n") * F.pow(rate - F.col("up"), 2)), F.sum(between), F.sum((F.col("n") - 1) * between)).first()
    rho = (q - b) / d if d else 0.0
    strength = min(MOST_STRENGTH, max(LEAST_STRENGTH, 1 / rho - 1 if rho > 1e-6 else MOST_STRENGTH))
    a = F.col("good") + F.lit(strength) * F.col("up")
    total = F.col("n") + F.lit(strength)
    return met.withColumn("mean", a / total).withColumn("sd", F.sqrt((a / total) * (1 - a / total) / (total + 1))).select(unit, parent, "n", "good", "mean", "sd")


def posterior_tables(outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float]]:
    """(hosts, domains, suffixes, (mean, sd) of all) with posterior mean and sd, from outcomes (host, good: 0 or 1)."""
    domain, suffix = registered(F.col("host"), suffixes)
    hosts = materialize(outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")).withColumn("domain", domain).withColumn("suffix", suffix))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("every", F.lit(0))
    n, good = (float(x or 0) for x in hosts.agg(F.sum("n"), F.sum("good")).first())
    mean = (good + 1) / (n + 2)
    overall = mean, (mean * (1 - mean) / (n + 3)) ** 0.5
    s = materialize(_shrunk(tops, tops.select("every").distinct().withColumn("mean", F.lit(mean)), "suffix", "every"))
    d = materialize(_shrunk(domains, s, "domain", "suffix"))
    return materialize(_shrunk(hosts.drop("suffix"), d, "host", "domain")), d, s, overall


def outcomes(pages: DataFrame, labels: DataFrame, number: Callable[[Column], Column] = page_number) -> DataFrame:
    """(host, good) of each page whose document is labelled: good if of quality 1 and not toxic. number: from a url's path, the
    doc_id of its labels."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good"))
    seen = pages.select(url_host(F.col("url")).alias("host"), number(url_path(F.col("url"))).alias("doc_id")).where("doc_id is not null and host != ''")
    return seen.join(known, "doc_id").select("host", "good")


RESULTS = ("host", "path", "rule", "verdict", "reputation", "upper")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] | None = None, limit: float = LIMIT, z: float = Z, suffixes: Sequence[str] = SUFFIXES, number: Callable[[Column], Column] = page_number) -> DataFrame:
    """pages with host, path, rule, verdict, reputation (posterior mean) and upper (its bound)."""
    rules = RULES if rules is None else rules
    hosts, domains, tops, (mean, sd) = posterior_tables(outcomes(pages, labels, number), suffixes)
    kept = [c for c in pages.columns if c not in RESULTS]
    seen = pages.select(F.struct(*[quoted(c) for c in kept]).alias("_row"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    domain, suffix = registered(F.col("host"), suffixes)
    named = seen.withColumn("domain", domain).withColumn("suffix", suffix)
    for key, level in (("host", hosts), ("domain", domains), ("suffix", tops)):
        named = named.join(level.select(key, F.struct("mean", "sd").alias(f"_{key}")), key, "left")
    rule, fixed = matching_rule(F.col("host"), F.col("path"), rules)
    best = F.coalesce("_host", "_domain", "_suffix", F.struct(F.lit(mean).alias("mean"), F.lit(sd).alias("sd")))
    judged = named.withColumn("_b", best).withColumn("upper", F.least(F.lit(1.0), F.col("_b.mean") + z * F.col("_b.sd")))
    verdict = F.coalesce(fixed, F.when(F.col("upper") < limit, "block").otherwise("allow"))
    return judged.select(*[quoted(c, "_row") for c in kept], "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.col("_b.mean").alias("reputation"), "upper")
