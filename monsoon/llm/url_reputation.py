"""URL filters: written rules first, then the empirical-Bayes reputation of the host.

Labelled outcomes of pages (bad or not) are counted by host and shrunk down a chain of beta-binomial priors: from all pages to
the suffix (``net``), from there to the registered domain (``example.net``), from there to the host. How strongly a level
is drawn to the one above is estimated from the data: the spread of the groups' rates beyond what chance gives them, by the
method of moments. A host with few labels has the rate of its domain, one with many its own. The verdict uses a bound of the
posterior and not its mean: pages are blocked where the rate of bad pages lies above ``MOST_BAD`` even ``SURE`` standard
deviations below the mean. So a host that nobody has labelled is only blocked if its whole domain is certain to be bad.

Rules name a host and a path; a rule fits its host and all subdomains where the path begins with the rule's, the longest
one wins, of equally long ones the first in the alphabet. Rules are a short written list that becomes one expression.

Scale: pages are grouped once, by host with partial counts; what follows works on hosts, domains and suffixes, and three
numbers come to the driver. Pages meet their host's posterior in an ordinary join, which Spark broadcasts while the hosts
are few by its own size limit and splits where one host has most of the pages otherwise.

Defined results: a null url, or one without ``://``, has an empty host and path, and the rate of all pages as its prior;
pages without labels count nowhere; a page with several labels counts once for each; repeated rows are pages of their own;
an empty table gives an empty result; extra columns are ignored. Without any label the mean is a half and nothing is blocked.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monsoon.llm.common import text_or_empty
from monsoon.session import cut_lineage

# Host, path and verdict of the written rules, and the suffixes of two labels that are told apart.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
TWO_LABELS = ["co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in"]

#: Blocked from this rate of bad pages on, so many standard deviations below the posterior mean (95 % one-sided).
MOST_BAD, SURE = 0.5, 1.645
#: Limits of the correlation inside groups: shrinking by 1 / 1000 of a label at least, by 10,000 labels at most.
LEAST_ALIKE, MOST_ALIKE = 1e-4, 0.999


def host_of(url: Column) -> Column:
    host = F.regexp_extract(text_or_empty(url), r"://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(text_or_empty(url), r"://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(TWO_LABELS), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and the label before it; the whole host where it is shorter, or a number."""
    two = F.substring_index(host, ".", -2)
    domain = F.when(two.isin(TWO_LABELS), F.substring_index(host, ".", -3)).otherwise(two)
    return F.when(host.rlike(r"^[0-9.:]*$"), host).otherwise(domain)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule, null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in reversed(ordered):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        text = F.when(fits, rule_host + rule_path).otherwise(text)
        verdict = F.when(fits, says).otherwise(verdict)
    return text, verdict


def _strength(groups: DataFrame) -> float:
    """Labels that a prior counts for, from groups (n, bad, prior): the beta-binomial's moments around the prior means."""
    rate, chance = F.col("bad") / F.col("n"), F.col("prior") * (1 - F.col("prior"))
    spread, plain, extra = groups.filter("n > 0").agg(
        F.sum(F.col("n") * (rate - F.col("prior")) ** 2), F.sum(chance), F.sum(chance * (F.col("n") - 1))
    ).first()
    alike = (spread - plain) / extra if extra else LEAST_ALIKE
    alike = min(max(alike, LEAST_ALIKE), MOST_ALIKE)
    return (1 - alike) / alike


def _shrunk(groups: DataFrame, strength: float) -> Column:
    return (F.col("bad") + F.lit(strength) * F.col("prior")) / (F.col("n") + F.lit(strength))


def reputation(counts: DataFrame) -> DataFrame:
    """Posterior of every host of ``counts`` (host, n: labels, bad: bad ones among them), whose rows are added up.

    Columns: host, n, bad, alpha and beta of the posterior, mean, and bound: mean less ``SURE`` deviations.
    """
    counts = counts.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    host = F.col("host")
    hosts = cut_lineage(counts.select("host", domain_of(host).alias("domain"), suffix_of(host).alias("suffix"), "n", "bad"))
    domains = cut_lineage(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = cut_lineage(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    n, bad = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    suffixes = suffixes.withColumn("prior", F.lit((bad + 1.0) / (n + 2.0)))
    suffixes = suffixes.select("suffix", _shrunk(suffixes, _strength(suffixes)).alias("prior"))
    domains = domains.join(suffixes, "suffix")
    domains = domains.select("domain", "suffix", _shrunk(domains, _strength(domains)).alias("prior"))
    hosts = hosts.join(domains, ["domain", "suffix"])
    strength = _strength(hosts)
    alpha, total = F.col("bad") + F.lit(strength) * F.col("prior"), F.col("n") + F.lit(strength)
    known = hosts.select("host", "n", "bad", alpha.alias("alpha"), (total - alpha).alias("beta"))
    mean = F.expr("alpha / (alpha + beta)")
    spread = F.sqrt(F.expr("alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))"))
    return known.withColumns({"mean": mean, "bound": mean - F.lit(SURE) * spread})


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url), with its host's labels and bound.

    ``outcomes`` has the labels: (page_id, bad), 1 or 0; nulls are no labels.
    """
    url = F.col("url")
    placed = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    zero = F.lit(0).cast("long")
    labels = outcomes.select(F.col("page_id").cast("long").alias("page_id"), F.col("bad").cast("long").alias("bad"))
    labels = labels.filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(
        F.count("*").alias("n"), F.sum("bad").alias("bad")
    )
    counts = placed.join(labels, "page_id", "left").select("host", F.coalesce("n", zero).alias("n"), F.coalesce("bad", zero).alias("bad"))
    known = cut_lineage(reputation(counts)).withColumnRenamed("n", "host_labels").withColumnRenamed("bad", "host_bad")
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bound") > MOST_BAD, "block").otherwise("allow")
    return placed.join(known, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), "host_labels", "host_bad",
        "mean", "bound",
    )
