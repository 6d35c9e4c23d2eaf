"""URL filter: rules first, and an empirical-Bayes reputation of the host for the rest.

Pages that a rule decides are the labelled outcomes (blocked or not). Their rate is shrunk
level by level: a public suffix toward all pages, a registered domain toward its suffix, a
host toward its domain. Each level has a beta prior whose mean is the posterior mean one
level up and whose strength comes from the spread of the rates on that level, less what single
pages spread by chance (method of moments of the beta-binomial). A host is blocked when the
lower bound of its posterior block rate, ``mean - z * deviation``, reaches ``threshold``; this
is the normal approximation, which is rough for hosts of few pages under a weak prior.

Only counts per host are shuffled, so a host that holds a third of all rows costs one row
per task. Urls are read without the page content.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import UPPER


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


# Public suffixes of two labels, under which each site is a domain of its own.
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "com.au", "net.au", "org.au", "edu.au", "co.nz", "org.nz",
    "co.jp", "ne.jp", "or.jp", "ac.jp", "co.kr", "or.kr", "com.cn", "net.cn", "org.cn", "com.tw", "com.hk",
    "com.sg", "co.in", "net.in", "org.in", "co.za", "org.za", "com.br", "net.br", "org.br", "com.ar", "com.mx",
    "com.co", "com.tr", "com.ua", "co.il", "org.il",
)


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The longest of ``suffixes`` that the host is or ends in, else its last label."""
    labels = F.split(host, r"\.")
    suffix = F.element_at(labels, -1)
    for n in sorted({s.count(".") + 1 for s in suffixes}):
        tail = F.substring_index(host, ".", -n)
        suffix = F.when(tail.isin(*[s for s in suffixes if s.count(".") + 1 == n]), tail).otherwise(suffix)
    return suffix


def domain_of(host: Column, suffix: Column) -> Column:
    """The label before the suffix, and the suffix; a bare suffix is its own domain."""
    before = F.substring(host, F.lit(1), F.length(host) - F.length(suffix) - 1)
    return F.when(host == suffix, host).otherwise(
        F.concat_ws(".", F.substring_index(before, ".", -1), suffix))


def rule_for(host: Column, path: Column, rules: Sequence[UrlRule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; a tie goes to the smaller text.

    The expression holds every rule, which suits lists of up to some hundreds.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def _strength(least: float, most: float) -> Column:
    """Prior strength by moments of the beta-binomial, held within ``least`` and ``most``.

    ``S = sum n_i (p_i - p)^2`` over ``k`` members with ``n_i`` of ``N`` pages is
    ``p (1 - p) (k - 1)`` where single pages alone spread the rates; what is above that gives
    the correlation ``rho`` of two pages of a member, and the strength ``1 / rho - 1``. It is
    ``most`` where the members spread no more than by chance, or nothing can be told.
    """
    p, n = F.col("_m"), F.col("_n")
    chance = p * (1 - p)
    above = F.col("_q") - n * p * p - chance * (F.col("_k") - 1)
    room = chance * (n - F.try_divide(F.col("_nn"), n) - (F.col("_k") - 1))
    told = (n > 0) & (room > 0) & (above > 0)
    raw = F.when(told, F.try_divide(room, above) - 1).otherwise(F.lit(most))
    return F.greatest(F.lit(least), F.least(F.lit(most), raw))


def reputation(outcomes: DataFrame, least: float = 2.0, most: float = 1000.0,
               suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Posterior of each host's block rate: ``host, bad, good, mean, deviation``.

    ``outcomes`` has ``host`` and ``bad`` (1, 0, or NULL where the page is not labelled).
    Hosts without labels get the prior of their domain, suffix or all pages. NULL hosts
    count as the empty host. An empty table gives no rows.
    """
    host = F.coalesce(F.col("host"), F.lit(""))
    hosts = outcomes.groupBy(host.alias("host")).agg(
        F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"),
        F.count("bad").cast("double").alias("n"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"), suffixes)).withColumn(
        "domain", domain_of(F.col("host"), F.col("suffix")))

    domains = hosts.groupBy("suffix", "domain").agg(
        F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))

    def moments(level: DataFrame) -> Column:
        """Pooled rate, and strength of the prior that the level's members get (a scalar)."""
        seen = F.col("n") > 0
        sums = level.agg(
            F.sum("bad").alias("_b"), F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("n")).alias("_nn"),
            F.sum(F.when(seen, F.col("bad") * F.col("bad") / F.col("n"))).alias("_q"), F.count_if(seen).alias("_k"))
        sums = sums.withColumn("_m", F.when(F.col("_n") > 0, F.col("_b") / F.col("_n")).otherwise(F.lit(0.0)))
        return sums.select(F.struct(F.col("_m").alias("rate"),
                                    _strength(least, most).alias("strength"))).scalar()

    def shrunk(prior: Column, strength: Column) -> Column:
        return (F.col("bad") + prior * strength) / (F.col("n") + strength)

    of_suffix = suffixes.withColumn("prior", moments(suffixes)).select(
        "suffix", shrunk(F.col("prior.rate"), F.col("prior.strength")).alias("suffix_mean"))
    of_domain = domains.withColumn("prior", moments(domains)).join(of_suffix, "suffix").select(
        "domain", "suffix", shrunk(F.col("suffix_mean"), F.col("prior.strength")).alias("domain_mean"))
    joined = hosts.withColumn("prior", moments(hosts)).join(of_domain, ["domain", "suffix"])
    mean = shrunk(F.col("domain_mean"), F.col("prior.strength"))
    total = F.col("n") + F.col("prior.strength")
    return joined.select(
        "host", "bad", (F.col("n") - F.col("bad")).alias("good"), mean.alias("mean"),
        F.sqrt(mean * (1 - mean) / (total + 1)).alias("deviation"))


def judge(pages: DataFrame, rules: Sequence[UrlRule], threshold: float = 0.5, z: float = 1.645,
          url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """One row per page: ``keep``, host, path, rule, verdict, block_mean, block_bound.

    A NULL url, or one without ``://``, has an empty host and path and is judged as the host
    "". Repeated rows each get a row and each count. Other columns are not read, so their
    names cannot clash.
    """
    parsed = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumn("rule", text).withColumn("ruled", verdict)
    outcomes = ruled.select("host", F.when(F.col("ruled").isNotNull(), (
        F.col("ruled") == "block").cast("int")).alias("bad"))
    hosts = reputation(outcomes).select(
        "host", F.col("mean").alias("block_mean"),
        (F.col("mean") - z * F.col("deviation")).alias("block_bound"))
    judged = ruled.join(hosts, "host", "left")
    own = F.when(F.col("block_bound") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(*keep, "host", "path", "rule",
                         F.coalesce("ruled", own).alias("verdict"), "block_mean", "block_bound")
