"""URL filters with DataFrame functions only: rules on hosts and paths, and beyond them the reputation of the host.

A host's rate of good pages is a beta-binomial posterior. Its prior is centred on the posterior mean of its registered
domain, the domain's on that of its suffix, and the suffix's on the mean of all outcomes; how many pages a prior is worth is
estimated at each level from how far groups lie from their prior, beyond what chance explains (moments). A page goes if
even the upper bound of its host's posterior lies under ``least``: few bad outcomes block no host.

Outcomes are summed by host before anything is shuffled, levels meet on hosts and domains, never on pages, and what the
pages join in the end are the blocked hosts alone.

Defined cases: a URL that is null or has no ``://`` has an empty host and path, which no rule fits and which is judged as a
host like others; a host without outcomes has its domain's mean; without any outcome every host has the mean 0.5 with
the width of two pages, and none is blocked; null outcomes do not count; repeated rows are pages of their own; an
address of numbers is its own domain, without a suffix; no pages give no rows. Other columns, whatever their names,
stay where ``keep`` names them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .decontam import LOWER, UPPER

#: Suffixes of two labels under which names are registered; others are one label.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.za")


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Number (from 0) of the longest rule that fits, else null. Of rules of equal length that of the longer host, then
    blocking, comes first. Rules are part of the plan: some hundreds at most."""
    found = None
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), -len(rules[i].host), rules[i].verdict != "block", i))
    for i in order:
        r = rules[i]
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, i) if found is None else found.when(fits, i)
    return F.lit(None).cast("int") if found is None else found


def suffix_of(host: Column, two_labels: tuple[str, ...] = TWO_LABELS) -> Column:
    two, one = F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)
    return F.when(host.rlike(r"\A[0-9.]*(:[0-9]+)?\z"), "").when(two.isin(*two_labels), two).otherwise(one)


def domain_of(host: Column, two_labels: tuple[str, ...] = TWO_LABELS) -> Column:
    """The registered domain: one label more than the suffix; an address of numbers as it is."""
    three, two = F.substring_index(host, ".", -3), F.substring_index(host, ".", -2)
    return F.when(host.rlike(r"\A[0-9.]*(:[0-9]+)?\z"), host).when(two.isin(*two_labels), three).otherwise(two)


def _worth(groups: DataFrame, prior: str, bounds: tuple[float, float] = (1.0, 10_000.0)) -> float:
    """How many outcomes a prior is worth, from (n, k) of the groups and their prior means: the intraclass correlation r by
    moments, as 1 / r - 1, within bounds. Groups of one outcome tell nothing of it."""
    n, k, m = F.col("n").cast("double"), F.col("k").cast("double"), F.col(prior)
    chance, more = n * m * (1 - m), n * (n - 1) * m * (1 - m)
    one = groups.agg(F.sum((k - n * m) * (k - n * m)).alias("seen"), F.sum(chance).alias("chance"), F.sum(more).alias("more")).first()
    if not one.more:
        return bounds[1]
    r = (one.seen - one.chance) / one.more
    return bounds[1] if r <= 0 else min(bounds[1], max(bounds[0], 1 / r - 1))


def reputations(pages: DataFrame, outcomes: DataFrame, url: str = "url", good: str = "good", z: float = 1.645, two_labels: tuple[str, ...] = TWO_LABELS) -> DataFrame:
    """(host, domain, suffix, n, k, mean, lower, upper): the posterior of every host of pages and outcomes (columns ``url`` and
    the boolean ``good``), with its bounds at ``z`` spreads."""
    seen = outcomes.where(F.col(good).isNotNull()).select(host_of(F.col(url)).alias("host"), F.lit(1).alias("n"), F.col(good).cast("int").alias("k"))
    all_hosts = pages.select(host_of(F.col(url)).alias("host"), F.lit(0).alias("n"), F.lit(0).alias("k")).unionByName(seen)
    hosts = all_hosts.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    hosts = written(hosts.withColumn("domain", domain_of(F.col("host"), two_labels)).withColumn("suffix", suffix_of(F.col("host"), two_labels)), "hosts")
    domains = written(hosts.groupBy("domain").agg(F.max("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = domains.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    base = ((total.k or 0) + 1) / ((total.n or 0) + 2)

    def shrunk(groups: DataFrame, prior: str, mean: str) -> DataFrame:
        worth = _worth(groups, prior)
        return groups.withColumn(mean, (F.col("k") + worth * F.col(prior)) / (F.col("n") + worth))

    of_suffix = shrunk(suffixes.withColumn("all_mean", F.lit(float(base))), "all_mean", "suffix_mean").select("suffix", "suffix_mean")
    of_domain = shrunk(domains.join(of_suffix, "suffix"), "suffix_mean", "domain_mean").select("domain", "domain_mean")
    placed = hosts.join(of_domain, "domain")
    worth = _worth(placed, "domain_mean") if total.n else 2.0
    mean = (F.col("k") + worth * F.col("domain_mean")) / (F.col("n") + worth)
    spread = F.sqrt(mean * (1 - mean) / (F.col("n") + worth + 1))
    return placed.select("host", "domain", "suffix", "n", "k", mean.alias("mean"), F.greatest(F.lit(0.0), mean - z * spread).alias("lower"), F.least(F.lit(1.0), mean + z * spread).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("page_id",), url: str = "url", good: str = "good", least: float = 0.5, z: float = 1.645, two_labels: tuple[str, ...] = TWO_LABELS) -> DataFrame:
    """A row per page: the kept columns, host, path, rule (its host and path, else null) and verdict: the rule's, else
    ``block`` where the upper bound of the host's rate of good pages is under ``least``."""
    blocked = reputations(pages, outcomes, url, good, z, two_labels).where(F.col("upper") < least).select("host", F.lit("block").alias("bad"))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("at", rule_of(F.col("host"), F.col("path"), rules)).join(blocked, "host", "left")
    names, verdicts = F.array(*[F.lit(r.name) for r in rules] or [F.lit("")]), F.array(*[F.lit(r.verdict) for r in rules] or [F.lit("")])
    return rows.select(*[F.col(f"kept.`{c}`").alias(c) for c in keep], "host", "path", F.get(names, F.col("at")).alias("rule"),
                       F.coalesce(F.get(verdicts, F.col("at")), "bad", F.lit("allow")).alias("verdict"))
