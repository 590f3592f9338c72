"""URL filter: list rules first, else empirical-Bayes reputation of the host.

Labelled page outcomes (1 good, 0 bad) are counted per host.  Rates are
beta-binomial and shrink level by level: the suffix towards the whole corpus,
the registered domain towards its suffix, the host towards its domain.  At each
level the prior's mean is the parent's posterior mean and its strength comes
from the spread of the children's rates (method of moments, over the units of
that level).  A page passes if the lower posterior bound ``mean - z * sd`` of
its host reaches ``min_rate``; a host without labels has its domain's
posterior, and so on upwards.

Counts are aggregated before they meet, so a host that holds a third of all
pages costs one row a task; only the host table joins back to the pages.

Cases: a null url, or one without ``://``, has empty host and path, counts as a
host of its own and goes by the corpus rate; ports and user names stay part of
the host; an address or a one-label host is its own domain; null or other
outcomes are not counted; a page labelled twice counts twice; repeated pages
are judged alike; without any label every page passes; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_table

# The rules of the contract, (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Public suffixes of two labels; others are the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")


@dataclass(frozen=True)
class Reputation:
    """Posterior bound parameters; strengths are clamped to ``[min, max]`` prior observations."""

    min_rate: float = 0.5
    z: float = 1.645
    min_strength: float = 2.0
    max_strength: float = 1000.0


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    u = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    u = F.coalesce(F.col(url), F.lit(""))
    return F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def registered_domain(host: str) -> Column:
    h = F.col(host)
    two = F.substring_index(h, ".", -2).isin(*TWO_LABEL_SUFFIXES)
    address = h.rlike(r"^[0-9.]+(:[0-9]+)?$")
    return F.when(address, h).when(two, F.substring_index(h, ".", -3)).otherwise(F.substring_index(h, ".", -2))


def suffix(host: str) -> Column:
    h = F.col(host)
    two = F.substring_index(h, ".", -2)
    address = h.rlike(r"^[0-9.]+(:[0-9]+)?$")
    return F.when(address, F.lit("")).when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(h, ".", -1))


def matching_rule(host: str, path: str, rules=RULES) -> tuple[Column, Column]:
    """Longest fitting rule as text (``host/path``) and its verdict; both null without one."""
    h, p = F.col(host), F.col(path)
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # the last `when` asked first is the longest rule; equal texts cannot differ in fit
    for v, rh, rp in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        text = F.when(fits, F.lit(rh + rp)).otherwise(text)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def _level(children: DataFrame, parents: DataFrame, key: str, unit: str, how: Reputation) -> DataFrame:
    """Posterior ``(unit, a, b)`` of one level from counts ``(unit, key, n, k)`` and the parents' means.

    The strength of the prior is one number for the level: with rates
    ``k / n`` around the parents' means ``m``, the between-unit variance is the
    total less the binomial part, and ``strength = m (1 - m) / between - 1``.
    """
    j = children.join(parents.select(F.col(key), (F.col("a") / (F.col("a") + F.col("b"))).alias("m")), key)
    spread = F.pow(F.col("k") / F.col("n") - F.col("m"), F.lit(2))
    moments = j.where("n > 0").agg(
        F.sum(F.col("n") * spread).alias("ss"), F.sum(F.col("m") * (1 - F.col("m"))).alias("within"),
        F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("total"), F.sum("n").alias("nn"), F.count("*").alias("units"))
    between = (F.col("ss") - F.col("within")) / F.greatest(F.col("nn") - F.col("units"), F.lit(1))
    strength = F.coalesce(F.when(between > 1e-9, (F.col("total") / F.col("nn")) / between - 1), F.lit(how.max_strength))
    moments = moments.select(F.greatest(F.lit(how.min_strength), F.least(F.lit(how.max_strength), strength)).alias("s"))
    # one row: the level's strength
    return (j.join(F.broadcast(moments), F.lit(True)).select(
        F.col(unit), (F.col("m") * F.col("s") + F.col("k")).alias("a"), ((1 - F.col("m")) * F.col("s") + F.col("n") - F.col("k")).alias("b")))


def host_posteriors(counts: DataFrame, how: Reputation = Reputation()) -> DataFrame:
    """``(host, n, rate, bound)`` from ``(host, n, k)``: labelled pages and good ones by host."""
    # each level's counts and posteriors are read by the next one and again for the strength: written, not planned anew
    kept = lambda df, name: write_table(df, name)[0]
    c = kept(counts.select("host", registered_domain("host").alias("domain"), suffix("host").alias("suffix"), "n", "k"), "host_counts")
    domains = kept(c.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("k").alias("k")), "host_domains")
    suffixes = kept(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("top", F.lit(1)), "host_suffixes")
    top = suffixes.groupBy("top").agg((F.sum("k") + 1.0).alias("a"), (F.sum("n") - F.sum("k") + 1.0).alias("b"))
    ps = kept(_level(suffixes, top, "top", "suffix", how), "host_suffix_level")
    pd = kept(_level(domains, ps, "suffix", "domain", how), "host_domain_level")
    ph = _level(c, pd, "domain", "host", how)
    s = F.col("a") + F.col("b")
    rate = F.col("a") / s
    bound = rate - how.z * F.sqrt(rate * (1 - rate) / (s + 1))
    return ph.join(c.select("host", "n"), "host").select("host", "n", rate.alias("rate"), bound.alias("bound"))


def url_verdicts(pages: DataFrame, outcomes: DataFrame, rules=RULES, how: Reputation = Reputation(), page_id: str = "page_id",
                 url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, n_labelled, rate, bound`` of every page.

    ``outcomes (page_id, good)`` holds 1 for good and 0 for bad pages.
    """
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"))
    p = p.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    good = outcomes.where("good in (0, 1)").groupBy("page_id").agg(F.count("*").alias("n"), F.sum("good").alias("k"))
    counts = (p.join(good, "page_id", "left").groupBy("host")
              .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")))
    counts, _ = write_table(counts, "host_labelled")           # pages are parsed here and for the verdicts, not once a level
    hosts = host_posteriors(counts, how)
    text, verdict = matching_rule("host", "path", rules)
    anything = F.when((F.col("bound") >= how.min_rate) | (F.col("any_label") == 0), F.lit("allow")).otherwise(F.lit("block"))
    total = counts.agg(F.sum("n").alias("any_label"))
    return (p.join(hosts, "host", "left").join(F.broadcast(total), F.lit(True), "left")
            .select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, anything).alias("verdict"),
                    F.col("n").alias("n_labelled"), "rate", "bound"))
