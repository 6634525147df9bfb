"""Operator 6, URL filters: empirical-Bayes host reputation (native).

Rules decide first. For the other pages, labelled outcomes are counted by host
and shrunk level by level: the mean of all labels is the prior of the suffixes
(last host label), theirs of the registered domains (last two), theirs of the
hosts. How strongly a level is shrunk is its beta-binomial concentration, by
the method of moments over that level's groups. A host is blocked if the lower
posterior bound of its share of bad pages exceeds the limit.

Counts are aggregated before any shuffle of their key; the only join of pages
is by host with one row per host.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UrlParams:
    limit: float = 0.5          # share of bad pages
    z: float = 1.64             # standard deviations of the lower bound
    least_rho: float = 0.01     # bounds of the intra-group correlation
    most_rho: float = 0.99


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, else null. Rules are (verdict, host/path),
    a list of fixed size; a rule fits its host and all subdomains, if the path
    starts with the rule's."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, rest = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _concentration(groups: DataFrame, p: UrlParams) -> DataFrame:
    """One row: the concentration of groups with counts n, k."""
    s = groups.agg(F.count("*").alias("g"), F.sum("n").alias("nn"), F.sum("k").alias("kk"),
                   F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("k2n"))
    m = F.try_divide("kk", F.col("nn"))
    spread = F.col("k2n") - F.col("nn") * m * m                       # sum of n (k/n - m)^2
    free = F.col("g") - 1
    rho = F.try_divide(F.try_divide(spread, m * (1 - m)) - free, F.col("nn") - F.try_divide("n2", F.col("nn")) - free)
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.5)), F.lit(p.least_rho)), F.lit(p.most_rho))
    return s.select((1 / rho - 1).alias("c"))


def reputation(outcomes: DataFrame, params: UrlParams = UrlParams()) -> DataFrame:
    """(host, share, lower): posterior mean and lower bound of every host.

    ``outcomes``: host, bad (boolean, null where unlabelled). Hosts without
    labels have their domain's posterior."""
    p = params
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("k")) \
        .withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    mean = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m"))

    def strength(groups):
        return _concentration(groups.where("n > 0"), p).scalar()
    s = suffixes.withColumn("c", strength(suffixes)).withColumn("m0", mean.scalar()) \
        .select("suffix", ((F.col("k") + F.col("c") * F.col("m0")) / (F.col("n") + F.col("c"))).alias("ms"))
    d = domains.withColumn("c", strength(domains)).join(s, "suffix") \
        .select("domain", ((F.col("k") + F.col("c") * F.col("ms")) / (F.col("n") + F.col("c"))).alias("md"))
    h = hosts.withColumn("c", strength(hosts)).join(d, "domain")
    share = (F.col("k") + F.col("c") * F.col("md")) / (F.col("n") + F.col("c"))
    sd = F.sqrt(share * (1 - share) / (F.col("n") + F.col("c") + 1))
    return h.select("host", share.alias("share"), (share - p.z * sd).alias("lower"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
          bad: Column | None = None, params: UrlParams = UrlParams()) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule`` (the longest
    that fits, else null), ``verdict`` (``allow`` or ``block``: the rule's,
    else the host's reputation).

    ``bad`` labels pages (boolean, null: unlabelled); without it, the pages
    that a rule decides are the labelled ones. A null url, or one without
    ``://``, has an empty host and path, and shares the reputation of that
    empty host. Rules of equal length cannot both fit one host unless equal.
    Repeated or null ids are judged row by row; very long urls are taken
    whole; an empty table has no rows. Other columns are not read, unless
    ``bad`` does.
    """
    p = params
    label = bad if bad is not None else F.lit(None).cast("boolean")
    host, path = host_path(pages[url_col].cast("string"))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), host.alias("host"), path.alias("path"), label.alias("bad"))
    rows = rows.withColumn("rule", first_rule(F.col("host"), F.col("path"), rules))
    ruled = F.lit(None).cast("string")
    for verdict, rule in rules:
        ruled = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(ruled)
    rows = rows.withColumn("ruled", ruled)
    if bad is None:
        rows = rows.withColumn("bad", F.col("ruled") == "block")
    known = reputation(rows.select("host", "bad"), p)
    own = F.when(F.col("lower") > p.limit, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(known, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"))
