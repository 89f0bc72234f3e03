"""URL filters from rules and the reputation of hosts.

Labelled pages give each host good and bad outcomes. The share of bad pages is shrunk step by
step through beta-binomial priors: the suffix (last label of the host) towards all pages, the
registered domain (last two labels) towards its suffix, the host towards its domain. The strength
of each prior is fitted to how much the groups of that level differ (method of moments). A page is
blocked if the lower bound of its host's posterior exceeds `most`: hosts that are little known
are not blocked on thin evidence. Rules come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spindlewatch.llm.common import lower_ascii
from spindlewatch.session import stage


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lowered, and path of a url; both empty without a `://`."""
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return (F.coalesce(lower_ascii(F.regexp_extract(url, pattern, 1)), F.lit("")),
            F.coalesce(F.regexp_extract(url, pattern, 2), F.lit("")))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (verdict, host/path) that fits, as struct(rule, verdict); else null.

    A rule's host stands for all its subdomains, its path for all paths it starts. Of rules that
    are equally long the one given first counts.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _shrunk(counts: DataFrame, level: str, prior: Column) -> DataFrame:
    """`counts` (n, bad per group) with the fitted strength and the posterior mean of each group."""
    fit = counts.withColumn("m", prior).filter("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2)).alias("seen"),
        F.sum(F.col("m") * (1 - F.col("m"))).alias("chance"),
        F.sum(F.col("m") * (1 - F.col("m")) * (F.col("n") - 1)).alias("spread")).first()
    # E[n (p - m)^2] = m (1 - m) (1 + (n - 1) rho)
    rho = 0.0
    if fit["spread"]:
        rho = min(0.99, max(1e-4, (fit["seen"] - fit["chance"]) / fit["spread"]))
    strength = 1 / rho - 1 if rho else 1.0
    weight = F.lit(float(strength))
    return (counts.withColumn("m", prior).withColumn(f"{level}_weight", weight)
            .withColumn(f"{level}_mean", (F.col("bad") + weight * F.col("m")) / (F.col("n") + weight))
            .drop("m"))


def reputation(outcomes: DataFrame, deviations: float = 1.645) -> DataFrame:
    """(host, n, bad, mean, low) per host from rows (host, bad), bad null where not labelled.

    low is the posterior mean less `deviations` posterior standard deviations.
    """
    hosts = stage(
        outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumn("domain", F.substring_index("host", ".", -2))
        .withColumn("suffix", F.substring_index("host", ".", -1)), "host-outcomes")
    both = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffixes = hosts.groupBy("suffix").agg(*both)
    total = suffixes.agg(*both).first()
    overall = total["bad"] / total["n"] if total["n"] else 0.0
    suffixes = stage(_shrunk(suffixes, "suffix", F.lit(float(overall))), "suffixes").select("suffix", "suffix_mean")
    domains = hosts.groupBy("domain", "suffix").agg(*both).join(suffixes, "suffix")
    domains = stage(_shrunk(domains, "domain", F.col("suffix_mean")), "domains").select("domain", "domain_mean")
    hosts = stage(_shrunk(hosts.join(domains, "domain"), "host", F.col("domain_mean")), "hosts")
    mean, size = F.col("host_mean"), F.col("n") + F.col("host_weight")
    return hosts.select("host", "n", "bad", mean.alias("mean"),
                        (mean - deviations * F.sqrt(mean * (1 - mean) / (size + 1))).alias("low"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], most: float = 0.3,
          page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_share, bad_low) for every page.

    labels: (doc_id, quality, toxic). A page's document is the last number of its url's path. A
    labelled page is bad if any label of it says so: quality 0 or toxic 1; labels of which both
    are null say nothing. Repeated pages are judged alike and each counts. A page without a host
    is judged as a host of its own, the empty one. Other columns of the tables are ignored.
    """
    host, path = split_url(F.col(url))
    parts = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    number = F.regexp_extract("path", r"(\d{1,18})[^/\d]*/?$", 1)
    wrong = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = (labels.select("doc_id", F.when(F.coalesce(wrong, F.lit(False)), 1).when(
        F.coalesce("quality", "toxic").isNotNull(), 0).alias("bad")).filter("doc_id is not null")
        .groupBy("doc_id").agg(F.max("bad").alias("bad")))
    outcomes = (parts.select("host", F.when(number != "", number.cast("long")).alias("doc_id"))
                .join(known, "doc_id", "left").select("host", "bad"))
    scores = reputation(outcomes)
    rule = match_rule(F.col("host"), F.col("path"), rules)
    return (parts.withColumn("fit", rule).join(scores, "host", "left")
            .select("page_id", "host", "path", F.col("fit.rule").alias("rule"),
                    F.coalesce("fit.verdict", F.when(F.col("low") > most, "block").otherwise("allow"))
                    .alias("verdict"),
                    F.col("mean").alias("bad_share"), F.col("low").alias("bad_low")))
