"""URL filters: fixed rules, then empirical-Bayes host reputation. Built-in Spark functions only.

Labelled page outcomes (bad: 0 or 1) are counted per host. Shares are shrunk down a hierarchy of beta-binomial priors: the
suffix towards all pages, the registered domain towards its suffix, the host towards its domain. The strength of each
prior is found by the method of moments from the spread of the shares among the units of its level, so levels whose units
differ little shrink their units strongly. A host is blocked if the lower bound of its posterior, mean less `z` standard
deviations, is above `limit`: a few bad pages don't block a host, many do. A host without labelled pages has its domain's
posterior, a domain without any that of its suffix, and so on.

A rule `host/path` fits its host and all subdomains if the path begins with the rule's path. The longest rule wins; of equally
long ones a blocking one. Rules are an argument, so their number is the caller's.

A null url or one without `://` has an empty host and path, fits no rule, and is judged by the posterior of all pages.
Repeated pages are judged alike; a page with several labels counts once for each. Empty tables give empty results; without
labels nothing is blocked but by rule. `judge` returns the named result columns only; extra columns of pages are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes of two labels under which domains are registered.
TWO_LABEL_SUFFIXES = [
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.kr", "co.nz", "co.za",
    "com.ar", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "co.in", "co.il",
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LIMIT, Z = 0.5, 1.645


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty without `://`."""
    rest = F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def domain_and_suffix(host: str = "host") -> tuple[Column, Column]:
    """Registered domain and public suffix of a host; a host of one label is both."""
    bare = f"regexp_replace({host}, ':[0-9]*$', '')"
    two = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
    suffix = f"CASE WHEN substring_index({bare}, '.', -2) IN ({two}) THEN substring_index({bare}, '.', -2) ELSE substring_index({bare}, '.', -1) END"
    domain = f"CASE WHEN substring_index({bare}, '.', -2) IN ({two}) THEN substring_index({bare}, '.', -3) ELSE substring_index({bare}, '.', -2) END"
    return F.expr(domain), F.expr(suffix)


def matching_rule(rules: list[tuple[str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does. `rules`: (verdict, `host/path`)."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule in reversed(ordered):
        at, _, below = rule.partition("/")
        fits = ((F.col(host) == at) | F.col(host).endswith(f".{at}")) & F.col(path).startswith(f"/{below}")
        name = F.when(fits, rule).otherwise(name)
        verdict = F.when(fits, decision).otherwise(verdict)
    return name, verdict


def _strength(mean: str) -> str:
    """Expression of the prior's strength (pseudo pages) by the method of moments, from rows (n, bad, `mean` of the level above).

    The spread of shares beyond what sampling explains: `sum n (p - m)^2 = sum m (1 - m) (1 + (n - 1) r)` for the
    correlation r of pages of a unit; the strength is 1 / r - 1, kept within 1 and 1e6.
    """
    spread = f"sum(n * power(bad / n - {mean}, 2))"
    noise, more = f"sum({mean} * (1 - {mean}))", f"sum((n - 1) * {mean} * (1 - {mean}))"
    r = f"CASE WHEN {more} > 0 THEN ({spread} - {noise}) / {more} ELSE 0.0D END"
    return f"CASE WHEN {r} <= 1e-6 THEN 1e6 WHEN {r} >= 0.5 THEN 1.0D ELSE 1 / {r} - 1 END"


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, domain, suffix, n, bad, mean, deviation) for every host, domain and suffix that has labelled pages.

    `outcomes`: (host, bad). Rows of a domain have a null host, those of a suffix also a null domain, the row of all pages
    is null in all three.
    """
    domain, suffix = domain_and_suffix()
    hosts = outcomes.where("bad IS NOT NULL").groupBy("host").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("bad").cast("double").alias("bad")
    ).withColumn("domain", domain).withColumn("suffix", suffix)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    every = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).selectExpr(
        "coalesce(n, 0.0D) AS n", "coalesce(bad, 0.0D) AS bad", "(coalesce(bad, 0.0D) + 1) / (coalesce(n, 0.0D) + 2) AS mean",
        "coalesce(n, 0.0D) + 2 AS weight",
    )

    def shrunk(units: DataFrame, above: DataFrame, on: list[str]) -> DataFrame:
        prior = above.selectExpr(*on, "mean AS prior")
        joined = units.join(prior, on) if on else units.withColumn("prior", prior.scalar())
        strength = joined.agg(F.expr(_strength("prior")).alias("k"))
        return joined.withColumn("k", strength.scalar()).selectExpr(
            *units.columns, "(bad + k * prior) / (n + k) AS mean", "n + k AS weight"
        )

    of_suffix = shrunk(suffixes, every, [])
    of_domain = shrunk(domains, of_suffix, ["suffix"])
    of_host = shrunk(hosts, of_domain, ["domain", "suffix"])
    out = of_host.selectExpr("host", "domain", "suffix", "n", "bad", "mean", "weight")
    out = out.union(of_domain.selectExpr("CAST(NULL AS STRING)", "domain", "suffix", "n", "bad", "mean", "weight"))
    out = out.union(of_suffix.selectExpr("CAST(NULL AS STRING)", "CAST(NULL AS STRING)", "suffix", "n", "bad", "mean", "weight"))
    out = out.union(every.selectExpr("CAST(NULL AS STRING)", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)", "n", "bad", "mean", "weight"))
    return out.withColumn("deviation", F.expr("sqrt(mean * (1 - mean) / (weight + 1))")).drop("weight")


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], limit: float = LIMIT, z: float = Z, id: str = "page_id"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, labelled, bad_mean, bad_bound) of every page.

    `outcomes`: (page_id, bad). Hosts are judged once, in a table of hosts, and joined back to the pages.
    """
    host, path = host_and_path()
    parts = pages.select(id, "url", host.alias("_h"), path.alias("_p")).selectExpr(
        id, "coalesce(_h, '') AS host", "coalesce(_p, '') AS path"
    )
    labelled = parts.join(outcomes.select(id, "bad"), id).select("host", "bad")
    found = reputation(labelled)
    domain, suffix = domain_and_suffix()
    hosts = parts.select("host").distinct().withColumn("domain", domain).withColumn("suffix", suffix)
    part = {
        "h": found.where("host IS NOT NULL").selectExpr("host", "n AS h_n", "mean AS h_mean", "deviation AS h_dev"),
        "d": found.where("host IS NULL AND domain IS NOT NULL").selectExpr("domain", "suffix", "mean AS d_mean", "deviation AS d_dev"),
        "s": found.where("domain IS NULL AND suffix IS NOT NULL").selectExpr("suffix", "mean AS s_mean", "deviation AS s_dev"),
        "a": found.where("suffix IS NULL"),
    }
    judged = (
        hosts.join(part["h"], "host", "left").join(part["d"], ["domain", "suffix"], "left").join(part["s"], "suffix", "left")
        .withColumn("a_mean", part["a"].select("mean").scalar()).withColumn("a_dev", part["a"].select("deviation").scalar())
        .selectExpr(
            "host", "CAST(coalesce(h_n, 0) AS BIGINT) AS labelled", "coalesce(h_mean, d_mean, s_mean, a_mean) AS bad_mean",
            f"coalesce(h_mean - {z} * h_dev, d_mean - {z} * d_dev, s_mean - {z} * s_dev, a_mean - {z} * a_dev) AS bad_bound",
        )
    )
    rule, verdict = matching_rule(rules)
    return parts.join(judged, "host").withColumn("rule", rule).withColumn("_v", verdict).selectExpr(
        id, "host", "path", "rule", f"coalesce(_v, CASE WHEN bad_bound > {limit} THEN 'block' ELSE 'allow' END) AS verdict",
        "labelled", "round(bad_mean, 9) AS bad_mean", "round(bad_bound, 9) AS bad_bound",
    )
