"""URL filters: host and path rules first, then empirical-Bayes host reputation.

A rule names a host and the beginning of a path; it fits the host and all its
subdomains, and the longest fitting rule decides.  Where none fits, the verdict
comes from labelled page outcomes: counts of good and bad pages per host are
shrunk through beta priors, from suffix to registered domain to host, and a page
is allowed if the lower posterior bound of its host's share of good pages reaches
a threshold.  A level's prior strength is estimated from the spread of its rates.

Defined results: a null url, or one without "://", has an empty host and path and
no rule; such pages share the reputation of the empty host.  Pages without an
outcome still get their host's verdict.  With no outcomes at all every posterior
is the uniform prior.  Repeated rows are judged one by one; an outcome table must
hold one row per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import ascii_lower

#: Prior strengths are kept within these bounds.
STRENGTH = (1.0, 1000.0)
#: The posterior mean less Z standard deviations must reach THRESHOLD.
Z, THRESHOLD = 1.0, 0.5
#: Country suffixes under which names are registered at the third level.
SECOND_LEVEL = ("co", "com", "org", "net", "ac", "gov", "edu")

SCHEME = "://"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.locate(SCHEME, url)
    rest = F.when(at > 0, F.substring(url, at + len(SCHEME), F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(F.coalesce(tail, F.lit("")), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_of(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does.

    Rules are (verdict, host and path).  They become one CASE expression, so the
    list is meant to be short (some hundred rules).
    """
    fits, verdicts = [], []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        rule_host, slash, rule_path = rule.partition("/")
        fit = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        fits.append(F.when(fit, F.lit(rule)))
        verdicts.append(F.when(fit, F.lit(verdict)))
    none = F.lit(None).cast("string")
    return F.coalesce(*fits, none), F.coalesce(*verdicts, none)


def registered(host: Column) -> Column:
    labels = F.split(host, r"\.")
    deep = (F.size(labels) >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL)
    return F.when(deep, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def strength(groups: DataFrame, n: str, good: str, mean: Column) -> DataFrame:
    """One row: the strength of the prior around mean, by the method of moments."""
    big = F.col(n) > 0
    rate = F.col(good) / F.col(n)
    spread = groups.filter(big).agg(
        F.sum(F.col(n) * (rate - mean) * (rate - mean)).alias("ss"),
        F.sum(F.col(n) * mean * (1 - mean)).alias("pq"),
        F.count("*").alias("k"),
        F.sum(n).alias("n"),
    )
    # E[ss] = pq / n * (k + (n - k) * rho), with rho the correlation within a group.
    rho = (F.col("ss") / F.col("pq") * F.col("n") - F.col("k")) / (F.col("n") - F.col("k"))
    kappa = F.when((F.col("pq") > 0) & (F.col("n") > F.col("k")) & (rho > 0), 1 / rho - 1).otherwise(STRENGTH[1])
    return spread.select(F.least(F.greatest(kappa, F.lit(STRENGTH[0])), F.lit(STRENGTH[1])).alias("kappa"))


def posterior(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """child (key, parent_key, n, good) with its posterior mean m and counts a, b."""
    c = child.join(parent.select(parent_key, F.col("m").alias("pm")), parent_key)
    c = c.withColumn("kappa", strength(c, "n", "good", F.col("pm")).scalar())
    a = F.col("good") + F.col("kappa") * F.col("pm")
    b = F.col("n") - F.col("good") + F.col("kappa") * (1 - F.col("pm"))
    return c.select(key, F.col("n"), F.col("good"), a.alias("a"), b.alias("b"), (a / (a + b)).alias("m"))


def reputation(hosts: DataFrame) -> DataFrame:
    """hosts (host, n, good), one row each, with the lower posterior bound."""
    h = hosts.select("host", registered(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"), "n", "good")
    total = F.sum("n").alias("n"), F.sum("good").alias("good")
    domains = h.groupBy("domain", "suffix").agg(*total)
    suffixes = domains.groupBy("suffix").agg(*total)
    root = suffixes.agg(F.coalesce(((F.sum("good") + 1) / (F.sum("n") + 2)), F.lit(0.5)).alias("m"))
    top = suffixes.withColumn("root", F.lit(0))
    s = posterior(top, "suffix", root.withColumn("root", F.lit(0)), "root")
    d = posterior(domains, "domain", s, "suffix")
    p = posterior(h, "host", d, "domain")
    a, b = F.col("a"), F.col("b")
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return p.select("host", "n", "good", F.col("m").alias("mean"), (F.col("m") - Z * sd).alias("bound"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], outcomes: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and bound for every page.

    outcomes: (page_id, good) with good 1 or 0, for as many pages as there are.
    """
    host, path = host_path(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = outcomes.filter(F.col("good").isNotNull()).select(F.col("page_id").alias("page_id"), F.col("good").cast("int").alias("good"))
    hosts = (
        p.join(seen, "page_id", "left").groupBy("host")
        .agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    )
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    judged = F.when(F.col("bound") >= THRESHOLD, "allow").otherwise("block")
    return p.join(reputation(hosts).select("host", "bound"), "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict"), F.round("bound", 6).alias("bound")
    )


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def level(name: str, child: str, key: str, parent: str, parent_key: str) -> str:
    """Oracle SQL of one shrinking step."""
    return f"""
{name}_c AS (SELECT c.*, p.m AS pm FROM {child} c JOIN {parent} p USING ({parent_key})),
{name}_s AS (SELECT sum(n * (good / n - pm) * (good / n - pm)) AS ss, sum(n * pm * (1 - pm)) AS pq, count(*) AS k, sum(n) AS n
             FROM {name}_c WHERE n > 0),
{name}_r AS (SELECT CASE WHEN pq > 0 AND n > k THEN (ss / pq * n - k) / (n - k) END AS rho FROM {name}_s),
{name}_k AS (SELECT least(greatest(CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE 1000.0 END, 1.0), 1000.0) AS kappa FROM {name}_r),
{name} AS (SELECT *, a / (a + b) AS m FROM (SELECT c.{key}, c.n, c.good, c.good + kappa * pm AS a, c.n - c.good + kappa * (1 - pm) AS b
           FROM {name}_c c, {name}_k))"""


ORACLE = rf"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS host, rest FROM p),
u AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(substr(rest, length(host) + 1), '^[^?#]*'), '') AS path FROM q),
o AS (SELECT doc_id AS page_id, CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END AS good FROM labels),
h AS (SELECT host, string_split(host, '.') AS w, count(good) AS n, coalesce(sum(good), 0)::DOUBLE AS good FROM u LEFT JOIN o USING (page_id) GROUP BY host),
hosts AS (SELECT host, w[-1] AS suffix, n, good,
                 CASE WHEN len(w) >= 3 AND length(w[-1]) = 2 AND w[-2] IN ('co', 'com', 'org', 'net', 'ac', 'gov', 'edu')
                      THEN array_to_string(w[-3:], '.') ELSE array_to_string(w[-2:], '.') END AS domain FROM h),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good, 0 AS root FROM domains GROUP BY suffix),
r AS (SELECT 0 AS root, (sum(good) + 1) / (sum(n) + 2) AS m FROM suffixes),
{level("sp", "suffixes", "suffix", "r", "root")},
{level("dp", "domains", "domain", "sp", "suffix")},
{level("hp", "hosts", "host", "dp", "domain")},
b AS (SELECT host, m - 1.0 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM hp),
f AS (SELECT u.*, bound, CASE
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
      FROM u JOIN b USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END AS verdict, round(bound, 6) AS bound
FROM f
"""
