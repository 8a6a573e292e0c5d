"""URL filters: rules first, then empirical-Bayes reputations of hosts.

A rule is a host and a path; it fits its host and all subdomains if the url's path starts with its
own. The longest rule that fits decides. Every other page gets its host's verdict: labelled page
outcomes are counted by host, and the share of bad pages is shrunk from host to registered domain, to
suffix, to all pages. Each level has a beta prior with its parent's mean; its strength comes from the
data by moments of the beta-binomial (pooled within parents). A host is blocked if the lower bound of
its posterior share of bad pages (mean less ``z`` standard deviations) exceeds ``limit``.

Labelled outcomes are the pages that rules decide, and any others the caller names.

Pages of one host, however many, are counted before they are shuffled, and the join that brings the
verdicts back splits a hot host. Only ids and urls are read.

Defined cases: a null url, or one without "://", has empty host and path, which is a host like any
other; hosts without outcomes have their domain's prior; without any outcome every page is allowed
unless a rule blocks it; repeated rows are judged alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

#: (rule, verdict), as the registered query uses them.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def registered_domain(h: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """The suffix and one label before it; a host that is a suffix is its own domain."""
    depth = F.when(F.substring_index(h, ".", -2).isin(*suffixes), 3).otherwise(2) if suffixes else F.lit(2)
    return F.when(depth == 3, F.substring_index(h, ".", -3)).otherwise(F.substring_index(h, ".", -2))


def suffix(h: Column, suffixes: tuple[str, ...] = ()) -> Column:
    last = F.substring_index(h, ".", -1)
    return F.when(F.substring_index(h, ".", -2).isin(*suffixes), F.substring_index(h, ".", -2)).otherwise(last) if suffixes else last


def rule_of(h: Column, p: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. The list is part of the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # later ones take precedence
        own, slash, rest = text.partition("/")
        fits = ((h == own) | F.endswith(h, F.lit("." + own))) & F.startswith(p, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _strength(children: DataFrame, parent: str | None) -> float:
    """Prior strength of children (n, bad) around their parents' shares, by moments."""
    seen = children.filter("n > 0")
    per = seen.groupBy(*([parent] if parent else [])).agg(
        F.count("*").cast("double").alias("k"), F.sum("n").cast("double").alias("t"), F.sum("bad").cast("double").alias("b"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("q"),
    )
    share = F.col("b") / F.col("t")
    v = share * (1 - share)
    row = per.filter("t > 0").select(
        (F.col("q") - F.col("b") * share - v * (F.col("k") - 1)).alias("x"), (v * (F.col("t") - F.col("nn") / F.col("t") - (F.col("k") - 1))).alias("y")
    ).agg(F.sum("x").alias("x"), F.sum("y").alias("y")).first()
    rho = row["x"] / row["y"] if row["y"] and row["y"] > 1e-9 else 0.5
    rho = min(0.99, max(0.01, rho))
    return (1 - rho) / rho


def reputations(outcomes: DataFrame, z: float = 1.645, limit: float = 0.5, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """outcomes: (host, n, bad), one row per host. Returns (host, lower, verdict)."""
    h = F.col("host")
    hosts = outcomes.select("host", registered_domain(h, suffixes).alias("domain"), suffix(h, suffixes).alias("suffix"), "n", "bad")

    def total(of: DataFrame, *by: str) -> DataFrame:
        return of.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    domains = total(hosts, "suffix", "domain")
    ends = total(domains, "suffix")
    s_host, s_domain, s_suffix = _strength(hosts, "domain"), _strength(domains, "suffix"), _strength(ends, None)
    row = ends.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    if not row["n"]:
        return hosts.select("host", F.lit(0.0).alias("lower"), F.lit("allow").alias("verdict"))
    overall = (row["bad"] + 1.0) / (row["n"] + 2.0)

    def shrunk(prior: Column, s: float) -> Column:
        return (F.col("bad") + s * prior) / (F.col("n") + s)

    ends = ends.select("suffix", shrunk(F.lit(overall), s_suffix).alias("above"))
    domains = domains.join(ends, "suffix").select("suffix", "domain", shrunk(F.col("above"), s_domain).alias("prior"))
    a, b = F.col("bad") + s_host * F.col("prior"), F.col("n") - F.col("bad") + s_host * (1 - F.col("prior"))
    joined = hosts.join(domains, ["suffix", "domain"]).select("host", a.alias("a"), b.alias("b"))
    t = F.col("a") + F.col("b")
    lower = F.col("a") / t - z * F.sqrt(F.col("a") * F.col("b") / (t * t * (t + 1)))
    return joined.select("host", lower.alias("lower")).withColumn("verdict", F.when(F.col("lower") > limit, "block").otherwise("allow"))


def judge(pages: DataFrame, rules=RULES, outcomes: DataFrame | None = None, **how) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page. outcomes: further labels (host, bad 0/1)."""
    parsed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    decided = parsed.select("*", rule.alias("rule"), ruled.alias("ruled"))
    seen = decided.select("host", F.when(F.col("ruled").isNull(), 0).otherwise(1).alias("n"), F.when(F.col("ruled") == "block", 1).otherwise(0).alias("bad"))
    if outcomes is not None:
        seen = seen.unionByName(outcomes.select("host", F.lit(1).alias("n"), F.col("bad").cast("int").alias("bad")))
    counts = materialise(seen.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "hosts")
    own = reputations(counts, **how).select(F.col("host").alias("r_host"), F.col("verdict").alias("reputed"))
    judged = decided.join(own, F.col("host") == F.col("r_host"), "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", "reputed").alias("verdict"))


def query(spark, sf_dir):
    from .common import table

    return judge(table(spark, sf_dir, "pages"))


ORACLE_SQL = r"""
WITH parsed AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
  END AS rule
  FROM parsed
), decided AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict FROM ruled
), hosts AS (
  SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain,
         string_split(host, '.')[-1] AS suffix, count(verdict)::DOUBLE AS n, count(*) FILTER (verdict = 'block')::DOUBLE AS bad
  FROM decided GROUP BY host
), domains AS (
  SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix, domain
), ends AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix
), overall AS (
  SELECT (sum(bad) + 1) / (sum(n) + 2) AS p FROM ends
), moments AS (
  SELECT 'host' AS level, count(*) AS k, sum(n) AS t, sum(bad) AS b, sum(n * n) AS nn, sum(bad * bad / n) AS q FROM hosts WHERE n > 0 GROUP BY domain
  UNION ALL SELECT 'domain', count(*), sum(n), sum(bad), sum(n * n), sum(bad * bad / n) FROM domains WHERE n > 0 GROUP BY suffix
  UNION ALL SELECT 'suffix', count(*), sum(n), sum(bad), sum(n * n), sum(bad * bad / n) FROM ends WHERE n > 0
), sums AS (
  SELECT level, sum(q - b * (b / t) - b / t * (1 - b / t) * (k - 1)) AS x, sum(b / t * (1 - b / t) * (t - nn / t - (k - 1))) AS y
  FROM moments WHERE t > 0 GROUP BY level
), rho AS (
  SELECT level, least(0.99, greatest(0.01, CASE WHEN y > 1e-9 THEN x / y ELSE 0.5 END)) AS r FROM sums
), s AS (
  SELECT max((1 - r) / r) FILTER (level = 'host') AS host, max((1 - r) / r) FILTER (level = 'domain') AS domain, max((1 - r) / r) FILTER (level = 'suffix') AS suffix
  FROM rho
), ends2 AS (
  SELECT ends.suffix, (bad + s.suffix * p) / (n + s.suffix) AS above FROM ends, s, overall
), domains2 AS (
  SELECT domains.suffix, domains.domain, (bad + s.domain * above) / (n + s.domain) AS prior FROM domains JOIN ends2 USING (suffix), s
), posterior AS (
  SELECT hosts.host, bad + s.host * prior AS a, n - bad + s.host * (1 - prior) AS b FROM hosts JOIN domains2 USING (suffix, domain), s
), reputed AS (
  SELECT host, CASE WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM posterior
)
SELECT page_id, decided.host, path, rule, coalesce(decided.verdict, reputed.verdict) AS verdict
FROM decided LEFT JOIN reputed ON decided.host = reputed.host
"""
