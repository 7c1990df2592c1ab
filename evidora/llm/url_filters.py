"""URL filters by Empirical-Bayes host reputation, DataFrame functions only.

Labelled page outcomes (bad or not) are counted by host. Beta-binomial priors shrink the counts from the whole
corpus to the suffix, from there to the registered domain, and from there to the host; a group's prior is
the rate of its parent's other groups, and each level's strength is fitted by moments from how far counts stray from
their priors. A host is blocked when the lower bound of its posterior bad rate is above a limit. List rules for host
and path prefix go first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

#: The list rules of the contract, host and path prefix.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A page counts as bad with at least so many runs of marks; the pattern is the same in Java and RE2.
JUNK, JUNK_RUNS = r"[*#$%&]{3}|!! ", 5
#: Block above this bad rate, at this many posterior standard deviations below the mean.
RATE, BOUND = 0.25, 1.64
#: Bounds of a prior's strength in pages; the lower keeps one or two pages from condemning a host.
STRENGTHS = (5.0, 10_000.0)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_match(rules: tuple) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; a short list is one expression, no join."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    two = F.substring_index(host, ".", -2).isin(*TWO_LABEL_SUFFIXES)
    domain = F.when(two, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return domain, F.when(two, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def _strength(groups: DataFrame) -> float:
    """Prior strength from groups (n, k, m): how much more than binomially k strays from n times its parent's rate."""
    spread = F.col("m") * (1 - F.col("m"))
    row = groups.agg(
        F.sum(F.pow(F.col("k") - F.col("n") * F.col("m"), 2) - F.col("n") * spread).alias("over"),
        F.sum(F.col("n") * (F.col("n") - 1) * spread).alias("room"),
    ).first()
    rho = row["over"] / row["room"] if row["room"] else 1.0
    low, high = STRENGTHS
    return min(high, max(low, 1 / rho - 1)) if rho > 0 else high


def _shrunk(groups: DataFrame, strength: float) -> Column:
    return (F.col("k") + strength * F.col("m")) / (F.col("n") + strength)


def _below(groups: DataFrame, parents: DataFrame, key: str, strength: float) -> DataFrame:
    """Add ``m`` to groups: the shrunk rate of the parent's other groups, so that no outcome counts at two levels."""
    parents = parents.select(key, F.col("n").alias("_n"), F.col("k").alias("_k"), F.col("m").alias("_m"))
    rate = (F.col("_k") - F.col("k") + strength * F.col("_m")) / (F.col("_n") - F.col("n") + strength)
    return groups.join(parents, key).withColumn("m", rate).drop("_n", "_k", "_m")


def host_reputation(pages: DataFrame) -> DataFrame:
    """(host, rate, bound) from pages with ``host`` and ``bad`` (1, 0, or null where unlabelled).

    Counts are summed before any row moves, so a host with a third of the pages is as cheap as another; what is
    joined afterwards has one row per host. Returned to the driver: three pairs of sums.
    """
    domain, suffix = domain_of(F.col("host"))
    hosts = pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k"))
    hosts = written(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = (total["k"] or 0) / total["n"] if total["n"] else 0.0
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    suffixes = hosts.groupBy("suffix").agg(*sums).withColumn("m", F.lit(mean))
    domains = _below(hosts.groupBy("domain", "suffix").agg(*sums), suffixes, "suffix", _strength(suffixes))
    hosts = _below(hosts, domains, "domain", _strength(domains))
    s = _strength(hosts)
    rate = _shrunk(hosts, s)
    spread = F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(s) + 1))
    return hosts.select("host", rate.alias("rate"), (rate - BOUND * spread).alias("bound"))


def url_filter(pages: DataFrame, bad: Column, rules: tuple = RULES, limit: float = RATE) -> DataFrame:
    """Add host, path, rule, verdict and the host's ``bad_rate`` and ``bad_bound`` to pages with a ``url``.

    Null urls and urls without ``://`` have empty host and path, which form one host of their own. Repeated rows are
    judged alike and each counts as an outcome. Columns of these names in the input are replaced. An empty table
    gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    pages = pages.withColumn("_bad", bad.cast("int")).withColumns({"host": host, "path": path})
    known = host_reputation(pages.select("host", F.col("_bad").alias("bad")))
    rule, verdict = rule_match(rules)
    known = known.select("host", F.col("rate").alias("bad_rate"), F.col("bound").alias("bad_bound"))
    judged = pages.drop("_bad", "bad_rate", "bad_bound").join(known, "host", "left").withColumns({"rule": rule, "verdict": verdict})
    return judged.withColumn("verdict", F.coalesce("verdict", F.when(F.col("bad_bound") > limit, F.lit("block")).otherwise(F.lit("allow"))))


def junk_page(html: Column) -> Column:
    """The labelled outcome that the page's own text gives: 1 for junk, 0 for prose, null without html."""
    return (F.regexp_count(html, F.lit(JUNK)) >= JUNK_RUNS).cast("int")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's verdict: page_id, host, path, rule, verdict."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", junk_page(F.col("html")).alias("bad"))
    return url_filter(pages, F.col("bad")).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
         CASE WHEN len(regexp_extract_all(html, '[*#$%&]{3}|!! ')) >= 5 THEN 1 WHEN html IS NOT NULL THEN 0 END AS bad
  FROM pages),
u AS (
  SELECT page_id, bad, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, string_split(host, '.') AS parts FROM u GROUP BY host),
h AS (SELECT host, n, k, array_to_string(parts[-2:], '.') AS domain, parts[-1] AS suffix FROM h0),
g AS (SELECT sum(k) / sum(n)::DOUBLE AS m FROM h),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(g.m) AS m FROM h, g GROUP BY suffix),
sp AS (SELECT sum((k - n * m) * (k - n * m) - n * m * (1 - m)) AS a, sum(n * (n - 1) * m * (1 - m)) AS b FROM s),
ss AS (SELECT CASE WHEN b IS NULL OR b = 0 THEN 5.0 WHEN a <= 0 THEN 10000.0 ELSE least(10000.0, greatest(5.0, b / a - 1)) END AS s FROM sp),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
dj AS (SELECT d.domain, d.n, d.k, (s.k - d.k + ss.s * s.m) / (s.n - d.n + ss.s) AS m FROM d JOIN s USING (suffix), ss),
dp AS (SELECT sum((k - n * m) * (k - n * m) - n * m * (1 - m)) AS a, sum(n * (n - 1) * m * (1 - m)) AS b FROM dj),
ds AS (SELECT CASE WHEN b IS NULL OR b = 0 THEN 5.0 WHEN a <= 0 THEN 10000.0 ELSE least(10000.0, greatest(5.0, b / a - 1)) END AS s FROM dp),
hj AS (SELECT h.host, h.n, h.k, (dj.k - h.k + ds.s * dj.m) / (dj.n - h.n + ds.s) AS m FROM h JOIN dj USING (domain), ds),
hp AS (SELECT sum((k - n * m) * (k - n * m) - n * m * (1 - m)) AS a, sum(n * (n - 1) * m * (1 - m)) AS b FROM hj),
hs AS (SELECT CASE WHEN b IS NULL OR b = 0 THEN 5.0 WHEN a <= 0 THEN 10000.0 ELSE least(10000.0, greatest(5.0, b / a - 1)) END AS s FROM hp),
hr AS (SELECT host, n, hs.s AS s, (k + hs.s * m) / (n + hs.s) AS r FROM hj, hs),
hb AS (SELECT host, r - 1.64 * sqrt(r * (1 - r) / (n + s + 1)) AS bound FROM hr),
j AS (
  SELECT page_id, host, path, bound, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/' END AS rule
  FROM u LEFT JOIN hb USING (host))
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN bound > 0.25 THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""
