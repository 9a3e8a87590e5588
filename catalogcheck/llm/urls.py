"""URL filters: path rules first, then an empirical-Bayes reputation of the host.

A labelled page's outcome is bad if its label says quality 0 or toxic 1. Rates are shrunk from level to level: the
suffix towards the rate of all pages, the registered domain towards its suffix, the host towards its domain, each by
a beta-binomial prior whose weight is estimated from the spread of that level's groups (method of moments). A host
is blocked when the lower bound of its posterior bad rate lies above FACTOR times the rate of all pages (at most MOST), so
an unseen host, which inherits its domain's or suffix's rate with a wide bound, is blocked only on strong evidence. The
bound is the normal approximation of the beta posterior's quantile. A port is no part of a domain; an IP address is a domain of its own.

Everything is DataFrame functions: counts are pre-aggregated by host before any level is built, so a host with a
third of all pages costs one row per task, and the only join on host is with the one-row-per-host table, which
adaptive execution broadcasts when small and splits when skewed.

Defined results: a null url, or one without ``://``, has an empty host and path and the verdict of the unknown host
(the overall rate); repeated pages are judged each, and pages of one id are labelled alike; without any label the rate is the prior mean
0.5 and all pages without a rule are allowed; label rows of one page count once (bad if any is); very long urls are read whole;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Second labels that make a suffix of two labels below a country's two letters (co.uk, com.au); all others are the last label.
SECOND = ("ac", "co", "com", "edu", "gov", "ne", "net", "or", "org")
#: A host is blocked when its bound lies above FACTOR times the overall rate (and above MOST, where that is less); Z is the bound's normal quantile.
FACTOR, MOST, Z = 1.5, 0.9, 1.645
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    return F.when(F.instr(url, "://") > 0, F.translate(host, UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, path).otherwise("")


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits (its text, its verdict), null if none."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _name(host: Column) -> Column:
    """The host without its port."""
    return F.regexp_replace(host, ":[0-9]*$", "")


def _is_address(name: Column) -> Column:
    return F.rlike(name, F.lit(r"^[0-9]+(\.[0-9]+){3}$"))


def _is_long(name: Column) -> Column:
    """Whether the suffix has two labels."""
    return F.rlike(name, F.lit(r"(^|\.)(" + "|".join(SECOND) + r")\.[a-z]{2}$"))


def suffix_of(host: Column) -> Column:
    name = _name(host)
    return F.when(_is_address(name), name).when(_is_long(name), F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    name = _name(host)
    return F.when(_is_address(name), name).when(_is_long(name), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def prior_weight(groups: DataFrame) -> DataFrame:
    """One row: the weight of a level's prior, from groups (n, k, parent rate ``up``).

    The spread of group rates around their parents' rates beyond binomial noise gives the correlation rho within
    groups; a beta prior of weight (1 - rho) / rho has it. rho is kept within 0.001 to 0.5, and is 0.1 where no
    group has two labelled pages.
    """
    n, k, up = F.col("n"), F.col("k"), F.col("up")
    sums = groups.filter(n > 0).agg(
        F.sum(n * (k / n - up) * (k / n - up)).alias("s"),
        F.sum(up * (1 - up)).alias("noise"),
        F.sum((n - 1) * up * (1 - up)).alias("room"),
    )
    rho = F.when(F.col("room") > 0, (F.col("s") - F.col("noise")) / F.col("room")).otherwise(0.1)
    rho = F.round(F.least(F.greatest(rho, F.lit(0.001)), F.lit(0.5)), 9)
    return sums.select(((1 - F.coalesce(rho, F.lit(0.1))) / F.coalesce(rho, F.lit(0.1))).alias("m"))


def shrink(groups: DataFrame, rate: str) -> DataFrame:
    """``groups`` (n, k, up) with the posterior mean ``rate`` and its beta parameters' sum ``weight``."""
    out = groups.crossJoin(F.broadcast(prior_weight(groups)))  # one row: the level's prior weight
    n, k, up, m = F.col("n"), F.col("k"), F.col("up"), F.col("m")
    return out.withColumns({rate: F.round((k + m * up) / (n + m), 12), "weight": n + m}).drop("m")


def host_reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, n, k (labelled pages, bad ones), rate, low (lower bound of the posterior bad rate), limit, for every host."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNull() & F.col("toxic").isNull(), None).otherwise(0)
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    seen = pages.select("page_id", host_of(F.col("url")).alias("host")).fillna({"host": ""})
    hosts = seen.join(marks, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = tk.written(hosts, "hosts")  # all levels are built from this one row for each host
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.round((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2), 12).alias("up"))
    s = shrink(suffixes.crossJoin(F.broadcast(total)), "rate").select("suffix", F.col("rate").alias("up"))  # one row: the overall rate
    d = shrink(domains.join(s, "suffix"), "rate").select("domain", F.col("rate").alias("up"))
    h = shrink(hosts.join(d, "domain"), "rate")
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    h = h.crossJoin(F.broadcast(total.withColumnRenamed("up", "overall")))  # one row
    limit = F.least(F.lit(MOST), FACTOR * F.col("overall"))
    return h.select("host", "n", "k", F.round("rate", 9).alias("rate"), F.round(F.col("rate") - Z * sd, 9).alias("low"), F.round(limit, 9).alias("limit"))


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's posterior rate and bound."""
    split = pages.select("page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"))
    method = F.when(F.col("low") > F.col("limit"), "block").otherwise("allow")
    return split.join(host_reputation(pages, labels), "host").select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.col("rate").alias("bad_rate"), F.col("low").alias("bad_rate_low"))


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return judge(pages, labels)


ORACLE = r"""
WITH p AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url[strpos(url, '://') + 3:], '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url[strpos(url, '://') + 3:], '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL AND toxic IS NULL THEN NULL ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), h AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k,
    regexp_replace(host, ':[0-9]*$', '') AS name, CASE WHEN regexp_matches(name, '^[0-9]+(\.[0-9]+){3}$') THEN 9 WHEN regexp_matches(name, '(^|\.)(ac|co|com|edu|gov|ne|net|or|org)\.[a-z]{2}$') THEN 3 ELSE 2 END AS parts
  FROM p LEFT JOIN marks ON page_id = doc_id GROUP BY host
), h2 AS (
  SELECT *, array_to_string(string_split(name, '.')[-parts:], '.') AS domain, array_to_string(string_split(name, '.')[1 - parts:], '.') AS suffix FROM h
), d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h2 GROUP BY ALL
), s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL
), g AS (SELECT round((sum(k) + 1) / (sum(n) + 2), 12) AS up FROM s
), s1 AS (SELECT s.*, up FROM s, g
), sm AS (SELECT round(least(greatest(coalesce(CASE WHEN sum((n - 1) * up * (1 - up)) > 0 THEN (sum(n * (k / n - up) * (k / n - up)) - sum(up * (1 - up))) / sum((n - 1) * up * (1 - up)) END, 0.1), 0.001), 0.5), 9) AS rho FROM s1 WHERE n > 0
), s2 AS (SELECT suffix, round((k + (1 - rho) / rho * up) / (n + (1 - rho) / rho), 12) AS up FROM s1, sm
), d1 AS (SELECT d.*, up FROM d JOIN s2 USING (suffix)
), dm AS (SELECT round(least(greatest(coalesce(CASE WHEN sum((n - 1) * up * (1 - up)) > 0 THEN (sum(n * (k / n - up) * (k / n - up)) - sum(up * (1 - up))) / sum((n - 1) * up * (1 - up)) END, 0.1), 0.001), 0.5), 9) AS rho FROM d1 WHERE n > 0
), d2 AS (SELECT domain, round((k + (1 - rho) / rho * up) / (n + (1 - rho) / rho), 12) AS up FROM d1, dm
), h3 AS (SELECT h2.*, up FROM h2 JOIN d2 USING (domain)
), hm AS (SELECT round(least(greatest(coalesce(CASE WHEN sum((n - 1) * up * (1 - up)) > 0 THEN (sum(n * (k / n - up) * (k / n - up)) - sum(up * (1 - up))) / sum((n - 1) * up * (1 - up)) END, 0.1), 0.001), 0.5), 9) AS rho FROM h3 WHERE n > 0
), h4 AS (SELECT host, round((k + (1 - rho) / rho * up) / (n + (1 - rho) / rho), 12) AS rate, n + (1 - rho) / rho AS weight FROM h3, hm
), h5 AS (SELECT host, round(rate, 9) AS rate, round(rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)), 9) AS low, round(least(0.9, 1.5 * up), 9) AS most FROM h4, g
), r AS (
  SELECT page_id, host, path, rate, low, most,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p JOIN h5 USING (host)
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN low > most THEN 'block' ELSE 'allow' END AS verdict,
  rate AS bad_rate, low AS bad_rate_low
FROM r
"""

QUERIES = {"op10_url_filter": op10_url_filter}
ORACLES = {"op10_url_filter": ORACLE}
