"""URL filters: explicit rules, else an empirical-Bayes reputation of the host, in DataFrame functions alone.

Labelled pages give each host a count of bad outcomes. Its bad rate is shrunk through beta-binomial priors: the suffix towards the
whole, the registered domain towards its suffix, the host towards its domain. How strongly a level shrinks is estimated from
the spread of its groups around their parents (analysis of variance). A page is blocked if the lower bound of the host's
posterior stands above the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

#: (verdict, host, path), as the contract fixes them.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
LIMIT = 0.15
DEVIATIONS = 1.645
#: The strength of a prior, in pages, stays within these.
STRENGTH = (1.0, 1000.0)

# Public suffixes of two labels.
LONG_SUFFIXES = "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.jp ne.jp or.jp ac.jp com.br com.cn com.mx co.in co.kr co.za com.tr com.ar com.sg com.hk com.tw".split()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.regexp_extract(host, "([^.]*\\.[^.]*)$", 1)
    return F.when(two.isin(LONG_SUFFIXES), two).otherwise(F.regexp_extract(host, "([^.]*)$", 1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label more; a host that is no longer than its suffix is its own domain."""
    rest = F.expr("substring(host, 1, length(host) - length(suffix) - 1)")
    return F.when(F.length(suffix) >= F.length(host), host).otherwise(F.concat(F.regexp_extract(rest, "([^.]*)$", 1), F.lit("."), suffix))


def matching_rule(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. The rules are a short list of parameters."""
    fits = []
    for verdict, h, p in rules:
        hit = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        fits.append(F.when(hit, F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.filter(F.array(*fits), lambda x: x.isNotNull()))


def _strength(groups: DataFrame, parent: str) -> Column:
    """One row: the prior's strength from groups (n, k) around the rate of their parent (pn, pk)."""
    p, q = F.col("k") / F.col("n"), F.col("pk") / F.col("pn")
    m, parents, n = F.count(F.lit(1)), F.count_distinct(parent), F.sum("n")
    between = F.sum(F.col("n") * (p - q) * (p - q)) / (m - parents)
    within = F.sum(F.col("n") * p * (1 - p)) / (n - m)
    size = (n - F.sum(F.col("n") * F.col("n") / F.col("pn"))) / (m - parents)
    share = (between - within) / (between + (size - 1) * within)
    low, high = map(F.lit, STRENGTH)
    estimate = F.when((m > parents) & (n > m) & (between > within), F.greatest(low, F.least(high, 1 / share - 1))).otherwise(high)
    return groups.agg(F.coalesce(estimate, high).alias("s"))


def reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, n, k, mean, bound) for every host with labelled pages: posterior mean of its bad rate and the lower bound."""
    outcome = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max("toxic").alias("bad")).filter("bad is not null")
    hosts = pages.join(outcome, "page_id").groupBy("host", "domain", "suffix").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("bad") == 1, 1).otherwise(0)).alias("k"))
    hosts = written(hosts, shared_dir(pages.sparkSession), "hosts")  # one row per labelled host; the pages are read once
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = suffixes.agg(F.sum("n").alias("pn"), F.sum("k").alias("pk"))
    above = lambda df, key: df.select(key, F.col("n").alias("pn"), F.col("k").alias("pk"))
    s_suffix = _strength(suffixes.join(F.broadcast(whole)).withColumn("one", F.lit(1)), "one").withColumnRenamed("s", "s1")
    s_domain = _strength(domains.join(above(suffixes, "suffix"), "suffix"), "suffix").withColumnRenamed("s", "s2")
    s_host = _strength(hosts.join(above(domains, "domain"), "domain"), "domain").withColumnRenamed("s", "s3")
    one = whole.join(F.broadcast(s_suffix)).join(F.broadcast(s_domain)).join(F.broadcast(s_host))  # single rows
    start = (F.col("pk") + 1) / (F.col("pn") + 2)
    by_suffix = suffixes.join(F.broadcast(one)).select("suffix", "s2", "s3", ((F.col("k") + F.col("s1") * start) / (F.col("n") + F.col("s1"))).alias("m1"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", "s3", ((F.col("k") + F.col("s2") * F.col("m1")) / (F.col("n") + F.col("s2"))).alias("m2"))
    both = hosts.join(by_domain, "domain")
    total = F.col("n") + F.col("s3")
    mean = (F.col("k") + F.col("s3") * F.col("m2")) / total
    return both.select("host", "n", "k", mean.alias("mean"), (mean - DEVIATIONS * F.sqrt(mean * (1 - mean) / (total + 1))).alias("bound"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound) for every page.

    labels (doc_id, toxic) hold outcomes of pages by page_id; several of one page count as the worst, a null one as none. A null
    url or one without :// has empty host and path. A host without labelled pages is allowed, with a null bound. Repeated rows
    stay and count as pages each; null ids stay and have no label; an empty table gives no rows.
    """
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    split = named.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    known = reputation(split.select("page_id", "host", "domain", "suffix"), labels).select("host", "bound")
    joined = named.join(known, "host", "left").withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), method).alias("verdict"), "bound")


def oracle(rules=RULES, limit: float = LIMIT) -> str:
    """The same as DuckDB SQL."""
    listed = ",".join(f"('{v}','{h}','{p}')" for v, h, p in rules)
    longer = ",".join(f"'{x}'" for x in LONG_SUFFIXES)
    low, high = STRENGTH

    def strength(groups: str, parent: str) -> str:
        return f"""(SELECT coalesce(CASE WHEN m > ps AND n > m AND b > w THEN greatest({low}, least({high}, 1 / ((b - w) / (b + (size - 1) * w)) - 1)) ELSE {high} END, {high}) AS s FROM (
   SELECT m, ps, n, bs / nullif(m - ps, 0) AS b, ws / nullif(n - m, 0) AS w, (n - nn) / nullif(m - ps, 0) AS size FROM (
   SELECT count(*) AS m, count(DISTINCT {parent}) AS ps, sum(g.n) AS n, sum(g.n * (g.k / g.n - p.k / p.n) * (g.k / g.n - p.k / p.n)) AS bs,
     sum(g.n * (g.k / g.n) * (1 - g.k / g.n)) AS ws, sum(g.n * g.n / p.n) AS nn FROM {groups})))"""

    return f"""
WITH named AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 parts AS (SELECT *, string_split(host, '.') AS l FROM named),
 cut AS (SELECT *, CASE WHEN len(l) >= 2 AND list_contains([{longer}], l[-2] || '.' || l[-1]) THEN 2 ELSE 1 END AS w FROM parts),
 split AS (SELECT page_id, host, path, array_to_string(l[-w:], '.') AS suffix, CASE WHEN len(l) <= w THEN host ELSE array_to_string(l[-(w + 1):], '.') END AS domain FROM cut),
 outcome AS (SELECT doc_id, max(toxic) AS bad FROM labels GROUP BY doc_id HAVING max(toxic) IS NOT NULL),
 hosts AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum((bad = 1)::INT)::DOUBLE AS k FROM split JOIN outcome ON doc_id = page_id GROUP BY ALL),
 domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
 suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
 whole AS (SELECT sum(n) AS n, sum(k) AS k FROM suffixes),
 s1 AS {strength('suffixes g CROSS JOIN whole p', '1')},
 s2 AS {strength('domains g JOIN suffixes p USING (suffix)', 'suffix')},
 s3 AS {strength('hosts g JOIN domains p USING (domain)', 'domain')},
 m1 AS (SELECT x.suffix, (x.k + s1.s * (whole.k + 1) / (whole.n + 2)) / (x.n + s1.s) AS m FROM suffixes x, whole, s1),
 m2 AS (SELECT x.domain, (x.k + s2.s * m1.m) / (x.n + s2.s) AS m FROM domains x JOIN m1 USING (suffix), s2),
 m3 AS (SELECT x.host, x.n + s3.s AS t, (x.k + s3.s * m2.m) / (x.n + s3.s) AS m FROM hosts x JOIN m2 USING (domain), s3),
 rules(verdict, h, p) AS (VALUES {listed}),
 fits AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
   FROM (SELECT DISTINCT host, path FROM named) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, CASE WHEN m3.m - {DEVIATIONS} * sqrt(m3.m * (1 - m3.m) / (t + 1)) > {limit} THEN 'block' ELSE 'allow' END) AS verdict
FROM named s LEFT JOIN fits f ON f.host = s.host AND f.path = s.path LEFT JOIN m3 ON m3.host = s.host"""
