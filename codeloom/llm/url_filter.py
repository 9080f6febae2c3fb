"""URL filters: fixed rules, and beyond them an empirical-Bayes reputation of hosts.

Labelled pages tell how many of a host's pages are bad. A host with few of them says little, so its rate is shrunk
to that of its registered domain, the domain's to its suffix, and the suffix's to all pages: each level has a beta
prior around its parent's posterior mean, and how strongly it pulls (the prior's weight in pages) is estimated by
moments from how much the level's groups differ beyond chance. A host is blocked if a lower bound of its posterior
rate of bad pages is over a limit, so for lack of evidence it is allowed.

Counts of all pages are aggregated by host before they meet anything; only three weights and one rate, a row of four
numbers, pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.scratch import Scratch

#: (verdict, host, path): a rule fits its host and all subdomains, for paths that begin with its path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Suffixes of two labels under which domains are registered; others are one label.
LONG_SUFFIXES = ["ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "com.mx", "gov.uk", "net.au", "org.au", "org.uk"]
LIMIT = 0.5
Z = 1.645
MOST_RULES = 256


def host_of(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), _lower(F.regexp_extract(_after(url), r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _after(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def _levels(host: Column) -> tuple[Column, Column]:
    """The registered domain and the suffix of a host."""
    labels = F.split(F.regexp_replace(host, r":[0-9]*$", ""), r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), ".")
    long = last(2).isin(LONG_SUFFIXES)
    return F.when(long, last(3)).otherwise(last(2)), F.when(long, last(2)).otherwise(last(1))


def _weight(groups: DataFrame, parent: str) -> float:
    """The prior's weight in pages at a level, from groups (n, k) and their parents' means, by moments."""
    m, n, p = F.col(parent), F.col("n"), F.col("k") / F.col("n")
    over = F.sum(n * ((p - m) * (p - m)) - m * (1 - m))
    room = F.sum((n - 1) * m * (1 - m))
    row = groups.where("n > 0").agg(over.alias("over"), room.alias("room")).first()
    rho = (row["over"] or 0.0) / row["room"] if row["room"] else 0.0
    return 1 / min(max(rho, 0.001), 0.9) - 1


def host_reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, domain, suffix, n, k, mean, bound) from ``pages`` (page_id, host) and ``outcomes`` (page_id, bad 0 or 1).

    n and k count the labelled and the bad pages; mean is the posterior's, bound its mean less Z deviations.
    """
    told = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = pages.join(told, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    domain, suffix = _levels(F.col("host"))
    # the weights and the result all come from these counts, so pages are read once for them
    hosts = Scratch(pages.sparkSession, "hosts").keep(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n"), F.sum("k")).first()
    m0 = (total[1] + 1) / (total[0] + 2) if total[0] else 0.5

    def shrunk(df: DataFrame, weight: float, parent: str, name: str) -> DataFrame:
        return df.withColumn(name, (F.col("k") + weight * F.col(parent)) / (F.col("n") + weight))

    suffixes = suffixes.withColumn("m0", F.lit(m0))
    suffixes = shrunk(suffixes, _weight(suffixes, "m0"), "m0", "m1").select("suffix", "m1")
    domains = domains.join(suffixes, "suffix")
    domains = shrunk(domains, _weight(domains, "m1"), "m1", "m2").select("domain", "m2")
    hosts = hosts.join(domains, "domain")
    weight = _weight(hosts, "m2")
    hosts = shrunk(hosts, weight, "m2", "mean")
    total = F.col("n") + weight
    return hosts.withColumn("bound", F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (total + 1))).drop("m2")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] | None = None, limit: float = LIMIT) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, bound.

    ``outcomes`` (page_id, bad 0 or 1) are labelled pages. The verdict is the longest fitting rule's; without one it
    is block if the host's bound is over ``limit``, else allow. A null url, or one without ``://``, has an empty
    host and path, fits no rule and shares the reputation of such urls. A null page_id has no label. An id that is
    labelled or given more than once counts each of its rows, with its worst label. Further columns are not read.
    """
    rules = RULES if rules is None else rules
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    url = F.coalesce("url", F.lit(""))
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    known = host_reputation(parsed.select("page_id", "host"), outcomes).select("host", "bound")
    rule, verdict = _rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return parsed.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bound")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is bad if the document of its number is labelled toxic or of low quality."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.cast("int").alias("bad"))
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), outcomes).drop("bound")


SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
h AS (SELECT page_id, translate(coalesce(regexp_extract(r, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
o AS (SELECT doc_id AS page_id, max(((quality = 0) OR (toxic = 1))::INT) AS bad FROM labels WHERE doc_id IS NOT NULL AND ((quality = 0) OR (toxic = 1)) IS NOT NULL GROUP BY 1),
g AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k FROM h LEFT JOIN o USING (page_id) GROUP BY host),
gl AS (SELECT *, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS ls FROM g),
gs AS (SELECT host, n, k, list_contains(['ac.uk', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'com.au', 'com.br', 'com.cn', 'com.mx', 'gov.uk', 'net.au', 'org.au', 'org.uk'], array_to_string(ls[-2:], '.')) AS lg, ls FROM gl),
gd AS (SELECT host, n, k, array_to_string(CASE WHEN lg THEN ls[-3:] ELSE ls[-2:] END, '.') AS domain, array_to_string(CASE WHEN lg THEN ls[-2:] ELSE ls[-1:] END, '.') AS suffix FROM gs),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM gd GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY 1),
t AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(k) + 1) / (sum(n) + 2) ELSE 0.5 END AS m0 FROM s),
w1 AS (SELECT 1 / least(greatest(coalesce(sum(n * (k / n - m0) ** 2 - m0 * (1 - m0)) / nullif(sum((n - 1) * m0 * (1 - m0)), 0), 0), 0.001), 0.9) - 1 AS w FROM s, t WHERE n > 0),
s1 AS (SELECT suffix, (k + w * m0) / (n + w) AS m1 FROM s, t, w1),
d1 AS (SELECT d.*, m1 FROM d JOIN s1 USING (suffix)),
w2 AS (SELECT 1 / least(greatest(coalesce(sum(n * (k / n - m1) ** 2 - m1 * (1 - m1)) / nullif(sum((n - 1) * m1 * (1 - m1)), 0), 0), 0.001), 0.9) - 1 AS w FROM d1 WHERE n > 0),
d2 AS (SELECT domain, (k + w * m1) / (n + w) AS m2 FROM d1, w2),
g2 AS (SELECT gd.*, m2 FROM gd JOIN d2 USING (domain)),
w3 AS (SELECT 1 / least(greatest(coalesce(sum(n * (k / n - m2) ** 2 - m2 * (1 - m2)) / nullif(sum((n - 1) * m2 * (1 - m2)), 0), 0), 0.001), 0.9) - 1 AS w FROM g2 WHERE n > 0),
g3 AS (SELECT host, n + w AS tot, (k + w * m2) / (n + w) AS m FROM g2, w3),
b AS (SELECT host, m - 1.645 * sqrt(m * (1 - m) / (tot + 1)) AS bound FROM g3),
r AS (SELECT h.*, bound,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM h LEFT JOIN b USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
