"""URL filters: explicit host and path rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (good or not) are counted by host, registered domain and suffix. Each level's rate is shrunk towards
the level above by a beta-binomial prior whose strength is fitted by moments over that level's groups: suffixes towards the
overall rate, domains towards their suffix, hosts towards their domain; the uncertainty of the level above is carried along.
A host is blocked if the posterior probability of a bad page exceeds ``bad_share`` even at its lower bound, ``z`` posterior
standard deviations below the mean; so a host with few labels, or none, is judged by its domain and suffix, and is allowed
while the evidence is thin. All of it is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keep

#: Suffixes of two labels under which domains are registered; every other suffix is the last label. A table of all public suffixes can stand in for them.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "co.nz", "gov.uk", "org.uk")
#: Host, path and verdict of the rules.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without a host part."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    """The last label, or one of the known suffixes of two."""
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(*LONG_SUFFIXES), last_two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and one more label; a host without one is its own domain."""
    return F.when(F.substring_index(host, ".", -2).isin(*LONG_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host followed by path) and its verdict; nulls if none does. Of equally long rules the first in sorted order wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))[::-1]:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _shrunk(level: DataFrame) -> DataFrame:
    """level (.., n, s, prior, prior_var) with rate, the posterior mean, and var, its variance with that of the prior.

    The prior's strength is fitted by moments over the level and kept in 1..1000; three sums of the level reach the driver."""
    q = F.col("prior")
    seen, one, more = level.agg(F.sum(F.pow(F.col("s") - F.col("n") * q, 2)), F.sum(F.col("n") * q * (1 - q)), F.sum(F.col("n") * (F.col("n") - 1) * q * (1 - q))).first()
    # beta-binomial: E (s - nq)^2 = nq(1-q) (1 + (n-1)/(m+1))
    m = more / (seen - one) - 1 if seen is not None and seen > one and more > 0 else 1000.0
    m = min(1000.0, max(1.0, m))
    rows = level.withColumn("rate", (F.col("s") + m * q) / (F.col("n") + m))
    return rows.withColumn("var", F.col("rate") * (1 - F.col("rate")) / (F.col("n") + m + 1) + F.pow(m / (F.col("n") + m), 2) * F.col("prior_var"))


def placed_by(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``hosts`` (host, ..) with domain and suffix by a table of suffixes (suffix: labels joined by dots, without rules or wild cards): the longest
    that ends the host, else its last label."""
    known = suffixes.select(F.lower(F.trim("suffix")).alias("suffix")).where("suffix != ''").distinct()
    most = known.agg(F.max(F.size(F.split("suffix", r"\.")))).first()[0] or 1
    ends = hosts.select("host", F.explode(F.sequence(F.lit(1), F.least(F.size(F.split("host", r"\.")), F.lit(most)))).alias("labels"))
    longest = ends.withColumn("suffix", F.expr("substring_index(host, '.', -labels)")).join(known, "suffix").groupBy("host").agg(F.max("labels").alias("labels"))
    both = hosts.join(longest, "host", "left").withColumn("labels", F.coalesce("labels", F.lit(1)))
    return both.withColumns({"domain": F.expr("substring_index(host, '.', -labels - 1)"), "suffix": F.expr("substring_index(host, '.', -labels)")}).drop("labels")


def host_reputation(outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """From (host, bad 0/1, null for unlabelled pages): host, n (labelled), s (bad), prior, rate (posterior mean), var, spread."""
    counts = outcomes.where("host is not null").groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("s"))
    named = counts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}) if suffixes is None else placed_by(counts, suffixes)
    hosts = keep(named, "hosts")
    domains = keep(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    n, s = domains.agg(F.sum("n"), F.sum("s")).first()
    above = lambda rows, key: rows.select(key, F.col("rate").alias("prior"), F.col("var").alias("prior_var"))
    suffixes = _shrunk(suffixes.withColumns({"prior": F.lit(((s or 0.0) + 0.5) / ((n or 0.0) + 1.0)), "prior_var": F.lit(0.0)}))
    domains = _shrunk(domains.join(above(suffixes, "suffix"), "suffix"))
    hosts = keep(_shrunk(hosts.join(above(domains, "domain"), "domain")), "reputation")
    return hosts.withColumn("spread", F.sqrt("var"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, bad_share: float = 0.5, z: float = 1.645, id_col: str = "page_id", url_col: str = "url", suffixes: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the reputation's bad_rate and bad_bound.

    ``outcomes`` holds (page_id, bad) with bad 0 or 1. A null url, or one without ``://``, has an empty host and path; it is
    judged like any host. A host without labels has its domain's rate, or its suffix's. Repeated pages are judged each for itself; an outcome counts
    once for each row of ``outcomes`` and each page row with its id. ``suffixes`` (suffix) names the suffixes under which domains are registered; without it they
    are the last label and the few of LONG_SUFFIXES, so that hosts under any other long suffix share one domain's prior. Urls of any length are read. The join from pages to
    hosts carries ids and urls only; a host with a great share of all pages is split by adaptive execution, and where the
    reputations turn out to be small the engine broadcasts them under its own size limit.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    labelled = rows.join(outcomes.where("page_id is not null and bad is not null").select("page_id", "bad"), "page_id", "left").select("host", "bad")
    known = host_reputation(labelled, suffixes).select("host", F.col("rate").alias("bad_rate"), (F.col("rate") - z * F.col("spread")).alias("bad_bound"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_bound") > bad_share, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_rate", "bad_bound")


SQL = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
parts AS (SELECT *, string_split(host, '.') AS l FROM p),
named AS (SELECT page_id, host, path,
                 CASE WHEN array_to_string(l[-2:], '.') IN ('ac.uk', 'co.jp', 'co.uk', 'com.au', 'com.br', 'co.nz', 'gov.uk', 'org.uk') THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
                 CASE WHEN array_to_string(l[-2:], '.') IN ('ac.uk', 'co.jp', 'co.uk', 'com.au', 'com.br', 'co.nz', 'gov.uk', 'org.uk') THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM parts),
h AS (SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, CAST(count(doc_id) AS DOUBLE) AS n,
             CAST(sum(CASE WHEN doc_id IS NULL OR (quality = 1 AND toxic = 0) THEN 0 ELSE 1 END) AS DOUBLE) AS s FROM named LEFT JOIN labels ON doc_id = page_id GROUP BY host),
d AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(s) AS s FROM h GROUP BY domain),
x AS (SELECT suffix, sum(n) AS n, sum(s) AS s FROM d GROUP BY suffix),
o AS (SELECT (sum(s) + 0.5) / (sum(n) + 1.0) AS q FROM x),
xp AS (SELECT x.*, q, 0.0 AS v FROM x, o),
xm AS (SELECT least(1000.0, greatest(1.0, coalesce(CASE WHEN sum(power(s - n * q, 2)) > sum(n * q * (1 - q)) AND sum(n * (n - 1) * q * (1 - q)) > 0
         THEN sum(n * (n - 1) * q * (1 - q)) / (sum(power(s - n * q, 2)) - sum(n * q * (1 - q))) - 1 END, 1000.0))) AS m FROM xp),
xr AS (SELECT suffix, n, m, v, (s + m * q) / (n + m) AS rate FROM xp, xm),
xv AS (SELECT suffix, rate, rate * (1 - rate) / (n + m + 1) + power(m / (n + m), 2) * v AS var FROM xr),
dp AS (SELECT d.*, xv.rate AS q, xv.var AS v FROM d JOIN xv USING (suffix)),
dm AS (SELECT least(1000.0, greatest(1.0, coalesce(CASE WHEN sum(power(s - n * q, 2)) > sum(n * q * (1 - q)) AND sum(n * (n - 1) * q * (1 - q)) > 0
         THEN sum(n * (n - 1) * q * (1 - q)) / (sum(power(s - n * q, 2)) - sum(n * q * (1 - q))) - 1 END, 1000.0))) AS m FROM dp),
dr AS (SELECT domain, n, m, v, (s + m * q) / (n + m) AS rate FROM dp, dm),
dv AS (SELECT domain, rate, rate * (1 - rate) / (n + m + 1) + power(m / (n + m), 2) * v AS var FROM dr),
hp AS (SELECT h.*, dv.rate AS q, dv.var AS v FROM h JOIN dv USING (domain)),
hm AS (SELECT least(1000.0, greatest(1.0, coalesce(CASE WHEN sum(power(s - n * q, 2)) > sum(n * q * (1 - q)) AND sum(n * (n - 1) * q * (1 - q)) > 0
         THEN sum(n * (n - 1) * q * (1 - q)) / (sum(power(s - n * q, 2)) - sum(n * q * (1 - q))) - 1 END, 1000.0))) AS m FROM hp),
ht AS (SELECT host, n, m, v, (s + m * q) / (n + m) AS rate FROM hp, hm),
hr AS (SELECT host, rate, rate * (1 - rate) / (n + m + 1) + power(m / (n + m), 2) * v AS var FROM ht),
ruled AS (SELECT page_id, host, path, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
SELECT r.page_id, r.host, r.path, r.rule, CASE WHEN r.rule IN ('org/', 'com/fr/') THEN 'allow' WHEN r.rule IS NOT NULL THEN 'block'
       WHEN hr.rate - 1.645 * sqrt(hr.var) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN hr ON hr.host = r.host
"""
