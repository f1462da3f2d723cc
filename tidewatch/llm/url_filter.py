"""URL filter: curated rules first, then an empirical-Bayes reputation of hosts.

Labelled outcomes of pages (good or not) are counted per host, registered domain and suffix. Each
level's rate is shrunk towards its parent by a beta prior whose mean is the parent's posterior
mean and whose strength is fitted to the children by the method of moments; the suffixes' parent
is the whole labelled set. A host is blocked when the upper posterior bound of its good rate is
below the threshold, so little evidence never blocks. Hosts without labels take the bound of the
closest level that has any.

Counts are aggregations with partial sums; page rows meet them through a join on the host, and
only counters, never pages, are shuffled by domain or suffix.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is
judged by the prior of all pages; repeated page rows are judged alike; null outcomes don't count;
without any label every rate is one half with full width, so all is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import UPPER
from tidewatch.session import ensure_checkpoint_dir, table

#: (rule, verdict); a rule is host and path prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Labels that stand for a kind of holder below a country's two letters, and so make a public suffix of two labels (co.uk, com.br, or.jp).
KIND_LABELS = ("ac", "asn", "co", "com", "edu", "firm", "gen", "go", "gob", "gouv", "gov", "gv", "id", "ind", "info", "k12", "lg", "ltd", "mil", "mod", "muni", "ne", "net", "nhs", "nic", "nom", "or", "org", "plc", "police", "pro", "res", "sch")
WIDE_SUFFIX = rf"^({'|'.join(KIND_LABELS)})\.[a-z]{{2}}$"

#: One-sided 95 % bound, and the least good rate that a page's host must be able to have.
Z, LEAST_GOOD = 1.6448536269514722, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = url.contains("://")
    rest = F.substring_index(F.substring(url, F.lit(1), F.greatest(F.length(url), F.lit(0))), "://", 1)
    after = F.when(known, F.substring(url, F.char_length(rest) + 4, F.char_length(url)))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, UPPER.lower())
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict. Rules are a short curated list, part of the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest ends outermost
        of, _, rest = text.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def domain_columns(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port; addresses are their own domain."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":\d*$", "")
    address = bare.rlike(r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\])$")
    two = F.substring_index(bare, ".", -2)
    wide = two.rlike(WIDE_SUFFIX)
    suffix = F.when(address, bare).when(wide, two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(address, bare).when(wide, F.substring_index(bare, ".", -3)).otherwise(two)
    return domain, suffix


def _strength(rates: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Method of moments: prior strength of each parent's children, from pooled (n, good) per child."""
    mean = F.sum("good") / F.sum("n")
    return (
        rates.groupBy(*parent)
        .agg(
            F.sum("n").alias("n_all"), mean.alias("m"), F.count("*").alias("k"),
            F.sum(F.col("n") * F.col("n")).alias("n_sq"),
            (F.sum(F.col("good") * F.col("good") / F.col("n")) - F.sum("good") * F.sum("good") / F.sum("n")).alias("between"),
        )
        .withColumn("spread", F.greatest(F.col("between") - (F.col("k") - 1) * F.col("m") * (1 - F.col("m")), F.lit(0.0)) / F.greatest(F.col("n_all") - F.col("n_sq") / F.col("n_all"), F.lit(1e-9)))
        .select(*parent, F.least(F.greatest(F.col("m") * (1 - F.col("m")) / F.greatest("spread", F.lit(1e-9)) - 1, F.lit(2.0)), F.lit(1000.0)).alias(name))
    )


def host_reputation(labelled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """From (host, good 0/1): posterior (a, b) by host, domain, suffix and for all."""
    ensure_checkpoint_dir(labelled.sparkSession)
    domain, suffix = domain_columns(F.col("host"))
    hosts = labelled.where("good is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("good").cast("double").alias("good")).withColumns({"domain": domain, "suffix": suffix}).checkpoint()  # four levels read these counts
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).checkpoint()
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("good"))

    def posterior(child: DataFrame) -> DataFrame:
        return child.withColumn("a", F.col("good") + F.col("up_m") * F.col("k")).withColumn("b", F.col("n") - F.col("good") + (1 - F.col("up_m")) * F.col("k")).drop("k", "up_m")

    top = whole.withColumns({"a": F.col("good") + 1, "b": F.col("n") - F.col("good") + 1})
    up = lambda df, *on: df.select(*on, (F.col("a") / (F.col("a") + F.col("b"))).alias("up_m"))
    s = posterior(suffixes.crossJoin(_strength(suffixes, [], "k")).crossJoin(up(top)))  # both of one row
    d = posterior(domains.join(_strength(domains, ["suffix"], "k"), "suffix").join(up(s, "suffix"), "suffix"))
    h = posterior(hosts.join(_strength(hosts, ["domain"], "k"), "domain").join(up(d, "domain"), "domain"))
    return h.select("host", "a", "b"), d.select("domain", "a", "b"), s.select("suffix", "a", "b"), top.select("a", "b")


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]] = RULES, z: float = Z, least_good: float = LEAST_GOOD) -> DataFrame:
    """pages: page_id, url; labelled: url, good (0/1). Verdict by rule, else by reputation."""
    host, path = host_and_path(F.col("url"))
    seen = labelled.select(host.alias("host"), "good")
    by_host, by_domain, by_suffix, by_all = host_reputation(seen)
    page = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = page.select("host").distinct()
    domain, suffix = domain_columns(F.col("host"))
    named = lambda df, p: df.withColumnsRenamed({"a": f"{p}_a", "b": f"{p}_b"})
    rated = (
        known.withColumns({"domain": domain, "suffix": suffix})
        .join(named(by_host, "h"), "host", "left").join(named(by_domain, "d"), "domain", "left").join(named(by_suffix, "s"), "suffix", "left")
        .crossJoin(named(by_all, "t"))  # one row
    )
    a, b = (F.coalesce(*[F.col(f"{p}_{x}") for p in "hdst"]) for x in "ab")
    rate = a / (a + b)
    bound = rate + z * F.sqrt(rate * (1 - rate) / (a + b + 1))
    scores = rated.select("host", rate.alias("good_rate"), F.least(bound, F.lit(1.0)).alias("good_bound"))
    rule, says = rule_columns(F.col("host"), F.col("path"), rules)
    return page.join(scores, "host").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(says, F.when(F.col("good_bound") < least_good, "block").otherwise("allow")).alias("verdict"),
        F.round("good_rate", 6).alias("good_rate"), F.round("good_bound", 6).alias("good_bound"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document of the same id: good if of quality and not toxic."""
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    good = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"))
    return filter_urls(pages, pages.join(good, "page_id").select("url", "good")).select("page_id", "host", "path", "rule", "verdict")


def _level_sql(name: str, child: str, key: str, parent: str, on: str) -> str:
    """Posterior of ``child`` (n, good by key and on) by a prior around its parent's mean, whose strength is fitted to the parent's children."""
    using = f"USING ({on})" if on else "ON true"
    by = f"GROUP BY {on}" if on else ""
    first = f"{on}, " if on else ""
    return f"""{name}_fit AS (SELECT {first}sum(n) AS n_all, sum(good) / sum(n) AS m, count(*) AS k, sum(n * n) AS n_sq, sum(good * good / n) - sum(good) * sum(good) / sum(n) AS between_ FROM {child} {by}),
{name}_strength AS (SELECT {first}least(greatest(m * (1 - m) / greatest(greatest(between_ - (k - 1) * m * (1 - m), 0) / greatest(n_all - n_sq / n_all, 1e-9), 1e-9) - 1, 2), 1000) AS s FROM {name}_fit),
{name} AS (SELECT {key}, good + up * s AS a, n - good + (1 - up) * s AS b FROM {child} JOIN {name}_strength {using} JOIN (SELECT {first}a / (a + b) AS up FROM {parent}) {using})"""


OP6_SQL = f"""
WITH split AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
page AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
good AS (SELECT doc_id AS page_id, min((quality = 1 AND toxic = 0)::INT) AS good FROM labels GROUP BY doc_id),
seen AS (SELECT host, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS good FROM page JOIN good USING (page_id) WHERE good IS NOT NULL GROUP BY host),
bare AS (SELECT DISTINCT host, string_split(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':\\d*$', ''), '.') AS x FROM page),
named AS (SELECT host, array_to_string(x, '.') AS whole, array_to_string(x[greatest(len(x) - 1, 1):], '.') AS two, array_to_string(x[greatest(len(x) - 2, 1):], '.') AS three, x[-1] AS one FROM bare),
names AS (SELECT host, CASE WHEN address THEN whole WHEN wide THEN three ELSE two END AS domain, CASE WHEN address THEN whole WHEN wide THEN two ELSE one END AS suffix FROM (
  SELECT *, regexp_matches(whole, '^(\\d{{1,3}}(\\.\\d{{1,3}}){{3}}|\\[.*\\])$') AS address, regexp_matches(two, '{WIDE_SUFFIX}') AS wide FROM named)),
hosts AS (SELECT host, domain, suffix, n, good FROM seen JOIN names USING (host)),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY suffix),
t AS (SELECT coalesce(sum(good), 0) + 1 AS a, coalesce(sum(n), 0) - coalesce(sum(good), 0) + 1 AS b FROM suffixes),
{_level_sql("s", "suffixes", "suffix", "t", "")},
{_level_sql("d", "domains", "domain, suffix", "s", "suffix")},
{_level_sql("h", "hosts", "host", "d", "domain")},
rated AS (SELECT names.host, coalesce(h.a, d.a, s.a, t.a) AS a, coalesce(h.b, d.b, s.b, t.b) AS b FROM names LEFT JOIN h USING (host) LEFT JOIN d ON d.domain = names.domain LEFT JOIN s ON s.suffix = names.suffix, t),
bound AS (SELECT host, a / (a + b) + {Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS good_bound FROM rated),
ruled AS (SELECT *, CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM page)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN good_bound < {LEAST_GOOD} THEN 'block' ELSE 'allow' END AS verdict FROM ruled JOIN bound USING (host)
"""
