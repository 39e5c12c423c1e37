"""URL filters by rules and by host reputation, in DataFrame functions only.

Reputation is empirical Bayes: pages with a labelled outcome (1 bad, 0 good) are counted by host,
registered domain and suffix. Each level's rate is shrunk towards the level above it: from the whole
to the suffix, the suffix to the domain, the domain to the host, with beta-binomial priors whose
weights are fitted to each level by the method of moments. A page without a rule is blocked if the
lower bound of its host's posterior rate (BOUND standard deviations of the beta) is above TIMES the
rate of all pages, or above LIMIT; a host without labelled pages has its domain's posterior, or its
suffix's. Where hosts differ by no more than chance, the fitted weights are large and none is blocked.
Domain and suffix are those of the host without user and port.

Rules are (host, path, verdict): a rule fits its host and all subdomains where the path starts with
the rule's; the longest rule wins.

Cases: a url that is null or has no `://` has an empty host and path and no rule, and is judged as a
host of that name; a labelled page with a null outcome doesn't count; a page labelled repeatedly
counts as bad if any label says so; with no labels nothing is blocked but by rule; equal rows get
equal verdicts. Joins have both sides read from files or exchanged: Spark splits hot hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Suffixes of two labels; all others have one.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.in", "co.za", "com.cn", "com.mx")
LIMIT, TIMES, BOUND = 0.5, 2.0, 2.0


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the last that fits wins
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column) -> Column:
    host = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def suffix_of(domain: Column) -> Column:
    two = F.substring_index(domain, ".", -2)
    return F.when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(domain, ".", -1))


def weight(level: DataFrame) -> tuple[float, float]:
    """Rate of all pages of a level, and the weight, in pages, of its prior."""
    n, bad = F.col("n"), F.col("bad")
    s = level.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(bad).alias("b"), F.sum(bad * bad / n).alias("bb"), F.sum(n * n).alias("nn")).first()  # one row
    if not s["n"]:
        return 0.0, 1.0
    rate = s["b"] / s["n"]
    noise = rate * (1 - rate)
    between = max(0.0, s["bb"] - s["b"] * s["b"] / s["n"]) - noise * (s["k"] - 1)
    spread = between / max(1.0, s["n"] - s["nn"] / s["n"])
    return rate, min(1000.0, max(1.0, noise / spread - 1)) if spread > 0 else 1000.0


def reputation(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Posterior parameters (a, b) by host, domain and suffix of outcomes (host, bad), and the rate of all."""
    hosts = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    hosts = stored(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain"))), "hosts")
    domains = stored(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = stored(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    rate, m = weight(suffixes)
    suffixes = stored(suffixes.select("suffix", (F.col("bad") + F.lit(m * rate)).alias("a"), (F.col("n") - F.col("bad") + F.lit(m * (1 - rate))).alias("b")), "suffixes")
    out = [suffixes]
    for level, up, key in ((domains, "suffix", "domain"), (hosts, "domain", "host")):
        _, m = weight(level)
        above = out[-1].select(up, (F.col("a") / (F.col("a") + F.col("b"))).alias("p"))
        out.append(stored(level.join(above, up).select(key, (F.col("bad") + F.lit(m) * F.col("p")).alias("a"), (F.col("n") - F.col("bad") + F.lit(m) * (1 - F.col("p"))).alias("b")), key))
    return out[2], out[1], out[0], rate


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages (with host and path) with rule and verdict; outcomes: (host, bad) of labelled pages."""
    hosts, domains, suffixes, rate = reputation(outcomes)
    rule, verdict = matched(rules)
    found = pages.withColumn("__domain", domain_of(F.col("host"))).withColumn("__suffix", suffix_of(F.col("__domain")))
    for name, table, key in (("host", hosts, "host"), ("domain", domains, "__domain"), ("suffix", suffixes, "__suffix")):
        a, b = F.col("a"), F.col("b")
        p = a / (a + b)
        low = p - BOUND * F.sqrt(p * (1 - p) / (a + b + 1))
        found = found.join(table.select(F.col(name).alias(f"__k{name}"), low.alias(f"__{name}_low")), F.col(key) == F.col(f"__k{name}"), "left").drop(f"__k{name}")
    low = F.coalesce("__host_low", "__domain_low", "__suffix_low", F.lit(0.0))
    own = F.when(low > min(LIMIT, TIMES * rate), F.lit("block")).otherwise(F.lit("allow"))
    return found.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, own)).drop("__domain", "__suffix", "__host_low", "__domain_low", "__suffix_low")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    A page's outcome is bad if the document whose number its path ends with is labelled of quality 0.
    """
    host, path = parts()
    pages = stored(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host.alias("host"), path.alias("path")), "pages")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").groupBy(F.col("doc_id").alias("of")).agg(F.max((F.col("quality") == 0).cast("long")).alias("bad"))
    number = F.regexp_extract("path", r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    outcomes = pages.select("host", F.when(number != "", number.cast("long")).alias("of")).join(labels, "of").select("host", "bad")
    return judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def _level(name: str, key: str, up: str, table: str, above: str) -> str:
    """SQL of one level's prior weight and posterior."""
    join = f"JOIN (SELECT {up} AS of_up, a / (a + b) AS p FROM {above}) u ON t.{up} = u.of_up" if above else "CROSS JOIN (SELECT rate AS p FROM {0}_rate)".format(name)
    return f"""
{name}_s AS (SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS b, sum(CAST(bad * bad AS DOUBLE) / n) AS bb, CAST(sum(n * n) AS DOUBLE) AS nn FROM {table}),
{name}_rate AS (SELECT *, coalesce(b / nullif(n, 0), 0) AS rate FROM {name}_s),
{name}_q AS (SELECT *, (greatest(0, bb - b * b / n) - rate * (1 - rate) * (k - 1)) / greatest(1, n - nn / n) AS spread FROM {name}_rate),
{name}_m AS (SELECT CASE WHEN spread > 0 THEN least(1000, greatest(1, rate * (1 - rate) / spread - 1)) ELSE 1000 END AS m FROM {name}_q),
{name}_p AS (SELECT t.*, bad + m * p AS a, t.n - bad + m * (1 - p) AS b FROM {table} t CROSS JOIN {name}_m {join})"""


_LAST = "CASE WHEN len(string_split({0}, '.')) >= {1} THEN array_to_string(string_split({0}, '.')[-{1}:], '.') ELSE {0} END"
_TWO = f"({', '.join(repr(s) for s in SUFFIXES)})"
_LOW = "{0}.a / ({0}.a + {0}.b) - 2.0::DOUBLE * sqrt({0}.a / ({0}.a + {0}.b) * (1 - {0}.a / ({0}.a + {0}.b)) / ({0}.a + {0}.b + 1))"
_RULES = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
_FITS = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in _RULES]
ORACLE = rf"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
g AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM h),
d AS (SELECT *, CASE WHEN {_LAST.format("bare", 2)} IN {_TWO} THEN {_LAST.format("bare", 3)} ELSE {_LAST.format("bare", 2)} END AS domain,
  TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\.[a-z]+)?/?$', 1), '') AS BIGINT) AS number FROM g),
e AS (SELECT *, CASE WHEN {_LAST.format("domain", 2)} IN {_TWO} THEN {_LAST.format("domain", 2)} ELSE {_LAST.format("domain", 1)} END AS suffix FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, domain, suffix, count(*) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM e JOIN l ON number = doc_id GROUP BY ALL),
domains AS (SELECT domain, suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM domains GROUP BY ALL),
{_level("s", "suffix", "", "suffixes", "")}, {_level("d", "domain", "suffix", "domains", "s_p")}, {_level("h", "host", "domain", "hosts", "d_p")}
SELECT page_id, e.host, path, CASE {" ".join(f"WHEN {f.replace('host', 'e.host')} THEN '{r}'" for f, r, _ in _FITS)} END AS rule,
  CASE {" ".join(f"WHEN {f.replace('host', 'e.host')} THEN '{v}'" for f, _, v in _FITS)}
    WHEN coalesce({_LOW.format("h_p")}, {_LOW.format("d_p")}, {_LOW.format("s_p")}, 0) > least(0.5::DOUBLE, 2.0::DOUBLE * (SELECT rate FROM s_rate)) THEN 'block' ELSE 'allow' END AS verdict
FROM e LEFT JOIN h_p ON e.host = h_p.host LEFT JOIN d_p ON e.domain = d_p.domain LEFT JOIN s_p ON e.suffix = s_p.suffix
"""
