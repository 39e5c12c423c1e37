"""Host-level quality rules, in DataFrame functions only.

Every text is measured (words, symbols, repeated lines, repeated runs of three words) and judged by
rules. A domain's failures are summed, and its failure rate is shrunk by a beta prior fitted to all
domains by the method of moments: rate = (failures + a) / (documents + a + b). The verdict joins
back to the documents: in a domain whose rate's lower bound (two standard deviations of the beta)
is above LIMIT every document goes; elsewhere a document goes if it fails a rule itself. Documents
that fail the base rules go in any case.

The texts are measured once: the figures are written and read again for the sums and the join. Sums
combine before the exchange; the domains' table joins by broadcast if it is small and else by an
exchange on both sides, whose hot keys Spark splits.

Cases: a null or empty text has no word, fails the base rules and goes; a null domain is a domain of
its own; equal rows get equal verdicts; very long texts are measured whole; with no document the
result is empty. Columns of other names are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GAP, stored

LIMIT = 0.5


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and domain with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    t = F.coalesce("text", F.lit(""))
    some = docs.select(
        "doc_id", "domain", F.filter(F.split(t, GAP), lambda x: x != "").alias("words"), F.length(F.regexp_replace(t, GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    # Runs of three words by hash; only texts that repeat one are looked at further.
    n = F.size("words")
    run = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    some = some.select(
        "doc_id", "domain", "word_chars", "n_symbols", n.cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.when(n > 3, run).otherwise(F.array().cast("array<bigint>")).alias("runs"),
    )
    again = F.size("runs") > F.size(F.array_distinct("runs"))
    placed = F.sort_array(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = some.withColumn("placed", F.when(again, placed)).drop("runs")
    h = lambda i: F.get("placed", i)["h"]
    at = F.sort_array(F.transform(F.filter("placed", lambda x, i: ((i > 0) & (h(i - 1) == x["h"])) | F.coalesce(h(i + 1) == x["h"], F.lit(False))), lambda x: x["i"]))
    some = some.withColumn("at", F.when(F.col("placed").isNotNull(), at)).drop("placed")
    words = F.aggregate("at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda s, x: F.struct((s["n"] + F.least(F.lit(3), x - s["last"])).cast("long").alias("n"), x.alias("last")), lambda s: s["n"])
    return some.withColumn("n_repeat_words", F.coalesce(words, F.lit(0).cast("long"))).drop("at")


BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
#: Clean prose has none of these: more than one symbol to ten words, most lines repeated, words of odd length.
FAILED = f"({BASE_FAILED} OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words)"
OWN_FAILED = "(10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words)"


def domain_rates(figures: DataFrame) -> DataFrame:
    """domain, n, failures and blocked of every domain."""
    hosts = stored(figures.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(f"CAST({FAILED} AS BIGINT)")).alias("failures")), "domains")
    a, b = prior(hosts.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("failures").alias("f"), F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("ff"), F.sum(F.col("n") * F.col("n")).alias("nn")).first())
    p, m = F.col("failures") + F.lit(a), F.col("n") + F.lit(a + b)
    rate = p / m
    return hosts.withColumn("rate", rate).withColumn("blocked", rate - 2 * F.sqrt(rate * (1 - rate) / (m + 1)) > LIMIT)


def prior(s) -> tuple[float, float]:
    """Beta parameters by moments from one row of sums over domains; between 1 and 1000 documents' weight."""
    if not s or not s["n"]:
        return 1.0, 1.0
    n, rate = s["n"], (s["f"] + 0.5) / (s["n"] + 1)
    between = max(0.0, (s["ff"] - s["f"] * s["f"] / n))  # weighted sum of squares of the rates
    each = (n - s["nn"] / n) / max(1, s["k"] - 1)
    spread = (between - rate * (1 - rate) * (s["k"] - 1)) / max(1.0, each * max(1, s["k"] - 1))
    weight = min(1000.0, max(1.0, rate * (1 - rate) / spread - 1)) if spread > 0 else 1000.0
    return rate * weight, (1 - rate) * weight


def judge(docs: DataFrame) -> DataFrame:
    """Figures and verdict of every row of docs (doc_id, text, domain)."""
    figures = stored(measured(docs), "figures")
    rates = stored(domain_rates(figures), "rates").select(F.col("domain").alias("of"), "rate", "blocked")
    found = figures.join(rates, F.col("domain").eqNullSafe(F.col("of"))).drop("of")
    failed = F.expr(BASE_FAILED)
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.col("blocked") & ~F.expr(OWN_FAILED))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """doc_id, the figures, base_failed and kept of every document; the domain is its source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.col("source").alias("domain"))
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = rf"""
WITH w AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS t FROM documents),
x AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM w),
g AS (SELECT id, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i:i + 2])) AS gram, unnest(range(1, len(words) - 1)) AS i FROM x WHERE len(words) > 2),
r AS (SELECT id, i, count(*) OVER (PARTITION BY id, gram) AS c FROM g),
u AS (SELECT id, count(DISTINCT p) AS n_repeat_words FROM (SELECT id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE c > 1) GROUP BY id),
m AS (SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM x LEFT JOIN u USING (id)),
d AS (SELECT source AS of_source, count(*) AS n, CAST(sum(CASE WHEN {FAILED} THEN 1 ELSE 0 END) AS DOUBLE) AS f FROM m GROUP BY source),
s AS (SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, sum(f) AS f, sum(f * f / n) AS ff, CAST(sum(n * n) AS DOUBLE) AS nn FROM d),
p AS (SELECT *, (f + 0.5::DOUBLE) / (n + 1) AS rate FROM s),
q AS (SELECT rate, (greatest(0, ff - f * f / n) - rate * (1 - rate) * (k - 1)) / greatest(1, (n - nn / n) / greatest(1, k - 1) * greatest(1, k - 1)) AS spread FROM p),
z AS (SELECT rate, CASE WHEN spread > 0 THEN least(1000, greatest(1, rate * (1 - rate) / spread - 1)) ELSE 1000 END AS weight FROM q),
b AS (SELECT of_source, (f + z.rate * weight) / (n + weight) AS r, n + weight AS m FROM d, z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_FAILED} AS base_failed,
  NOT {BASE_FAILED} AND NOT r - 2 * sqrt(r * (1 - r) / (m + 1)) > {LIMIT}::DOUBLE AND NOT {OWN_FAILED} AS kept
FROM m JOIN b ON source IS NOT DISTINCT FROM of_source
"""
