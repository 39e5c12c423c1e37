"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential variate, a hash of its id and text, divided by its quality weight;
within a source the least come first (the order of weighted sampling without replacement). A source's
target in words is met by complete epochs first, then by documents in that order until the rest of
the budget is spent; of the last document a source takes only the words that are left.

Targets: sources in order of code point, null last, weigh WEIGHTS in turn and share SHARE of all
words; none exceeds CAP times its words, and what is above is shared again by weight. The final
targets are those of filling to a level: min(cap, level x weight).

Prefix sums never gather a source in one task: documents are binned by the logarithm of their key
times the square root of the source's rows, so a bin holds about a square root of the source; sums
by bin are added up per source, then documents within a bin. The per-source table has a row for each
source; it is never collected.

Cases: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own; a
source of size 0 has target 0; a null doc_id draws by its text; repeated rows draw equal keys, and
any of them may be the one that is cut. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, WORD, stored

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2


def n_words(text: str = "text") -> Column:
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), GAP, "")).cast("long")


def quality() -> Column:
    """1 for plain prose, less for symbols per word, 0.1 at least."""
    symbols = F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", ""))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(0.5) * F.coalesce(symbols, F.lit(0)) / F.greatest(F.col("size"), F.lit(1)))


def draw(weight: Column) -> Column:
    """An exponential variate of rate weight, of doc_id and text alone."""
    h = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(h, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(4503599627370496.0)
    return -F.log(u) / weight


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, rows, source_size) with target, epochs and rest (words after the epochs)."""
    # Windows over all rows of this table: a row for each source.
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = sources.withColumn("rn", F.row_number().over(rank))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("rn") - 1, F.lit(len(WEIGHTS))) + 1))
    s = s.withColumn("cap", CAP * F.col("source_size")).withColumn("want", SHARE * F.sum("source_size").over(everything))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("cap_before", F.sum("cap").over(fill) - F.col("cap")).withColumn("w_left", F.sum("w").over(everything) - F.sum("w").over(fill) + F.col("w"))
    s = s.withColumn("full", F.col("cap") * F.col("w_left") <= (F.col("want") - F.col("cap_before")) * F.col("w"))
    s = s.withColumn("left", F.col("want") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything))
    s = s.withColumn("w_open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(everything))
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("left") * F.col("w") / F.greatest("w_open", F.lit(1))))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.floor(budget / F.greatest("source_size", F.lit(1))).cast("long")
    return s.select("source", "rows", "source_size", "target", epochs.alias("epochs"), (budget - epochs * F.col("source_size")).alias("rest"))


def mix(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, draw) of every row of docs; weight: of quality, above 0."""
    base = docs.select("doc_id", "text", "source").withColumn("size", n_words())
    base = stored(base.select("doc_id", "source", "size", draw(quality() if weight is None else weight).alias("draw")), "sizes")
    sources = base.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    plan = stored(targets(sources), "targets").withColumnRenamed("source", "of")
    rows = base.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = stored(rows.withColumn("bin", F.floor(F.log("draw") * F.ceil(F.sqrt("rows"))).cast("long")), "binned")
    sums = rows.groupBy("source", "bin").agg(F.sum("size").alias("in_bin"))
    before = F.sum("in_bin").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("in_bin")
    sums = stored(sums.select(F.col("source").alias("of"), F.col("bin").alias("b"), before.alias("before")), "sums")
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("b")))
    inside = Window.partitionBy("source", "bin").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.col("before") + F.sum("size").over(inside) - F.col("size")
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - at))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "draw")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


#: With {documents} for the rows to mix.
MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM {documents}),
keyed AS (SELECT doc_id, source, size,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) + 0.5) / CAST(4503599627370496 AS DOUBLE))
      / greatest(CAST(0.1 AS DOUBLE), CAST(1 AS DOUBLE) - CAST(0.5 AS DOUBLE) * coalesce(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')), 0) / greatest(size, 1)) AS draw FROM sized),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM s0),
s2 AS (SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2 * source_size AS cap, CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS BIGINT) AS want FROM s1),
s3 AS (SELECT *, CAST(sum(cap) OVER f AS BIGINT) - cap AS cap_before, CAST(sum(w) OVER () AS BIGINT) - CAST(sum(w) OVER f AS BIGINT) + w AS w_left FROM s2
  WINDOW f AS (ORDER BY CAST(cap AS DOUBLE) / w, rn ROWS UNBOUNDED PRECEDING)),
s4 AS (SELECT *, cap * w_left <= (want - cap_before) * w AS is_full FROM s3),
s5 AS (SELECT *, want - CAST(sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS BIGINT) AS rest_words, CAST(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () AS BIGINT) AS w_open FROM s4),
s6 AS (SELECT source AS of_source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE rest_words * w / greatest(w_open, 1) END AS target FROM s5),
s7 AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM s6),
s8 AS (SELECT *, budget // greatest(source_size, 1) AS epochs FROM s7),
mixed AS (SELECT keyed.*, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size
    - (sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size))) AS BIGINT) AS taken
  FROM keyed JOIN s8 ON source IS NOT DISTINCT FROM of_source)
"""
ORACLE = MIX_SQL.format(documents="documents") + "SELECT doc_id, size, source_size, target, taken FROM mixed"


def take(docs: DataFrame) -> DataFrame:
    """The rows of the mix: a row for each whole time a document is taken, and one cut after the words left over.

    The columns are those of docs, whatever their names; n_chars follows the text. Rows of size 0 and
    those past their source's budget go; of repeated rows any may be the one that is cut or goes.
    """
    mixed = mix(docs).where("taken > 0")
    # Equal rows share a draw; each joins by its number among them.
    mixed = mixed.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "draw", "source", "size").orderBy("taken")))
    mixed = stored(mixed.select(*(F.col(c).alias(f"of_{c}") for c in ("doc_id", "draw", "source", "size", "n")), "taken"), "mixed")
    rows = docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")).withColumn("size", n_words()).withColumn("draw", draw(quality()))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "draw", "source", "size").orderBy("doc_id")))
    on = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size")) & (F.col("draw") == F.col("of_draw")) & (F.col("n") == F.col("of_n"))
    rows = rows.join(mixed, on).select("text", "row", "size", "taken", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("time"))
    left = (F.col("taken") - (F.col("time") - 1) * F.col("size")).cast("int")
    rows = rows.select("text", "row", "size", left.alias("left"))
    cut = F.array_join(F.slice(F.filter(F.split("text", GAP), lambda x: x != ""), F.lit(1), F.greatest(F.col("left"), F.lit(1))), " ")
    rows = rows.select(F.when(F.col("left") < F.col("size"), cut).otherwise(F.col("text")).alias("text"), "row")
    given = {"text": F.col("text"), "n_chars": F.length("text")}
    return rows.select(*(given[c].cast(t).alias(c) if c in given else F.col(f"row.`{c}`") for c, t in docs.dtypes))
