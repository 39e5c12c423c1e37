"""Aggregations, rankings and set operations of the plan model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.options import DEFAULT
from ..plans.view import over
from .joins import PAIR_SQL, wall_pairs
from .registry import both, query


@query("layer_summary", "A1 MP2 A19", """
SELECT layer, count(*) AS n, sum(e - s) AS total, min(coord) AS low, max(coord) AS high, count(DISTINCT page) AS n_pages,
  concat('H=', count(CASE WHEN orient = 'H' THEN 1 END), ',V=', count(CASE WHEN orient = 'V' THEN 1 END)) AS kinds FROM {lines} GROUP BY layer""")
def layer_summary(load):
    """Strokes, length, extent, pages and a histogram of kinds for each layer."""
    kinds = load("lines").groupBy("layer", "orient").agg(F.count(F.lit(1)).alias("k"))
    text = kinds.groupBy("layer").agg(F.map_from_entries(F.collect_list(F.struct("orient", "k"))).alias("m"))
    kind = lambda o: F.coalesce(F.col("m")[o], F.lit(0)).cast("string")
    text = text.select(F.col("layer").alias("of"), F.concat(F.lit("H="), kind("H"), F.lit(",V="), kind("V")).alias("kinds"))
    sums = load("lines").groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") - F.col("s")).alias("total"), F.min("coord").alias("low"), F.max("coord").alias("high"), F.countDistinct("page").alias("n_pages"))
    return sums.join(text, F.col("layer") == F.col("of")).drop("of")


both("composition_counts", "A4 A12", "SELECT page, category, status, count(*) AS n, count(CASE WHEN confidence >= 0.65e0 THEN 1 END) AS sure FROM {items} GROUP BY page, category, status")
both("composition_rollup", "A4", "SELECT category, status, count(*) AS n, round(sum(confidence), 6) AS confidence FROM {items} GROUP BY ROLLUP (category, status)")
both("separation_profile", "A5 A6 A7 WL10", """
SELECT page, orient, n, bucket AS dominant, round(k / n, 9) AS share, k >= 12 AND k >= 0.25e0 * n AS established, greatest(2 * bucket, bucket + greatest(3e0, 2e0)) AS cap, q1, q3 FROM (
  SELECT b.*, a.n, a.q1, a.q3, row_number() OVER (PARTITION BY b.page, b.orient ORDER BY k DESC, bucket) AS rn FROM (SELECT page, orient, bround(sep * 2, 0) / 2 AS bucket, count(*) AS k FROM (
      SELECT page, orient, lead(coord) OVER (PARTITION BY page, orient ORDER BY coord, prim_id) - coord AS sep FROM {walls}) s WHERE sep BETWEEN 2 AND 24 GROUP BY 1, 2, 3) b
  JOIN (SELECT page, orient, count(*) AS n, percentile(sep, 0.25e0) AS q1, percentile(sep, 0.75e0) AS q3 FROM (SELECT page, orient, lead(coord) OVER (PARTITION BY page, orient ORDER BY coord, prim_id) - coord AS sep FROM {walls}) s WHERE sep BETWEEN 2 AND 24 GROUP BY 1, 2) a
    ON a.page = b.page AND a.orient = b.orient) r WHERE rn = 1""")
both("weighted_median_axis", "A8", """
SELECT page, orient, min(coord) AS axis FROM (SELECT page, orient, coord, sum(w) OVER (PARTITION BY page, orient ORDER BY coord ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY page, orient) AS total
  FROM (SELECT page, orient, coord, sum(e - s) AS w FROM {walls} GROUP BY page, orient, coord) c) q WHERE upto >= 0.5e0 * total GROUP BY page, orient""")
both("weighted_quantile_crop", "A9", """
SELECT page, min(CASE WHEN upto >= 0.02e0 * total THEN coord END) AS low, min(CASE WHEN upto >= 0.98e0 * total THEN coord END) AS high FROM (
  SELECT page, coord, sum(w) OVER (PARTITION BY page ORDER BY coord ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY page) AS total FROM (SELECT page, coord, sum(e - s) AS w FROM {walls} WHERE orient = 'V' GROUP BY page, coord) c) q GROUP BY page""")
_LISTS = "SELECT page, category, count(DISTINCT label) AS labels, count(DISTINCT status) AS states, {} AS label_list FROM {{items}} GROUP BY page, category"
query("distinct_lists", "A11 S2", _LISTS.format("string_agg(DISTINCT label, '|' ORDER BY label)"))(lambda load: over(load, _LISTS.format("array_join(array_sort(collect_set(label)), '|')")))
both("diagnostics_summary", "A18 A12", "SELECT kind AS code, CASE WHEN w > 14 THEN 'Error' WHEN w > 8 THEN 'Warning' ELSE 'Info' END AS severity, count(*) AS n, count(DISTINCT page) AS pages FROM {rects} GROUP BY 1, 2")
both("most_common_value", "A21", "SELECT category, label, n FROM (SELECT category, label, count(*) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, label) AS rn FROM {items} GROUP BY category, label) r WHERE rn = 1")
_THICK = """SELECT a_id, b_id, separation, mid, separation < q1 - 1.5e0 * (q3 - q1) OR separation > q3 + 1.5e0 * (q3 - q1) AS outlier FROM (SELECT page, a_id, b_id, separation FROM {pairs}) p
  JOIN (SELECT page AS of_page, percentile(separation, 0.25e0) AS q1, median(separation) AS mid, percentile(separation, 0.75e0) AS q3 FROM {pairs} GROUP BY page) q ON of_page = page"""


@query("thickness_outliers", "A24 ST5", _THICK.replace("{pairs}", f"({PAIR_SQL}) pairs"))
def thickness_outliers(load):
    """Walls as thick as their two faces are apart, against the quartiles of their page."""
    pairs = wall_pairs(load("walls"))
    return over(lambda name: pairs, _THICK)



_COVER = """SELECT page, orient, coord, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN frontier IS NULL OR s > frontier THEN 1 ELSE 0 END) OVER (PARTITION BY page, orient, coord ORDER BY s, e DESC, prim_id ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, max(e) OVER (PARTITION BY page, orient, coord ORDER BY s, e DESC, prim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS frontier FROM {walls}) f) i GROUP BY page, orient, coord, island"""
both("interval_union_coverage", "A17 A15 PL3", f"SELECT page, orient, coord, sum(e - s) AS covered, max(e) - min(s) AS span, round(sum(e - s) / (max(e) - min(s)), 9) AS coverage, count(*) AS pieces FROM ({_COVER}) u GROUP BY page, orient, coord")
both("opening_solid_intervals", "GW6", f"""
SELECT page, orient, coord, s, e, next_s - e AS gap FROM (SELECT *, lead(s) OVER (PARTITION BY page, orient, coord ORDER BY s) AS next_s FROM ({_COVER}) u) g WHERE next_s IS NULL OR next_s - e > 0""")

def seeds(cap: int) -> str:
    """The first cap strokes of each page: by kind of layer, then length."""
    return f"""
SELECT page, prim_id, rank FROM (SELECT page, prim_id, row_number() OVER (PARTITION BY page ORDER BY CASE layer WHEN 'A-WALL' THEN 0 WHEN '(unlayered)' THEN 1 ELSE 2 END, e - s DESC, prim_id) AS rank FROM {{lines}}) r WHERE rank <= {cap}"""


both("seed_topk", "T2 T1 WL7", seeds(DEFAULT.seeds_per_page))
both("review_queue_topk", "T6 Q4", """
SELECT page, id, priority FROM (SELECT page, id, round((1 - confidence) * 0.6e0 + CASE category WHEN 'Door' THEN 0.3e0 WHEN 'Stair' THEN 0.2e0 ELSE 0.1e0 END, 9) AS priority,
  row_number() OVER (PARTITION BY page ORDER BY round((1 - confidence) * 0.6e0 + CASE category WHEN 'Door' THEN 0.3e0 WHEN 'Stair' THEN 0.2e0 ELSE 0.1e0 END, 9) DESC, id) AS rn FROM {items}) r WHERE rn <= 20""")


def capped(crops: int, linework: int, candidates: int, rooms: int, arcs: int) -> str:
    """What each page keeps of crops, linework, candidates of objects, rooms and arcs: the first by worth."""
    best = lambda kind, table, key, order, cap: f"SELECT '{kind}' AS kind, page, id FROM (SELECT page, {key} AS id, row_number() OVER (PARTITION BY page ORDER BY {order}, {key}) AS rn FROM {{{table}}}) r WHERE rn <= {cap}"
    return " UNION ALL ".join((
        best("crop", "crops", "CAST(id AS STRING)", "confidence DESC, w * h DESC", crops), best("linework", "lines", "prim_id", "e - s DESC", linework), best("candidate", "items", "CAST(id AS STRING)", "confidence DESC", candidates),
        best("room", "rooms", "id", "w * h DESC", rooms), best("arc", "arcs", "CAST(id AS STRING)", "r * sweep DESC", arcs),
    ))


both("crop_order_topk", "T5 T4 T8", capped(DEFAULT.crops_per_page, DEFAULT.linework_per_page, DEFAULT.candidates_per_page, DEFAULT.rooms_per_page, DEFAULT.arcs_per_page))
both("focus_context_topk", "T7", """
SELECT page, id, distance FROM (SELECT page, id, round(sqrt((x - 250) * (x - 250) + (y - 250) * (y - 250)), 6) AS distance, row_number() OVER (PARTITION BY page ORDER BY round(sqrt((x - 250) * (x - 250) + (y - 250) * (y - 250)), 6), id) AS rn FROM {items}) r WHERE rn <= 40""")

both("candidate_union", "S1 ST1", "SELECT prim_id, page, 'wall' AS origin FROM {walls} UNION ALL SELECT prim_id, page, 'gap' AS origin FROM {gaps} UNION ALL SELECT prim_id, page, 'dimension' AS origin FROM {lines} WHERE layer = 'A-DIMS'")
both("artifact_set_diff", "S3 S4 PP3", """
SELECT 'undeclared' AS what, prim_id FROM (SELECT prim_id FROM {lines} WHERE layer = 'A-WALL' EXCEPT SELECT prim_id FROM {walls}) a UNION ALL SELECT 'shared' AS what, prim_id FROM (SELECT prim_id FROM {gaps} INTERSECT SELECT prim_id FROM {walls}) b""")
both("hypothesis_consensus", "S3 GW4", """
SELECT prim_id, n, n = 3 AS consensus FROM (SELECT prim_id, count(*) AS n FROM (SELECT prim_id FROM {walls} WHERE e - s >= 60 UNION ALL SELECT prim_id FROM {walls} WHERE e - s >= 48 UNION ALL SELECT prim_id FROM {walls} WHERE e - s >= 36) p GROUP BY prim_id) c WHERE n >= 1""")


@query("image_fingerprint", "M4 M3 AR2", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM {embeddings}),
m AS (SELECT vec_id, v, list_sum(list_transform(v, lambda x: floor(x * 1000000))) / 64000000 AS mean FROM v)
SELECT vec_id, len(list_filter(v, lambda x: x <= mean)) AS low_bits, array_to_string(list_transform(v, lambda x: CASE WHEN x <= mean THEN '1' ELSE '0' END), '') AS average_hash,
  array_to_string(list_transform(range(1, 64), lambda i: CASE WHEN v[i] > v[i + 1] THEN '1' ELSE '0' END), '') AS difference_hash,
  CASE WHEN len(list_filter(v, lambda x: x > 0.1::DOUBLE)) / 64 < 0.03::DOUBLE THEN 'sparse' WHEN len(list_filter(v, lambda x: x > 0.1::DOUBLE)) / 64 < 0.08::DOUBLE THEN 'light' WHEN len(list_filter(v, lambda x: x > 0.1::DOUBLE)) / 64 < 0.18::DOUBLE THEN 'medium' ELSE 'dense' END AS ink FROM m""")
def image_fingerprint(load):
    """Average and difference hash of 64 luma values, and the share of ink, by higher-order functions."""
    v = load("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    mean = F.aggregate(F.transform("v", lambda x: F.floor(x * 1000000).cast("double")), F.lit(0.0), lambda a, x: a + x) / 64000000
    m = v.withColumn("mean", mean)
    one = lambda test: F.when(test, F.lit("1")).otherwise(F.lit("0"))
    ink = F.size(F.filter("v", lambda x: x > 0.1)) / 64
    return m.select(
        "vec_id", F.size(F.filter("v", lambda x: x <= F.col("mean"))).cast("long").alias("low_bits"), F.array_join(F.transform("v", lambda x: one(x <= F.col("mean"))), "").alias("average_hash"),
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: one(F.get("v", i) > F.get("v", i + 1))), "").alias("difference_hash"),
        F.when(ink < 0.03, "sparse").when(ink < 0.08, "light").when(ink < 0.18, "medium").otherwise("dense").alias("ink"),
    )


@query("property_lookup", "MP1 AR1 JS1", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, concat('kind=', event_type, ';k=', json_extract_string(props, '$.k')) AS evidence FROM {events}""")
def property_lookup(load):
    """A property by name whatever its case, out of a map; evidence without repeats."""
    e = load("events").withColumn("m", F.transform_keys(F.from_json(F.upper("props"), "map<string,string>"), lambda k, v: F.lower(k)))
    evidence = F.array_distinct(F.array(F.concat(F.lit("kind="), "event_type"), F.concat(F.lit("k="), F.col("m")["k"]), F.concat(F.lit("kind="), "event_type")))
    return e.select("event_id", F.col("m")["k"].cast("long").alias("k"), F.array_join(evidence, ";").alias("evidence"))


_LOOP = "(0, x, y), (1, x, y), (2, x + w / 2, y + CASE WHEN id % 3 = 0 THEN 0.5e0 ELSE 0e0 END), (3, x + w, y), (4, x + w, y + h), (5, x + w, y + h), (6, x, y + h), (7, x + CASE WHEN id % 5 = 0 THEN 0.25e0 ELSE 0e0 END, y + h / 2)"


@query("loop_simplify", "AR3", f"""
WITH p AS (SELECT id, k, CAST(px AS DOUBLE) AS px, CAST(py AS DOUBLE) AS py FROM {{rects}}, LATERAL (VALUES {_LOOP}) AS v(k, px, py)),
d AS (SELECT * FROM (SELECT *, coalesce(lag(px) OVER o, last_value(px) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS bx, coalesce(lag(py) OVER o, last_value(py) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS by_ FROM p WINDOW o AS (PARTITION BY id ORDER BY k)) q WHERE px <> bx OR py <> by_),
n AS (SELECT *, coalesce(lag(px) OVER o, last_value(px) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ax, coalesce(lag(py) OVER o, last_value(py) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ay,
  coalesce(lead(px) OVER o, first_value(px) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS cx, coalesce(lead(py) OVER o, first_value(py) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS cy FROM d WINDOW o AS (PARTITION BY id ORDER BY k)),
b AS (SELECT id, k, px, py FROM n WHERE (px - ax) * (cy - ay) - (py - ay) * (cx - ax) <> 0),
t AS (SELECT id, px * ny - nx * py AS turn FROM (SELECT *, coalesce(lead(px) OVER o, first_value(px) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nx, coalesce(lead(py) OVER o, first_value(py) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ny FROM b WINDOW o AS (PARTITION BY id ORDER BY k)) q)
SELECT id, count(*) AS kept, abs(sum(turn)) / 2 AS area FROM t GROUP BY id""")
def loop_simplify(load):
    """Loops without repeated points and points on a straight line: boxes given by eight points, some of them bent."""
    p = lambda x, y: F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))
    bent = lambda every, by: f"CASE WHEN id % {every} = 0 THEN {by}e0 ELSE 0e0 END"
    points = F.array(p("x", "y"), p("x", "y"), p("x + w / 2", f"y + {bent(3, 0.5)}"), p("x + w", "y"), p("x + w", "y + h"), p("x + w", "y + h"), p("x", "y + h"), p(f"x + {bent(5, 0.25)}", "y + h / 2"))
    return simplified(load("rects").select("id", points.alias("p")))


def simplified(loops):
    """(id, kept, area) of loops (id, p: array of x and y): how many points stay, and the area within."""
    at = lambda a, i: F.get(a, F.pmod(i, F.size(a)))
    loops = loops.withColumn("p", F.filter("p", lambda q, i: q != at("p", i - 1 + F.size("p"))))
    bend = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]) != 0
    loops = loops.withColumn("p", F.filter("p", lambda q, i: bend(at("p", i - 1 + F.size("p")), q, at("p", i + 1))))
    turn = F.transform("p", lambda q, i: q["x"] * at("p", i + 1)["y"] - at("p", i + 1)["x"] * q["y"])
    return loops.select("id", F.size("p").alias("kept"), (F.abs(F.aggregate(turn, F.lit(0.0), lambda s, x: s + x)) / 2).alias("area"))
