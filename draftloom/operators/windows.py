"""Window operators: neighbours in order, frontiers, runs, ranks, numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.view import over
from .intervals import islands
from .joins import crossings
from .registry import both, query

_AXES = "SELECT page, orient, coord, max(e - s) AS len, count(*) AS n FROM {lines} GROUP BY page, orient, coord HAVING max(e - s) >= 60"
both("grid_bay_spacing", "W1 W7", f"SELECT page, orient, coord, coord - prev AS spacing, round(greatest(0.35e0, least(0.94e0, (least(1e0, len / 240) + least(1e0, prev_len / 240)) / 2)), 9) AS confidence FROM (SELECT *, lag(coord) OVER (PARTITION BY page, orient ORDER BY coord) AS prev, lag(len) OVER (PARTITION BY page, orient ORDER BY coord) AS prev_len FROM ({_AXES}) a) s WHERE prev IS NOT NULL")
both("irregular_bays", "W2 A23 A5", f"""
SELECT s.page, s.orient, count(*) AS n, round(avg(CASE WHEN abs(spacing - mid) <= 0.25e0 * mid THEN 1e0 ELSE 0e0 END), 9) AS regular, max(mid) AS median_spacing, round(max(spacing) / greatest(1e-9, min(spacing)), 6) AS spread
FROM (SELECT page, orient, coord - lag(coord) OVER (PARTITION BY page, orient ORDER BY coord) AS spacing FROM ({_AXES}) a) s
JOIN (SELECT page, orient, median(spacing) AS mid FROM (SELECT page, orient, coord - lag(coord) OVER (PARTITION BY page, orient ORDER BY coord) AS spacing FROM ({_AXES}) a) t GROUP BY page, orient) m ON s.page = m.page AND s.orient = m.orient WHERE spacing IS NOT NULL GROUP BY s.page, s.orient""")
both("openings_gap", "W3 O1", "SELECT page, orient, count(*) AS n_openings, sum(width) AS total_gap, max(width) AS widest FROM {openings} GROUP BY page, orient")

_RUNS = """
SELECT page, orient, bucket, island, min(s) AS s, max(e) AS e, count(*) AS parts, sum(hole) AS holes, round(greatest(0.35e0, least(0.88e0, least(0.88e0, 0.45e0 + (max(e) - min(s)) / 192) + CASE WHEN count(*) > 1 THEN 0.04e0 ELSE 0e0 END
  - CASE WHEN sum(hole) > 2 THEN least(0.2e0, 0.75e0 * sum(hole) / (max(e) - min(s))) ELSE 0e0 END - CASE WHEN count(*) > 6 THEN 0.04e0 ELSE 0e0 END)), 9) AS confidence
FROM (SELECT *, CAST(sum(CASE WHEN frontier IS NULL OR s > frontier + 6 THEN 1 ELSE 0 END) OVER (PARTITION BY page, orient, bucket ORDER BY s, e DESC, prim_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island,
    greatest(0e0, CASE WHEN s <= frontier + 6 THEN s - frontier ELSE 0e0 END) AS hole
  FROM (SELECT *, max(e) OVER (PARTITION BY page, orient, bucket ORDER BY s, e DESC, prim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS frontier FROM (SELECT *, CAST(bround(coord / 2, 0) AS BIGINT) AS bucket FROM {walls}) b) f) i
GROUP BY page, orient, bucket, island HAVING max(e) - min(s) >= 24"""


@query("wall_runs", "W4 W5 WL8 WL13", _RUNS)
def wall_runs(load):
    """Strokes of one line merged over gaps of up to 6, with confidence by length, parts and holes."""
    runs = islands(load("walls").withColumn("bucket", F.bround(F.col("coord") / 2, 0).cast("long")), ["page", "orient", "bucket"], 6.0)
    size = F.col("e") - F.col("s")
    score = F.least(F.lit(0.88), 0.45 + size / 192) + F.when(F.col("parts") > 1, 0.04).otherwise(0.0)
    score = score - F.when(F.col("holes") > 2, F.least(F.lit(0.2), 0.75 * F.col("holes") / size)).otherwise(0.0) - F.when(F.col("parts") > 6, 0.04).otherwise(0.0)
    return runs.where(size >= 24).withColumn("confidence", F.round(F.greatest(F.lit(0.35), F.least(F.lit(0.88), score)), 9))


both("coordinate_clusters", "W6 A10", """
SELECT page, orient, cluster, count(*) AS n, min(coord) AS low, max(coord) AS high, median(coord) AS middle FROM (
  SELECT *, CAST(sum(CASE WHEN prev IS NULL OR coord - prev > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY page, orient ORDER BY coord, prim_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster
  FROM (SELECT page, orient, coord, prim_id, lag(coord) OVER (PARTITION BY page, orient ORDER BY coord, prim_id) AS prev FROM {walls}) l) c GROUP BY page, orient, cluster""")
both("text_lines", "W12 J24", """
SELECT page, y, line, min(x) AS x, count(*) AS words, min_by(text, x * 1000000e0 + id) AS first_word FROM (
  SELECT *, CAST(sum(CASE WHEN prev IS NULL OR x - prev > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY page, y ORDER BY x, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line FROM (SELECT id, page, x, y, text, lag(x) OVER (PARTITION BY page, y ORDER BY x, id) AS prev FROM (SELECT id, page % 10 AS page, x, CAST(floor(y / 20) * 20 AS BIGINT) AS y, text FROM {texts}) t) l) s GROUP BY page, y, line""")
both("dimension_fragments", "W15", """
SELECT id, concat(text, ' ', next_text) AS merged FROM (SELECT id, text, x, lead(text) OVER (PARTITION BY page, y ORDER BY x, id) AS next_text, lead(x) OVER (PARTITION BY page, y ORDER BY x, id) AS next_x
  FROM (SELECT id, page % 10 AS page, x, floor(y / 40) AS y, CASE WHEN floor(id / 10) % 2 = 0 THEN concat(size % 30 + 1) ELSE concat(100 + size) END AS text FROM {texts}) f) p
WHERE regexp_extract(text, r'^[0-9][0-9]?$', 0) <> '' AND regexp_extract(next_text, r'^[0-9][0-9][0-9]$', 0) <> '' AND next_x - x <= 240""")
both("dedupe_best", "W10 GW1", "SELECT page, category, label, id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY page, category, label ORDER BY confidence DESC, id) AS rn FROM {items}) r WHERE rn = 1")
both("sequence_numbers", "W11 T1", "SELECT concat('page:', page, ':item:', row_number() OVER (PARTITION BY page ORDER BY category, y, x, id)) AS item_id, id FROM {items}")
both("turning_chains", "W14", """
SELECT page, chain, turn, count(*) AS n, round(sum(sweep), 6) AS swept FROM (SELECT *, CAST(sum(CASE WHEN turn = prev THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chain FROM (
  SELECT id, page, sweep, turn, lag(turn) OVER (PARTITION BY page ORDER BY id) AS prev FROM (SELECT id, page, sweep, CASE WHEN start_at < 1 THEN 'left' ELSE 'right' END AS turn FROM {arcs}) a) b) c GROUP BY page, chain, turn""")

POINTS = """SELECT w.prim_id, w.page, w.orient, w.coord, w.s, w.e, p.pos FROM {walls} w JOIN (SELECT prim_id, s AS pos FROM {walls} UNION SELECT prim_id, e AS pos FROM {walls}
  UNION SELECT a.prim_id, b.coord AS pos FROM {walls} a JOIN {walls} b ON a.page = b.page AND a.orient <> b.orient AND b.coord > a.s AND b.coord < a.e AND a.coord BETWEEN b.s AND b.e) p ON w.prim_id = p.prim_id"""
_EDGES = "SELECT prim_id, page, count(*) AS edges, sum(next_pos - pos) AS total, min(next_pos - pos) AS shortest FROM (SELECT *, lead(pos) OVER (PARTITION BY prim_id ORDER BY pos) AS next_pos FROM {points} p) q WHERE next_pos - pos >= 2 GROUP BY prim_id, page"


def split_points(walls):
    """(prim_id, page, orient, coord, s, e, pos): each stroke's ends and where others meet it, once each."""
    met = crossings(walls).select("prim_id", "pos")
    at = walls.select("prim_id", F.col("s").alias("pos")).unionByName(walls.select("prim_id", F.col("e").alias("pos"))).unionByName(met).distinct()
    return walls.select("prim_id", "page", "orient", "coord", "s", "e").join(at, "prim_id")


@query("wall_edges_split", "W13 G4 RT2 G11", _EDGES.replace("{points}", f"({POINTS})"))
def wall_edges_split(load):
    """Strokes cut where others meet them: how many edges of 2 and more, and their lengths."""
    points = split_points(load("walls"))
    return over(lambda name: points, _EDGES)
