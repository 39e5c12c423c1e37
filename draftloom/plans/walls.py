"""From strokes to walls: patterns that are no walls, types, evidence and its decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import length
from ..operators.registry import both, near, query, side
from ..functions.rules import NOT_TRUSTED, TRUSTED
from .contacts import known
from ..operators.spatial import touching

#: Components of the boxes that touch; the oracle follows the pairs by recursion.
_TOUCH = "SELECT a.id AS a, b.id AS b FROM {rects} a JOIN {rects} b ON a.page = b.page AND a.id <> b.id AND a.x - 8 <= b.x + b.w AND b.x <= a.x + a.w + 8 AND a.y - 8 <= b.y + b.h AND b.y <= a.y + a.h + 8"
_REACH = "reach(a, b) AS (SELECT id AS a, id AS b FROM {rects} UNION SELECT reach.a, t.b FROM reach JOIN touch t ON reach.b = t.a), comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)"


@query("compact_linework", "WL1 OB2", f"""
WITH RECURSIVE touch AS ({_TOUCH}), {_REACH}
SELECT component, count(*) AS n, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, sum(w + h) >= 1.08::DOUBLE * (max(x + w) - min(x) + max(y + h) - min(y)) OR count(*) >= 8 AS dense
FROM comp JOIN {{rects}} USING (id) GROUP BY component HAVING count(*) >= 2 AND (max(x + w) - min(x)) * (max(y + h) - min(y)) <= 0.06::DOUBLE * 160000""")
def compact_linework(load):
    """Small clusters of touching boxes: what they cover, and whether they are as dense as objects are."""
    c = touching(load("rects"), 8.0).groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.expr("x + w")) - F.min("x")).alias("w"), (F.max(F.expr("y + h")) - F.min("y")).alias("h"), F.sum(F.expr("w + h")).alias("ink"))
    return c.where((F.col("n") >= 2) & (F.col("w") * F.col("h") <= 0.06 * 160000)).withColumn("dense", (F.col("ink") >= 1.08 * (F.col("w") + F.col("h"))) | (F.col("n") >= 8)).drop("ink")


near("door_leaf_pairs", "WL2", """
SELECT page, a_id, b_id FROM (SELECT a.page, a.prim_id AS a_id, b.prim_id AS b_id FROM [a] JOIN [b] ON [a=b] AND a.orient = b.orient AND a.prim_id < b.prim_id AND abs(a.coord - b.coord) BETWEEN 1 AND 5 AND abs((a.e - a.s) - (b.e - b.s)) <= 4 AND abs(a.s - b.s) <= 4 WHERE a.e - a.s <= 60) p""", a=side("{walls}", 24, x="coord", y="s"), b=side("{walls}", 24, x=("coord - 5", "coord + 5"), y=("s - 4", "s + 4")))
both("dense_parallel_pattern", "WL4 WL3 A23", """
SELECT page, orient, block, count(*) AS n, median(spacing) AS mid, round(avg(CASE WHEN abs(spacing - mid) <= 0.25e0 * mid THEN 1e0 ELSE 0e0 END), 9) AS regularity, count(*) >= 10 AND avg(CASE WHEN abs(spacing - mid) <= 0.25e0 * mid THEN 1e0 ELSE 0e0 END) >= 0.78e0 AS pattern
FROM (SELECT s.*, m.mid FROM (SELECT page, orient, CAST(floor(s / 100) AS BIGINT) AS block, lead(coord) OVER (PARTITION BY page, orient, floor(s / 100) ORDER BY coord, prim_id) - coord AS spacing FROM {lines}) s
  JOIN (SELECT page, orient, block, median(spacing) AS mid FROM (SELECT page, orient, CAST(floor(s / 100) AS BIGINT) AS block, lead(coord) OVER (PARTITION BY page, orient, floor(s / 100) ORDER BY coord, prim_id) - coord AS spacing FROM {lines}) q GROUP BY 1, 2, 3) m
  ON m.page = s.page AND m.orient = s.orient AND m.block = s.block WHERE spacing IS NOT NULL) x GROUP BY page, orient, block HAVING count(*) >= 8""")
both("dense_orthogonal_pattern", "WL3 WL6", """
SELECT page, block_x, block_y, n_h, n_v, crossings, crossings >= greatest(16e0, 0.32e0 * n_h * n_v) AND n_h >= 5 AND n_v >= 5 AS surface_grid FROM (
  SELECT h.page, h.block_x, v.block_y, count(DISTINCT h.prim_id) AS n_h, count(DISTINCT v.prim_id) AS n_v, count(*) AS crossings
  FROM (SELECT *, CAST(floor((s + e) / 2 / 150) AS BIGINT) AS block_x FROM {lines} WHERE orient = 'H') h JOIN (SELECT *, CAST(floor((s + e) / 2 / 150) AS BIGINT) AS block_y FROM {lines} WHERE orient = 'V') v
    ON h.page = v.page AND floor(v.coord / 150) = h.block_x AND floor(h.coord / 150) = v.block_y AND v.coord BETWEEN h.s AND h.e AND h.coord BETWEEN v.s AND v.e GROUP BY 1, 2, 3) c""")
near("fragment_noise", "WL14", """
SELECT r.prim_id, r.e - r.s AS len FROM [r] ANTI JOIN [f] ON [f=r] AND f.orient = r.orient AND f.prim_id <> r.prim_id AND abs(f.coord - r.coord) BETWEEN 2 AND 24 AND f.s < r.e AND r.s < f.e WHERE r.e - r.s <= 36""", r=side("{walls}", 48, x="coord"), f=side("{walls}", 48, x=("coord - 24", "coord + 24")))
both("filled_bodies", "WL15 G13", """
SELECT id, page, greatest(w, h) AS long_side, least(w, h) AS thickness, CASE WHEN w >= h THEN 'H' ELSE 'V' END AS orient, CASE WHEN w >= h THEN y + h / 2 ELSE x + w / 2 END AS axis FROM {rects} WHERE least(w, h) BETWEEN 2 AND 24 AND greatest(w, h) >= 3 * least(w, h)""")
near("unsupported_bodies", "WL16 WE5", """
SELECT w.prim_id, count(o.prim_id) AS contacts FROM [w] LEFT JOIN [o] ON [o=w] AND o.orient <> w.orient AND o.coord BETWEEN w.s - 2 AND w.e + 2 AND w.coord BETWEEN o.s - 2 AND o.e + 2 GROUP BY w.prim_id HAVING count(o.prim_id) < 2""", w=side("{walls}", 60, x=("s - 2", "e + 2"), y="coord"), o=side("{walls}", 60, x="coord", y=("s - 2", "e + 2")))
near("wall_type_envelope", "WL17", """
SELECT w.prim_id, CASE WHEN w.coord <= b.low + 20 OR w.coord >= b.high - 20 THEN 'Exterior' WHEN outer_ = 0 THEN 'Exterior' WHEN w.e - w.s >= 48 THEN 'Interior' ELSE 'Unknown' END AS type
FROM {walls} w JOIN (SELECT page, orient, min(coord) AS low, max(coord) AS high FROM {walls} GROUP BY page, orient) b ON b.page = w.page AND b.orient = w.orient
JOIN (SELECT a.prim_id, count(o.prim_id) AS outer_ FROM [a] LEFT JOIN [o] ON [o=a] AND o.orient = a.orient AND o.coord > a.coord + 24 AND o.s <= (a.s + a.e) / 2 AND o.e >= (a.s + a.e) / 2 GROUP BY a.prim_id) x ON x.prim_id = w.prim_id""", a=side("{walls}", 60, along="(s + e) / 2"), o=side("{walls}", 60, along=("s", "e")))

#: What is known of each stroke before it is judged; flags instead of sentences.
_FLAGS = known("least(p.e, w.e) - greatest(p.s, w.s) >= 0.55e0 * least(p.e - p.s, w.e - w.s)")
_EVIDENCE = f"""SELECT *, round(greatest(0e0, least(1e0, CASE WHEN faces >= 3 THEN 0.35e0 WHEN faces >= 1 THEN 0.5e0 WHEN len >= 96 THEN 0.22e0 ELSE 0.08e0 END + 0.25e0 + least(0.2e0, 0.1e0 * contacts) - CASE WHEN faces = 0 AND len < 36 THEN 0.25e0 ELSE 0e0 END)), 9) AS score,
  CASE WHEN faces = 0 AND contacts = 0 AND len < 36 THEN 'FragmentNoise' WHEN faces >= 6 THEN 'SurfacePattern' WHEN faces >= 1 AND contacts >= 1 THEN 'PairedWall' WHEN faces >= 1 THEN 'UnanchoredPair' WHEN contacts >= 2 THEN 'SingleLineWall' ELSE 'Weak' END AS category FROM ({_FLAGS}) f"""
both("wall_evidence_score", "WE1 WE2 WE4 WE5", _EVIDENCE)
_DECISION = f"SELECT *, CASE WHEN category IN ('FragmentNoise', 'SurfacePattern') THEN 'Reject' WHEN category IN ('PairedWall', 'SingleLineWall') AND score >= 0.5e0 THEN 'Accept' ELSE 'Review' END AS decision FROM ({_EVIDENCE}) v"
both("wall_topology_partition", "WE2 FLT3", f"SELECT page, decision, count(*) AS n, sum(len) AS total FROM ({_DECISION}) d GROUP BY page, decision")
_SAYS = lambda phrases: " OR ".join(f"contains(lower(said), '{p}')" for p in phrases)
#: Sentences as flags and figures, once: what comes after reads columns. A sentence that takes trust back gives none.
both("evidence_flags", "FLT4 FLT5", f"""
SELECT prim_id, count(*) AS sentences, max(CASE WHEN ({_SAYS(TRUSTED)}) AND NOT ({_SAYS(NOT_TRUSTED)}) THEN 1 ELSE 0 END) = 1 AS trusted, max(TRY_CAST(nullif(regexp_extract(said, r'thickness ([0-9]+[.]?[0-9]*)', 1), '') AS DOUBLE)) AS thickness, max(TRY_CAST(nullif(regexp_extract(said, r'coverage ([0-9]+[.]?[0-9]*)', 1), '') AS DOUBLE)) AS coverage
FROM {{evidence}} GROUP BY prim_id""")
near("missing_band_recovery", "WE3", """
SELECT page, prim_id, len FROM (SELECT l.page, l.prim_id, l.e - l.s AS len, row_number() OVER (PARTITION BY l.page ORDER BY l.e - l.s DESC, l.prim_id) AS rn FROM [l]
  ANTI JOIN [w] ON [w=l] AND w.orient = l.orient AND abs(w.coord - l.coord) <= 2 AND w.s <= l.s AND w.e >= l.e WHERE l.layer = '(unlayered)' AND l.e - l.s >= 24) r WHERE rn <= 60""", l=side("{lines}", 60, x="coord", y="s"), w=side("{walls}", 60, x=("coord - 2", "coord + 2"), y=("s", "e")))
both("non_axis_runs", "WL9", f"""
SELECT page, direction, offset_, count(*) AS parts, round(min(along), 3) AS s, round(max(along + len), 3) AS e FROM (SELECT page, CAST(bround(degrees(atan2(y2 - y1, x2 - x1)) / 2, 0) AS BIGINT) AS direction, {length()} AS len,
  CAST(floor((y1 * (x2 - x1) - x1 * (y2 - y1)) / {length()} / 4) AS BIGINT) AS offset_, (x1 * (x2 - x1) + y1 * (y2 - y1)) / {length()} AS along FROM {{segs}} WHERE abs(x1 - x2) > 1.5e0 AND abs(y1 - y2) > 1.5e0) d GROUP BY page, direction, offset_""")
