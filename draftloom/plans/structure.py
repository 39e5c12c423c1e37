"""Structural inference: signals to scores, relations, objective, selection, canonical runs, readiness."""

from __future__ import annotations

from ..operators.registry import both, near, near_texts, side
from .contacts import known

#: Sides of rooms; facing: on which side of the line the room lies.
_EDGES = "(" + " UNION ALL ".join(f"SELECT id, page, '{o}' AS orient, {at} AS at, {low} AS low, {high} AS high, {facing} AS facing FROM {{rooms}}" for o, at, low, high, facing in (("H", "y", "x", "x + w", 1), ("H", "y + h", "x", "x + w", -1), ("V", "x", "y", "y + h", 1), ("V", "x + w", "y", "y + h", -1))) + ")"
#: A stroke by its line and start, and by all that it covers on lines up to 24 away.
_STARTS = side("{walls}", 60, x="coord", y="s")
UNARY = "SELECT candidate, page, round(greatest(-2e0, least(2e0, sum(weight) - 0.16e0)), 6) AS score FROM (SELECT DISTINCT candidate, page, kind, weight FROM {signals}) s GROUP BY candidate, page"
both("structural_unary", "ST6 ST1", UNARY)
near("structural_signals", "ST2 ST3 ST4 ST5", """
SELECT prim_id, kind, round(weight, 9) AS weight FROM (
  SELECT prim_id, 'confidence' AS kind, (least(0.88e0, 0.45e0 + (e - s) / 192) - 0.45e0) * 0.8e0 AS weight FROM {walls} UNION ALL SELECT prim_id, 'length' AS kind, least(0.22e0, log(2e0, 1 + (e - s) / 24) * 0.045e0) AS weight FROM {walls}
  UNION ALL SELECT a.prim_id, 'body' AS kind, CASE WHEN count(*) >= 2 THEN 0.36e0 ELSE 0.24e0 END AS weight FROM [a] JOIN [b] ON [b=a] AND b.orient = a.orient AND b.prim_id <> a.prim_id AND abs(b.coord - a.coord) BETWEEN 2 AND 24 AND b.s <= a.s AND b.e >= a.e GROUP BY a.prim_id
  UNION ALL SELECT DISTINCT w.prim_id, 'opening-host' AS kind, 0.16e0 AS weight FROM {walls} w JOIN {openings} o ON o.page = w.page AND o.orient = w.orient AND o.coord = w.coord AND (o.s = w.e OR o.e = w.s)
  UNION ALL SELECT prim_id, 'graph' AS kind, 0.18e0 AS weight FROM {walls}
  UNION ALL SELECT f.prim_id, 'junction' AS kind, max(least(0.12e0, 0.05e0 + 0.015e0 * f.met)) AS weight FROM (SELECT n.prim_id, n.end_at, 1 + count(*) AS met FROM [n] JOIN [x] ON [x=n] AND x.orient <> n.orient AND abs(x.coord - n.end_at) <= 3 AND n.coord BETWEEN x.s - 3 AND x.e + 3 GROUP BY n.prim_id, n.end_at) f GROUP BY f.prim_id
  UNION ALL SELECT g.prim_id, 'room-boundary' AS kind, CASE WHEN count(DISTINCT g.facing) = 2 THEN 0.30e0 ELSE 0.16e0 END AS weight FROM (SELECT z.prim_id, r.facing FROM [z] JOIN [r] ON [r=z] AND r.orient = z.orient AND abs(r.at - z.coord) <= 6 AND least(z.e, r.high) - greatest(z.s, r.low) >= 0.5e0 * (z.e - z.s)) g GROUP BY g.prim_id) s""",
  a=_STARTS, b=side("{walls}", 60, x=("coord - 24", "coord + 24"), y=("s", "e")), n=side("(SELECT *, s AS end_at FROM {walls} UNION ALL SELECT *, e AS end_at FROM {walls})", 24, x="end_at", y="coord"), x=side("{walls}", 24, x=("coord - 3", "coord + 3"), y=("s - 3", "e + 3")),
  z=side("{walls}", 12, x="coord"), r=side(_EDGES, 12, x=("at - 6", "at + 6")))
_RELATIONS = near_texts("""SELECT a_id, b_id, kind, round(weight, 9) AS weight, hard FROM (
  SELECT a.prim_id AS a_id, b.prim_id AS b_id, 'duplicate' AS kind, -(0.95e0 + 0.4e0 * (least(a.e, b.e) - greatest(a.s, b.s)) / least(a.e - a.s, b.e - b.s)) AS weight,
    (least(a.e, b.e) - greatest(a.s, b.s)) / least(a.e - a.s, b.e - b.s) >= 0.92e0 AND least(a.e - a.s, b.e - b.s) / greatest(a.e - a.s, b.e - b.s) >= 0.72e0 AS hard
  FROM [a] JOIN [b] ON [a=b] AND a.orient = b.orient AND a.prim_id < b.prim_id AND abs(a.coord - b.coord) <= 1 AND least(a.e, b.e) - greatest(a.s, b.s) >= 0.5e0 * least(a.e - a.s, b.e - b.s)
  UNION ALL SELECT p.prim_id AS a_id, q.prim_id AS b_id, 'continuation' AS kind, 0.10e0 + 0.12e0 * (1 - (q.s - p.e) / 12) AS weight, FALSE AS hard FROM [p] JOIN [q] ON [p=q] AND p.orient = q.orient AND p.coord = q.coord AND q.s - p.e BETWEEN 0 AND 12
  UNION ALL SELECT h.prim_id AS a_id, v.prim_id AS b_id, 'junction' AS kind, 0.18e0 AS weight, FALSE AS hard FROM [h] JOIN [v] ON [h=v] AND h.orient = 'H' AND v.orient = 'V' AND (abs(v.coord - h.s) <= 2 OR abs(v.coord - h.e) <= 2) AND (abs(h.coord - v.s) <= 2 OR abs(h.coord - v.e) <= 2)[own]) r""",
  a=side("{walls}", 8, x="coord"), b=side("{walls}", 8, x=("coord - 1", "coord + 1")), p=side("{walls}", 24, x="e"), q=side("{walls}", 24, x=("s - 12", "s")),
  h=side("{walls}", 24, x="=explode_outer(array_distinct(array(floor(s / 24), floor(e / 24))))", y="coord"), v=side("{walls}", 24, x=("coord - 2", "coord + 2"), y=("s - 2", "e + 2")), own=("", " AND h.in_x = floor(CASE WHEN abs(v.coord - h.s) <= 2 THEN h.s ELSE h.e END / 24)"))
#: What Spark runs; the plain form is for the SQL check.
RELATIONS = _RELATIONS[1]
near("structural_relations", "ST7 J6 J9", "[r]", r=_RELATIONS)
near("structural_dominance", "ST8", """
SELECT candidate, by_ FROM (SELECT a.prim_id AS candidate, b.prim_id AS by_, row_number() OVER (PARTITION BY a.prim_id ORDER BY b.e - b.s DESC, b.prim_id) AS rn FROM [a] JOIN [b] ON [a=b] AND a.orient = b.orient AND abs(a.coord - b.coord) <= 2 AND b.s <= a.s AND b.e >= a.e AND b.e - b.s > a.e - a.s) d WHERE rn = 1""", a=_STARTS, b=side("{walls}", 60, x=("coord - 2", "coord + 2"), y=("s", "e")))
AUTHORITY = "CASE WHEN faces >= 1 AND contacts >= 2 THEN 'Independent' WHEN faces >= 1 THEN 'Corroborated' WHEN contacts >= 1 THEN 'ContextSupported' ELSE 'ReviewOnly' END"
_KNOWN = known("p.s <= w.s AND p.e >= w.e")
_AUTHORITY = f"(SELECT prim_id, {AUTHORITY} AS authority FROM ({_KNOWN}) k)"
both("placement_authority", "ST9 PL1", f"SELECT prim_id, {AUTHORITY} AS authority, round(CASE {AUTHORITY} WHEN 'Independent' THEN 1e0 WHEN 'Corroborated' THEN 0.7e0 WHEN 'ContextSupported' THEN 0.2e0 ELSE -2e0 END + least(0.5e0, len / 1000), 9) AS priority FROM ({_KNOWN}) k")
both("placement_readiness", "PL1 PL3 ST16", f"""
SELECT page, reason, count(*) AS n, sum(len) AS total FROM (SELECT page, len, CASE WHEN {AUTHORITY} = 'ReviewOnly' THEN 'no support' WHEN len < 36 THEN 'too short' WHEN contacts = 0 THEN 'not anchored' ELSE 'ready' END AS reason FROM ({_KNOWN}) k) r GROUP BY page, reason""")
#: The initial selection: unary score of 0.08 or more.
OBJECTIVE = f"""SELECT page, count(*) AS selected, round(sum(score), 6) AS unary FROM ({UNARY}) u WHERE score >= 0.08e0 GROUP BY page"""
both("structural_objective", "ST10 ST11", OBJECTIVE)
near("structural_relation_objective", "ST10 J19", """
SELECT w.page, count(*) AS relations, round(sum(CASE WHEN r.hard THEN -1.5e0 ELSE r.weight END), 6) AS score FROM ([relations]) r JOIN {walls} w ON w.prim_id = r.a_id SEMI JOIN (SELECT prim_id FROM {walls} WHERE e - s >= 48) k ON k.prim_id = r.b_id GROUP BY w.page""", relations=_RELATIONS)
_CLOSURE = "SELECT id, round(least(1e0, covered / perimeter), 9) AS closed, covered / perimeter >= 0.9e0 AS closure FROM ({}) c"
#: A stroke near two sides of a narrow room counts for the first.
_SIDES = "(" + " UNION ALL ".join(f"SELECT id, page, 2 * (w + h) AS perimeter, '{o}' AS orient, {at} AS at, {other} AS other, {low} AS low, {high} AS high, {second} AS second_ FROM {{rooms}}" for o, at, other, low, high, second in (("H", "y", "y + h", "x", "x + w", "FALSE"), ("H", "y + h", "y", "x", "x + w", "TRUE"), ("V", "x", "x + w", "y", "y + h", "FALSE"), ("V", "x + w", "x", "y", "y + h", "TRUE"))) + ")"
_CLOSURES = (_CLOSURE.format("""
SELECT r.id, 2 * (r.w + r.h) AS perimeter, sum(CASE WHEN w.s IS NULL THEN 0e0 ELSE greatest(0e0, least(w.e, CASE WHEN w.orient = 'H' THEN r.x + r.w ELSE r.y + r.h END) - greatest(w.s, CASE WHEN w.orient = 'H' THEN r.x ELSE r.y END)) END) AS covered
  FROM {rooms} r LEFT JOIN {walls} w ON w.page = r.page AND ((w.orient = 'H' AND (abs(w.coord - r.y) <= 3 OR abs(w.coord - (r.y + r.h)) <= 3)) OR (w.orient = 'V' AND (abs(w.coord - r.x) <= 3 OR abs(w.coord - (r.x + r.w)) <= 3))) GROUP BY r.id, r.w, r.h"""), _CLOSURE.format(near_texts("""
SELECT r.id, r.perimeter, sum(CASE WHEN w.s IS NULL THEN 0e0 ELSE greatest(0e0, least(w.e, r.high) - greatest(w.s, r.low)) END) AS covered FROM [r] LEFT JOIN [w] ON [r=w] AND w.orient = r.orient AND abs(w.coord - r.at) <= 3 AND NOT (r.second_ AND abs(w.coord - r.other) <= 3) GROUP BY r.id, r.perimeter""",
  r=side(_SIDES, 12, x="at"), w=side("{walls}", 12, x=("coord - 3", "coord + 3")))[1]))
near("room_closures", "ST17 A16", "[all]", all=_CLOSURES)
both("global_wall_metrics", "GW3 A15", """
SELECT page, round(major, 9) AS major, round(long_, 9) AS long_, round(dup, 9) AS dup, round(0.34e0 * major + 0.14e0 * long_ + 0.16e0 * ends + 0.12e0 * conf - 0.22e0 * dup - 0.18e0 * noise, 9) AS objective FROM (
  SELECT page, sum(CASE WHEN len >= 48 THEN len ELSE 0e0 END) / sum(len) AS major, sum(CASE WHEN len >= 120 THEN len ELSE 0e0 END) / sum(len) AS long_, avg(CASE WHEN contacts >= 2 THEN 1e0 ELSE 0e0 END) AS ends, avg(least(0.88e0, 0.45e0 + len / 192)) AS conf,
    sum(CASE WHEN faces >= 3 THEN len ELSE 0e0 END) / sum(len) AS dup, sum(CASE WHEN contacts = 0 AND faces = 0 THEN len ELSE 0e0 END) / sum(len) AS noise FROM (""" + _KNOWN + ") k GROUP BY page) m")
#: Profiles: least score of a candidate. The objective is that of the metrics over what a profile selects, its coverage that of all.
_SOLVED = f"""SELECT c.page, p.profile, count(*) AS n, 0.34e0 * sum(CASE WHEN len >= 48 THEN len ELSE 0e0 END) / max(all_major) + 0.14e0 * sum(CASE WHEN len >= 120 THEN len ELSE 0e0 END) / max(all_long) + 0.16e0 * avg(CASE WHEN contacts >= 2 THEN 1e0 ELSE 0e0 END) + 0.12e0 * avg(score)
    - 0.22e0 * sum(CASE WHEN faces >= 3 THEN len ELSE 0e0 END) / sum(len) - 0.18e0 * sum(CASE WHEN contacts = 0 AND faces = 0 THEN len ELSE 0e0 END) / sum(len) AS objective, sum(CASE WHEN contacts = 0 AND faces = 0 THEN len ELSE 0e0 END) / sum(len) AS noise
  FROM (SELECT *, least(0.88e0, 0.24e0 + len / 400 + 0.12e0 * least(2, faces) + 0.1e0 * least(2, contacts)) AS score FROM ({_KNOWN}) k) c
  JOIN (SELECT page, greatest(1e0, sum(CASE WHEN len >= 48 THEN len ELSE 0e0 END)) AS all_major, greatest(1e0, sum(CASE WHEN len >= 120 THEN len ELSE 0e0 END)) AS all_long FROM ({_KNOWN}) k GROUP BY page) a ON a.page = c.page
  JOIN (VALUES ('balanced', 0.48e0), ('conservative', 0.60e0), ('recall-first', 0.36e0)) AS p(profile, least_) ON c.score >= least_ GROUP BY c.page, p.profile"""
#: The best objective wins; a profile whose noise is above 0.08 gives way to the best of those below, if there is one.
both("hypothesis_select", "GW2 GW4", f"""
SELECT page, profile, n, round(objective, 9) AS objective, noise > 0.08e0 AS noisy FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN noise > 0.08e0 THEN 1 ELSE 0 END, round(objective, 9) DESC, profile) AS rn FROM ({_SOLVED}) s) r WHERE rn = 1""")
#: What is placed on a page, a row each: its box and whether it may be used without review.
near("placement_export", "SNK3 PL1", """
SELECT kind, page, id, x, y, w, h, ready FROM (
  SELECT 'wall' AS kind, v.page, v.prim_id AS id, CASE WHEN orient = 'H' THEN s ELSE coord END AS x, CASE WHEN orient = 'H' THEN coord ELSE s END AS y, CASE WHEN orient = 'H' THEN e - s ELSE 0e0 END AS w, CASE WHEN orient = 'H' THEN 0e0 ELSE e - s END AS h, k.authority <> 'ReviewOnly' AS ready FROM {walls} v JOIN [authority] k ON k.prim_id = v.prim_id
  UNION ALL SELECT 'opening' AS kind, page, id, CASE WHEN orient = 'H' THEN s ELSE coord END AS x, CASE WHEN orient = 'H' THEN coord ELSE s END AS y, CASE WHEN orient = 'H' THEN width ELSE 0e0 END AS w, CASE WHEN orient = 'H' THEN 0e0 ELSE width END AS h, width BETWEEN 8 AND 60 AS ready FROM {openings}
  UNION ALL SELECT 'room' AS kind, page, id, x, y, w, h, confidence >= 0.65e0 AND label IS NOT NULL AS ready FROM {rooms}
  UNION ALL SELECT 'object' AS kind, page, CAST(id AS VARCHAR(20)) AS id, x, y, w, h, confidence >= 0.65e0 AS ready FROM {items}) p""",
  authority=(_AUTHORITY, _AUTHORITY))
#: The canonical structure of each page and how far it can be relied on.
near("structure_quality", "SNK4 PL3", """
SELECT w.page, w.walls, w.total, round(w.supported / w.total, 9) AS supported, coalesce(r.rooms, 0) AS rooms, round(coalesce(r.closed, 0e0), 9) AS closed,
  CASE WHEN w.supported / w.total >= 0.8e0 AND coalesce(r.closed, 0e0) >= 0.6e0 THEN 'Reliable' WHEN w.supported / w.total >= 0.5e0 THEN 'Partial' ELSE 'Review' END AS grade
FROM (SELECT page, count(*) AS walls, sum(e - s) AS total, sum(CASE WHEN k.authority <> 'ReviewOnly' THEN e - s ELSE 0e0 END) AS supported FROM {walls} v JOIN [authority] k ON k.prim_id = v.prim_id GROUP BY page) w
LEFT JOIN (SELECT m.page, count(*) AS rooms, avg(c.closed) AS closed FROM {rooms} m JOIN ([closures]) c ON c.id = m.id GROUP BY m.page) r ON r.page = w.page""",
  authority=(_AUTHORITY, _AUTHORITY), closures=_CLOSURES)
both("evidence_votes", "GW5 A8", """
SELECT page, orient, bucket, round(sum(coord * (e - s)) / sum(e - s), 6) AS axis, min(s) AS s, max(e) AS e, count(*) AS votes FROM (SELECT *, CAST(bround(coord / 4, 0) AS BIGINT) AS bucket FROM {walls}) b GROUP BY page, orient, bucket""")
near("inline_topology", "GW7 ST15", """
SELECT w.prim_id, count(CASE WHEN v.s < w.coord - 3 AND v.e > w.coord + 3 THEN 1 END) AS crossings, count(CASE WHEN abs(v.s - w.coord) <= 3 OR abs(v.e - w.coord) <= 3 THEN 1 END) AS tees FROM [w] JOIN [v] ON [v=w] AND v.orient <> w.orient AND v.coord > w.s + 3 AND v.coord < w.e - 3 AND w.coord BETWEEN v.s - 3 AND v.e + 3 GROUP BY w.prim_id""", w=side("{walls}", 60, x=("s", "e"), y="coord"), v=side("{walls}", 60, x="coord", y=("s - 3", "e + 3")))
near("path_topology", "ST15 ST14", """
SELECT a.id AS arc, w.prim_id, round(min(abs(w.coord - a.cy)), 6) AS away FROM [a] JOIN [w] ON [w=a] AND w.orient = 'H' AND abs(w.coord - a.cy) <= 6 AND (abs(w.s - (a.cx + a.r)) <= 6 OR abs(w.e - (a.cx - a.r)) <= 6) GROUP BY a.id, w.prim_id""", a=side("{arcs}", 12, y="cy"), w=side("{walls}", 12, y=("coord - 6", "coord + 6")))
both("structure_validation", "SNK5 JS2", """
SELECT 'duplicate id' AS problem, concat(l_orderkey, '-', l_linenumber) AS id, count(*) AS n FROM {lineitem} GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'reversed interval' AS problem, prim_id AS id, 1 AS n FROM {lines} WHERE e < s
UNION ALL SELECT 'unresolved reference' AS problem, o.id, 1 AS n FROM {openings} o ANTI JOIN {walls} w ON w.page = o.page AND w.orient = o.orient AND w.coord = o.coord AND w.s = o.e
UNION ALL SELECT 'overlap in order' AS problem, prim_id AS id, 1 AS n FROM (SELECT prim_id, s, lag(e) OVER (PARTITION BY page, orient, coord ORDER BY s, prim_id) AS before FROM {walls}) v WHERE before > s""")
