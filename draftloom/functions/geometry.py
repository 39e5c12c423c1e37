"""Plane geometry as SQL expressions, the same text for both engines, and the operators made of them.

Page coordinates: origin at the top left, y grows downward. A segment has x1, y1, x2, y2; a box has
x, y, w, h (w or h of 0 is a box still). p and q are prefixes such as `a.`.
"""

from __future__ import annotations

from ..operators.registry import both, near, side

PI = "3.141592653589793e0"


def dist(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"sqrt((({x2}) - ({x1})) * (({x2}) - ({x1})) + (({y2}) - ({y1})) * (({y2}) - ({y1})))"


def length(p: str = "") -> str:
    return dist(f"{p}x1", f"{p}y1", f"{p}x2", f"{p}y2")


def modulo(x: str, by: str) -> str:
    """x modulo by, never negative."""
    return f"(({x}) - ({by}) * floor(({x}) / ({by})))"


def clamp(x: str, low: str = "0e0", high: str = "1e0") -> str:
    return f"greatest({low}, least({high}, {x}))"


def orientation(p: str = "", tolerance: float = 1.5) -> str:
    return f"CASE WHEN abs({p}y1 - {p}y2) <= {tolerance}e0 THEN 'H' WHEN abs({p}x1 - {p}x2) <= {tolerance}e0 THEN 'V' ELSE 'O' END"


def parameter(px: str, py: str, p: str = "") -> str:
    """Where a point projects on a segment: 0 at its start, 1 at its end."""
    return f"CASE WHEN {p}x1 = {p}x2 AND {p}y1 = {p}y2 THEN 0e0 ELSE ((({px}) - {p}x1) * ({p}x2 - {p}x1) + (({py}) - {p}y1) * ({p}y2 - {p}y1)) / nullif(({p}x2 - {p}x1) * ({p}x2 - {p}x1) + ({p}y2 - {p}y1) * ({p}y2 - {p}y1), 0e0) END"


def to_segment(px: str, py: str, p: str = "") -> str:
    """Distance of a point from a segment."""
    t = clamp(parameter(px, py, p))
    return dist(px, py, f"{p}x1 + {t} * ({p}x2 - {p}x1)", f"{p}y1 + {t} * ({p}y2 - {p}y1)")


def overlap_area(p: str, q: str) -> str:
    side = lambda a, n: f"greatest(0e0, least({p}{a} + {p}{n}, {q}{a} + {q}{n}) - greatest({p}{a}, {q}{a}))"
    return f"{side('x', 'w')} * {side('y', 'h')}"


def iou(p: str, q: str) -> str:
    both_ = overlap_area(p, q)
    return f"{both_} / nullif({p}w * {p}h + {q}w * {q}h - {both_}, 0e0)"


def box_distance(p: str, q: str) -> str:
    side = lambda a, n: f"greatest(0e0, greatest({q}{a} - ({p}{a} + {p}{n}), {p}{a} - ({q}{a} + {q}{n})))"
    return f"sqrt({side('x', 'w')} * {side('x', 'w')} + {side('y', 'h')} * {side('y', 'h')})"


def compass(dx: str, dy: str, dominance: float = 1.75) -> str:
    return f"""CASE WHEN abs({dx}) < 1 AND abs({dy}) < 1 THEN 'Unknown' WHEN abs({dx}) >= abs({dy}) * {dominance}e0 THEN CASE WHEN {dx} >= 0 THEN 'East' ELSE 'West' END
        WHEN abs({dy}) >= abs({dx}) * {dominance}e0 THEN CASE WHEN {dy} >= 0 THEN 'South' ELSE 'North' END
        WHEN {dx} >= 0 THEN CASE WHEN {dy} >= 0 THEN 'Southeast' ELSE 'Northeast' END ELSE CASE WHEN {dy} >= 0 THEN 'Southwest' ELSE 'Northwest' END END"""


def opposite(direction: str) -> str:
    pairs = (("North", "South"), ("East", "West"), ("Northeast", "Southwest"), ("Northwest", "Southeast"))
    return f"CASE {direction} {' '.join(f"WHEN '{a}' THEN '{b}' WHEN '{b}' THEN '{a}'" for a, b in pairs)} ELSE 'Unknown' END"


def cross(ax: str, ay: str, bx: str, by: str) -> str:
    return f"(({ax}) * ({by}) - ({ay}) * ({bx}))"


both("segment_geometry", "GEO1 GEO2 GEO5 M1", f"""
SELECT prim_id, {orientation()} AS orient, round({length()}, 6) AS len, (x1 + x2) / 2 AS mid_x, (y1 + y2) / 2 AS mid_y, round(x1 + 0.25e0 * (x2 - x1), 6) AS quarter_x,
  round({modulo("atan2(y2 - y1, x2 - x1)", PI)}, 6) AS angle FROM {{segs}}""")

both("orientation_filter", "FLT2 FLT1 A12", f"""
SELECT page, layer, count(*) AS n, count(CASE WHEN o = 'H' THEN 1 END) AS n_h, count(CASE WHEN o = 'V' THEN 1 END) AS n_v, round(sum(len), 4) AS total FROM (
  SELECT page, layer, {orientation()} AS o, {length()} AS len FROM {{segs}} WHERE layer <> 'A-DIMS' AND x1 >= 20 AND y1 >= 20 AND x2 <= 700 AND y2 <= 700) s WHERE len >= 24 GROUP BY page, layer""")

both("point_projection", "GEO3", f"""
SELECT prim_id, round({clamp(parameter("200e0", "150e0"))}, 9) AS t, round({to_segment("200e0", "150e0")}, 6) AS distance FROM {{segs}}""")

both("rect_overlap_iou", "GEO6 GEO8 GEO13", f"""
SELECT a.id AS a_id, b.id AS b_id, {overlap_area("a.", "b.")} AS overlap, round({iou("a.", "b.")}, 9) AS iou, round({box_distance("a.", "b.")}, 6) AS distance
FROM {{rects}} a JOIN {{rects}} b ON a.page = b.page AND a.kind = b.kind AND a.id < b.id AND a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.h AND b.y <= a.y + a.h""")

both("rect_union", "GEO7 A1", "SELECT page, kind, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS n FROM {rects} GROUP BY page, kind")

both("rect_clip", "GEO6", """
SELECT id, greatest(x, 40e0) AS x, greatest(y, 40e0) AS y, least(x + w, 300e0) - greatest(x, 40e0) AS w, least(y + h, 300e0) - greatest(y, 40e0) AS h, x >= 40 AND y >= 40 AND x + w <= 300 AND y + h <= 300 AS contained
FROM {rects} WHERE least(x + w, 300e0) >= greatest(x, 40e0) AND least(y + h, 300e0) >= greatest(y, 40e0)""")

_EDGES = """SELECT id, page, i, CASE i WHEN 0 THEN x WHEN 1 THEN x + w WHEN 2 THEN x + w ELSE x END AS x1, CASE i WHEN 0 THEN y WHEN 1 THEN y WHEN 2 THEN y + h ELSE y + h END AS y1,
  CASE i WHEN 0 THEN x + w WHEN 1 THEN x + w WHEN 2 THEN x ELSE x END AS x2, CASE i WHEN 0 THEN y WHEN 1 THEN y + h WHEN 2 THEN y + h ELSE y END AS y2
  FROM {rects} CROSS JOIN (VALUES (0), (1), (2), (3)) AS corners(i)"""
both("rectangle_edges", "GEO14", _EDGES)
both("polygon_area", "GEO11", f"SELECT id, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area, sum({length()}) AS perimeter FROM ({_EDGES}) e GROUP BY id")
near("point_in_polygon", "GEO12 J13", f"""
SELECT t.id AS text_id, e.id AS rect_id FROM [t] JOIN [e]
  ON [t=e] AND t.x >= bx AND t.x <= bx + bw AND t.y >= by_ AND t.y <= by_ + bh
GROUP BY t.id, e.id HAVING sum(CASE WHEN (y1 > t.y) <> (y2 > t.y) AND t.x < (x2 - x1) * (t.y - y1) / CASE WHEN y2 = y1 THEN 1e0 ELSE y2 - y1 END + x1 THEN 1 ELSE 0 END) % 2 = 1""",
  t=side("{texts}", 24, x="x", y="y"), e=side(f"(SELECT e.*, r.x AS bx, r.w AS bw, r.y AS by_, r.h AS bh FROM ({_EDGES}) e JOIN {{rects}} r ON r.id = e.id)", 24, x=("bx", "bx + bw"), y=("by_", "by_ + bh")))

near("line_match_metrics", "GEO9 GEO10", f"""
SELECT p_id, t_id, round(degrees(acos(least(1e0, abs(dot)))), 6) AS angle, round(greatest(abs(d1), abs(d2)), 6) AS line_distance, round(ends, 6) AS endpoint_distance,
  round(greatest(0e0, least(greatest(a1, a2), tl) - greatest(least(a1, a2), 0e0)) / greatest(1e0, tl), 9) AS overlap
FROM (SELECT p.id AS p_id, t.id AS t_id, {length("t.")} AS tl,
    ((p.x2 - p.x1) * (t.x2 - t.x1) + (p.y2 - p.y1) * (t.y2 - t.y1)) / ({length("p.")} * {length("t.")}) AS dot,
    {cross("t.x2 - t.x1", "t.y2 - t.y1", "p.x1 - t.x1", "p.y1 - t.y1")} / {length("t.")} AS d1, {cross("t.x2 - t.x1", "t.y2 - t.y1", "p.x2 - t.x1", "p.y2 - t.y1")} / {length("t.")} AS d2,
    least({dist("p.x1", "p.y1", "t.x1", "t.y1")} + {dist("p.x2", "p.y2", "t.x2", "t.y2")}, {dist("p.x1", "p.y1", "t.x2", "t.y2")} + {dist("p.x2", "p.y2", "t.x1", "t.y1")}) / 2 AS ends,
    {parameter("p.x1", "p.y1", "t.")} * {length("t.")} AS a1, {parameter("p.x2", "p.y2", "t.")} * {length("t.")} AS a2
  FROM [p] JOIN [t] ON [p=t] AND abs(p.y1 - t.y1) <= 8 AND abs(p.x1 - t.x1) <= 12) m""",
  p=side("{predicted}", 24, x="x1", y="y1"), t=side("{truth}", 24, x=("x1 - 12", "x1 + 12"), y=("y1 - 8", "y1 + 8")))

both("arc_bounds", "GEO16 GEO18", f"""
SELECT id, round(cx + r * cos(start_at), 6) AS sx, round(cy + r * sin(start_at), 6) AS sy, round(cx + r * cos(start_at + sweep), 6) AS ex, round(cy + r * sin(start_at + sweep), 6) AS ey,
  round(CASE WHEN {modulo(f"0 - start_at", f"2 * {PI}")} <= sweep + 0.012e0 THEN cx + r ELSE greatest(cx + r * cos(start_at), cx + r * cos(start_at + sweep)) END, 6) AS max_x,
  round(CASE WHEN {modulo(f"{PI} - start_at", f"2 * {PI}")} <= sweep + 0.012e0 THEN cx - r ELSE least(cx + r * cos(start_at), cx + r * cos(start_at + sweep)) END, 6) AS min_x,
  CASE WHEN sin(start_at + sweep / 2) >= 0 THEN 'PositiveCoordinateSide' ELSE 'NegativeCoordinateSide' END AS swing_side, CASE WHEN sweep >= 0 THEN 'CounterClockwise' ELSE 'Clockwise' END AS swing FROM {{arcs}}""")

both("circle_through_points", "GEO15", """
SELECT id, round(ux, 4) AS ux, round(uy, 4) AS uy, round(sqrt((ax - ux) * (ax - ux) + (ay - uy) * (ay - uy)), 4) AS radius FROM (
  SELECT *, ((ax * ax + ay * ay) * (by_ - cy_) + (bx * bx + by_ * by_) * (cy_ - ay) + (cx_ * cx_ + cy_ * cy_) * (ay - by_)) / d AS ux,
    ((ax * ax + ay * ay) * (cx_ - bx) + (bx * bx + by_ * by_) * (ax - cx_) + (cx_ * cx_ + cy_ * cy_) * (bx - ax)) / d AS uy FROM (
    SELECT *, 2 * (ax * (by_ - cy_) + bx * (cy_ - ay) + cx_ * (ay - by_)) AS d FROM (
      SELECT id, cx + r * cos(start_at) AS ax, cy + r * sin(start_at) AS ay, cx + r * cos(start_at + sweep / 2) AS bx, cy + r * sin(start_at + sweep / 2) AS by_,
        cx + r * cos(start_at + sweep) AS cx_, cy + r * sin(start_at + sweep) AS cy_ FROM {arcs}) p) q WHERE abs(d) > 1e-9) c""")

both("unit_conversion", "GEO17 M5", """
SELECT id, mm, (e - s) AS drawn, round(mm / nullif(e - s, 0e0), 9) AS mm_per_unit, round((e - s) * 10 / 1000, 9) AS metres_at_10, round((e - s) * (e - s) * 100 / 1000000, 9) AS square_metres_at_10,
  round(abs(mm / nullif(e - s, 0e0) - 10) / greatest(1e0, 10e0), 9) AS relative_difference FROM {dims}""")
