"""The wall graph: nodes and their kind, components, repairs, openings on their walls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.registry import both, near, query, side
from ..operators.windows import POINTS, split_points
from .view import over

both("orthogonalized", "G1 A10", """
SELECT prim_id, CASE WHEN abs(y2 - y1) <= 1.5e0 THEN (y1 + y2) / 2 ELSE y1 END AS y1, CASE WHEN abs(y2 - y1) <= 1.5e0 THEN (y1 + y2) / 2 ELSE y2 END AS y2, CASE WHEN abs(x2 - x1) <= 1.5e0 THEN (x1 + x2) / 2 ELSE x1 END AS x1, CASE WHEN abs(x2 - x1) <= 1.5e0 THEN (x1 + x2) / 2 ELSE x2 END AS x2
FROM {segs} WHERE layer = 'A-WALL'""")

#: Each edge leaves its two nodes in opposite directions.
_HALF = """SELECT page, CASE WHEN orient = 'H' THEN pos ELSE coord END AS x, CASE WHEN orient = 'H' THEN coord ELSE pos END AS y, CASE WHEN orient = 'H' THEN 'E' ELSE 'S' END AS dir FROM {points} p WHERE pos < e
  UNION ALL SELECT page, CASE WHEN orient = 'H' THEN pos ELSE coord END AS x, CASE WHEN orient = 'H' THEN coord ELSE pos END AS y, CASE WHEN orient = 'H' THEN 'W' ELSE 'N' END AS dir FROM {points} p WHERE pos > s"""
_NODES = f"""
SELECT page, x, y, degree, CASE WHEN degree <= 1 THEN 'Endpoint' WHEN degree = 2 AND (n_ * s_ > 0 OR e_ * w_ > 0) THEN 'Inline' WHEN degree = 2 THEN 'Corner' WHEN degree = 3 THEN 'TJunction' ELSE 'Crossing' END AS kind, concat(CASE WHEN n_ > 0 THEN 'N' ELSE '' END, CASE WHEN e_ > 0 THEN 'E' ELSE '' END, CASE WHEN s_ > 0 THEN 'S' ELSE '' END, CASE WHEN w_ > 0 THEN 'W' ELSE '' END) AS directions
FROM (SELECT page, x, y, n_ + s_ + e_ + w_ AS degree, n_, s_, e_, w_ FROM (SELECT page, x, y, max(CASE WHEN dir = 'N' THEN 1 ELSE 0 END) AS n_, max(CASE WHEN dir = 'S' THEN 1 ELSE 0 END) AS s_, max(CASE WHEN dir = 'E' THEN 1 ELSE 0 END) AS e_, max(CASE WHEN dir = 'W' THEN 1 ELSE 0 END) AS w_
  FROM (SELECT page, bround(x / 2, 0) * 2 AS x, bround(y / 2, 0) * 2 AS y, dir FROM ({_HALF}) h) k GROUP BY page, x, y) g) d"""


@query("node_degree_kind", "G6 G5", _NODES.replace("{points}", f"({POINTS})"))
def node_degree_kind(load):
    """Nodes of the wall graph, within 2, where strokes end or meet, by the directions that leave them."""
    points = split_points(load("walls"))
    return over(lambda name: points, _NODES)


_CC = """WITH RECURSIVE e AS (SELECT a, b FROM {graph} UNION SELECT b, a FROM {graph}), r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS node, min(b) AS component FROM r GROUP BY a)"""


@query("wall_components", "G7 Q2", f"{_CC} SELECT component, count(*) AS nodes FROM c GROUP BY component")
def wall_components(load):
    """Connected components of the wall graph."""
    return connected_components(load("graph").select("a", "b")).groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))


@query("component_kind", "G8 OB3 FLT3", f"""{_CC}, s AS (SELECT component, count(*) AS edges, sum(length) AS total, min(page) AS page FROM {{graph}} g JOIN c ON g.a = c.node GROUP BY component)
SELECT component, page, edges, total, CASE WHEN row_number() OVER (PARTITION BY page ORDER BY total DESC, component) = 1 THEN 'Main' WHEN edges >= 4 AND total >= 80 THEN 'Secondary' WHEN edges >= 3 THEN 'ObjectLikeIsland' ELSE 'IsolatedFragment' END AS kind FROM s""")
def component_kind(load):
    """Each component's size and what it counts as on its page."""
    from pyspark.sql import Window

    g = load("graph")
    c = connected_components(g.select("a", "b"))
    s = g.join(c, g["a"] == c["node"]).groupBy("component").agg(F.count(F.lit(1)).alias("edges"), F.sum("length").alias("total"), F.min("page").alias("page"))
    rank = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("total"), "component"))
    kind = F.when(rank == 1, "Main").when((F.col("edges") >= 4) & (F.col("total") >= 80), "Secondary").when(F.col("edges") >= 3, "ObjectLikeIsland").otherwise("IsolatedFragment")
    return s.select("component", "page", "edges", "total", kind.alias("kind"))


_AHEAD = {"a": side("{walls}", 96, x="e"), "b": side("{walls}", 96, x=("s - 48", "s"))}
near("repair_candidates", "G9 G10", """
SELECT page, orient, coord, from_id, to_id, gap, CASE WHEN gap <= 8 THEN 'Minor' WHEN gap <= 24 THEN 'Moderate' ELSE 'Major' END AS severity FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY gap, to_id) AS rn FROM (
  SELECT a.page, a.orient, a.coord, a.prim_id AS from_id, b.prim_id AS to_id, b.s - a.e AS gap FROM [a] JOIN [b] ON [a=b] AND a.orient = b.orient AND a.coord = b.coord AND b.s > a.e AND b.s - a.e <= 48) c) r WHERE rn = 1""", **_AHEAD)
near("opening_repair_suppression", "G9 J20", """
SELECT r.from_id, r.to_id FROM (SELECT a.page, a.orient, a.coord, a.prim_id AS from_id, b.prim_id AS to_id, a.e, b.s FROM [a] JOIN [b] ON [a=b] AND a.orient = b.orient AND a.coord = b.coord AND b.s > a.e AND b.s - a.e <= 48) r
ANTI JOIN {openings} o ON o.page = r.page AND o.orient = r.orient AND abs(o.coord - r.coord) <= 6 AND o.s <= r.s AND o.e >= r.e""", **_AHEAD)
near("clean_spans", "G12", """
SELECT a.prim_id, a.page FROM [a] ANTI JOIN [b] ON [b=a] AND b.orient = a.orient AND abs(b.coord - a.coord) <= 2 AND b.prim_id <> a.prim_id AND b.s <= a.s AND b.e >= a.e AND (b.e - b.s > a.e - a.s OR b.prim_id < a.prim_id)""", a=side("{walls}", 60, x="coord", y="s"), b=side("{walls}", 60, x=("coord - 2", "coord + 2"), y=("s", "e")))
both("wall_footprints", "G13", "SELECT prim_id, CASE WHEN orient = 'H' THEN s ELSE coord - 4 END AS x, CASE WHEN orient = 'H' THEN coord - 4 ELSE s END AS y, CASE WHEN orient = 'H' THEN e - s ELSE 8e0 END AS w, CASE WHEN orient = 'H' THEN 8e0 ELSE e - s END AS h FROM {walls}")

_AT = "SELECT o.*, CASE WHEN o.orient = 'H' THEN (o.s + o.e) / 2 ELSE o.coord END AS mx, CASE WHEN o.orient = 'H' THEN o.coord ELSE (o.s + o.e) / 2 END AS my FROM {openings} o"
near("opening_classify", "O2 O3", """
SELECT o.id, o.page, o.width, count(a.id) AS arcs, CASE WHEN count(a.id) >= 2 THEN 'DoubleSwing' WHEN count(a.id) = 1 THEN 'Hinged' WHEN o.width >= 48 THEN 'Sliding' WHEN o.width >= 32 THEN 'Window' ELSE 'Opening' END AS kind,
  CASE WHEN count(a.id) >= 2 THEN 0.83e0 WHEN count(a.id) = 1 THEN 0.8e0 WHEN o.width >= 32 THEN 0.68e0 ELSE 0.5e0 END AS confidence
FROM [o] LEFT JOIN [a] ON [a=o] AND abs(a.cx - o.mx) <= o.width / 2 + 6 AND abs(a.cy - o.my) <= o.width / 2 + 6 AND a.r BETWEEN 0.6e0 * o.width AND 1.6e0 * o.width GROUP BY o.id, o.page, o.width""",
  o=side(f"({_AT})", 40, x=("mx - width / 2 - 6", "mx + width / 2 + 6"), y=("my - width / 2 - 6", "my + width / 2 + 6")), a=side("{arcs}", 40, x="cx", y="cy"))
#: The arc whose centre is nearest to a jamb is the leaf's swing; its middle tells the side.
near("opening_swing", "O4 GEO18", """
SELECT id, arc, CASE WHEN to_start <= to_end THEN 'StartJamb' ELSE 'EndJamb' END AS hinge, CASE WHEN (orient = 'H' AND cy + r * sin(start_at + sweep / 2) >= coord) OR (orient = 'V' AND cx + r * cos(start_at + sweep / 2) >= coord) THEN 'PositiveCoordinateSide' ELSE 'NegativeCoordinateSide' END AS swing_side,
  CASE WHEN sweep < 0 THEN 'Clockwise' ELSE 'CounterClockwise' END AS swing, CASE WHEN orient = 'V' THEN coord WHEN to_start <= to_end THEN s ELSE e END AS hinge_x, CASE WHEN orient = 'H' THEN coord WHEN to_start <= to_end THEN s ELSE e END AS hinge_y
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY least(to_start, to_end), arc) AS rn FROM (
  SELECT o.id, o.orient, o.coord, o.s, o.e, a.id AS arc, a.cx, a.cy, a.r, a.start_at, a.sweep, abs(CASE WHEN o.orient = 'H' THEN a.cx ELSE a.cy END - o.s) AS to_start, abs(CASE WHEN o.orient = 'H' THEN a.cx ELSE a.cy END - o.e) AS to_end
  FROM [o] JOIN [a] ON [a=o] AND abs(a.cx - o.mx) <= o.width / 2 + 6 AND abs(a.cy - o.my) <= o.width / 2 + 6 AND a.r BETWEEN 0.6e0 * o.width AND 1.6e0 * o.width) d) k WHERE rn = 1""",
  o=side(f"({_AT})", 40, x=("mx - width / 2 - 6", "mx + width / 2 + 6"), y=("my - width / 2 - 6", "my + width / 2 + 6")), a=side("{arcs}", 40, x="cx", y="cy"))
both("opening_placement", "O4", """
SELECT o.id, w.prim_id AS host, o.s - w.s AS offset_start, o.e - w.s AS offset_end, (o.s + o.e) / 2 - w.s AS offset_middle, o.width, CASE WHEN o.orient = 'H' THEN o.s ELSE o.coord - 2 END AS fx, CASE WHEN o.orient = 'H' THEN o.coord - 2 ELSE o.s END AS fy
FROM {openings} o JOIN (SELECT page, orient, coord, min(s) AS s, max(e) AS e, min(prim_id) AS prim_id FROM {walls} GROUP BY page, orient, coord) w ON w.page = o.page AND w.orient = o.orient AND w.coord = o.coord""")
near("opening_room_links", "O5", """
SELECT o.id AS opening, r.id AS room, CASE WHEN o.orient = 'H' THEN CASE WHEN r.y + r.h / 2 > o.my THEN 1 ELSE -1 END ELSE CASE WHEN r.x + r.w / 2 > o.mx THEN 1 ELSE -1 END END AS side
FROM [o] JOIN [r] ON [r=o] AND o.mx BETWEEN r.x - 6 AND r.x + r.w + 6 AND o.my BETWEEN r.y - 6 AND r.y + r.h + 6""",
  o=side(f"({_AT})", 60, x="mx", y="my"), r=side("{rooms}", 60, x=("x - 6", "x + w + 6"), y=("y - 6", "y + h + 6")))
