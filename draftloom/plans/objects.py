"""Objects, their groups and aggregates, and the routing layer made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.registry import both, near, query, side

_BUCKET = lambda x: f"greatest(1e0, bround({x} / 5, 0) * 5)"
SIGNATURE = f"concat_ws('|', lower(category), lower(label), concat(CAST({_BUCKET('w')} AS BIGINT), 'x', CAST({_BUCKET('h')} AS BIGINT)))"
both("object_signature_groups", "OB5 A3 STR18", f"""
SELECT page, signature, count(*) AS n, min(x) AS x, min(y) AS y, max(x + w) AS max_x, max(y + h) AS max_y, min(id) AS first_id, max(CASE WHEN confidence < 0.65e0 THEN 1 ELSE 0 END) = 1 AS needs_review, substr(sha2(concat(page, ':', signature), 256), 1, 16) AS group_id
FROM (SELECT *, {SIGNATURE} AS signature FROM {{items}}) s GROUP BY page, signature""")
#: Objects of one room (a raster of 100 by 80) and within reach of one another form an aggregate.
_NEAR = """SELECT a.id AS a, b.id AS b FROM {items} a JOIN {items} b ON a.page = b.page AND a.id <> b.id AND floor(a.x / 100) = floor(b.x / 100) AND floor(a.y / 80) = floor(b.y / 80)
  AND a.x - 16 <= b.x + b.w AND b.x <= a.x + a.w + 16 AND a.y - 16 <= b.y + b.h AND b.y <= a.y + a.h + 16"""
#: What a category means for routes; a category not listed: Unknown. Fixed values.
INFLUENCE = {"Vehicle": "RoomUseEvidenceOnly", "Furniture": "SoftObstacle", **dict.fromkeys("Fixture PlumbingFixture ElectricalDevice Lighting HVACEquipment FireSafety Equipment".split(), "HardObstacle"), **dict.fromkeys("Stair Elevator Column Shaft Structural".split(), "StructuralBarrier")}
#: An aggregate is of the category of most of its members (ties: by name) if those are two and half of all; a vehicle makes it one.
_KIND = "CASE WHEN vehicles > 0 THEN 'Vehicle' WHEN most >= greatest(2, CAST(floor(n / 2) AS BIGINT)) THEN first_ ELSE 'GenericSymbol' END"
_ROUTES = f"CASE {_KIND} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in INFLUENCE.items())} ELSE 'Unknown' END"


@query("object_aggregates", "OB6 OB2 A4", f"""
WITH RECURSIVE e AS ({_NEAR}), r(a, b) AS (SELECT id, id FROM {{items}} UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS id, min(b) AS aggregate_id FROM r GROUP BY a)
SELECT aggregate_id, n, categories, x, y, {_KIND} AS category, {_ROUTES} AS influence FROM (SELECT aggregate_id, CAST(sum(k) AS BIGINT) AS n, count(*) AS categories, min(x) AS x, min(y) AS y, CAST(sum(CASE WHEN category = 'Vehicle' THEN k ELSE 0 END) AS BIGINT) AS vehicles, max(k) AS most, (array_agg(category ORDER BY k DESC, category))[1] AS first_
  FROM (SELECT aggregate_id, category, count(*) AS k, min(x) AS x, min(y) AS y FROM c JOIN {{items}} USING (id) GROUP BY aggregate_id, category) p GROUP BY aggregate_id HAVING sum(k) >= 2) q""")
def object_aggregates(load):
    """Objects close together in one room, what they consist of and how they bear on routing."""
    from ..operators.spatial import touching

    items = load("items").select("id", "page", "category", "x", "y", "w", "h").withColumns({"rx": F.floor(F.col("x") / 100), "ry": F.floor(F.col("y") / 80)})
    parts = touching(items, 16.0, ("page", "rx", "ry")).groupBy(F.col("component").alias("aggregate_id"), "category").agg(F.count(F.lit(1)).alias("k"), F.min("x").alias("x"), F.min("y").alias("y"))
    best = F.min(F.struct((-F.col("k")).alias("k"), "category"))
    rows = parts.groupBy("aggregate_id").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("categories"), F.min("x").alias("x"), F.min("y").alias("y"), F.sum(F.when(F.col("category") == "Vehicle", F.col("k")).otherwise(0)).alias("vehicles"), best.alias("b"))
    rows = rows.where("n >= 2").withColumns({"most": -F.col("b.k"), "first_": F.col("b.category")})
    return rows.select("aggregate_id", "n", "categories", "x", "y", F.expr(_KIND).alias("category"), F.expr(_ROUTES).alias("influence"))


both("object_aggregate_composition", "A4 MP2", "SELECT page, category, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY page), 9) AS share FROM {items} GROUP BY page, category, label")
near("object_room_join", "J13 OB1", "SELECT i.id, r.id AS room, r.label FROM [i] LEFT JOIN [r] ON [r=i] AND i.x + i.w / 2 >= r.x AND i.x + i.w / 2 < r.x + r.w AND i.y + i.h / 2 >= r.y AND i.y + i.h / 2 < r.y + r.h", i=side("{items}", 60, x="x + w / 2", y="y + h / 2"), r=side("{rooms}", 60, x=("x", "x + w"), y=("y", "y + h")))
both("correction_dataset", "OB7 SRC9", """
SELECT category, label, count(*) AS actions, count(CASE WHEN status = 'F' THEN 1 END) AS accepted, count(CASE WHEN status = 'O' THEN 1 END) AS rejected, count(DISTINCT page) AS pages, CASE WHEN count(CASE WHEN status = 'F' THEN 1 END) >= count(CASE WHEN status = 'O' THEN 1 END) THEN category ELSE 'Unknown' END AS corrected FROM {items} GROUP BY category, label""")
both("crop_label_profile", "SRC10 A21", """
SELECT signature, category, n, n >= 2 AND share >= 0.6e0 AS rule FROM (SELECT signature, category, n, round(n / total, 9) AS share, row_number() OVER (PARTITION BY signature ORDER BY n DESC, category) AS rn FROM (
  SELECT label AS signature, category, count(*) AS n, sum(count(*)) OVER (PARTITION BY label) AS total FROM {items} GROUP BY label, category) c) r WHERE rn = 1""")

# Routing ---------------------------------------------------------------------------------------
near("routing_barriers", "RT1 J20", """
SELECT w.prim_id, w.page, w.e - w.s AS len FROM [w] ANTI JOIN {openings} o ON o.page = w.page AND o.orient = w.orient AND o.coord = w.coord AND o.s < w.e AND w.s < o.e
ANTI JOIN (SELECT page, orient, coord FROM {lines} WHERE layer = 'A-DIMS') d ON d.page = w.page AND d.orient = w.orient AND d.coord = w.coord
ANTI JOIN [r] ON [r=w] AND w.orient = 'H' AND r.x <= w.s AND r.x + r.w >= w.e AND w.coord BETWEEN r.y AND r.y + r.h WHERE w.e - w.s >= 30""", w=side("{walls}", 24, x="s", y="coord"), r=side("{rects}", 24, x=("x", "x + w"), y=("y", "y + h")))
near("minor_detail_pattern", "RT3", """
SELECT h.prim_id, count(DISTINCT v.prim_id) AS minor FROM [h] JOIN [v] ON [v=h] AND v.orient <> h.orient AND v.e - v.s <= 60 AND v.coord BETWEEN h.s AND h.e AND (abs(v.s - h.coord) <= 3 OR abs(v.e - h.coord) <= 3) GROUP BY h.prim_id HAVING count(DISTINCT v.prim_id) >= 2""", h=side("{walls}", 60, x=("s", "e"), y="coord"), v=side("{walls}", 60, x="coord", y=("s - 3", "e + 3")))
both("routing_obstacles", "RT4 S1", """
SELECT id, page, CASE WHEN category IN ('Stair', 'Column') THEN 'barrier' WHEN category = 'Door' THEN 'passage' WHEN category = 'Vehicle' THEN 'ignored' WHEN confidence < 0.2e0 THEN 'suppressed' WHEN category = 'Furniture' THEN 'hint' ELSE 'obstacle' END AS role,
  CASE WHEN confidence < 0.2e0 THEN 'low confidence' WHEN category = 'Vehicle' THEN 'room use evidence only' ELSE '' END AS reason FROM {items}
UNION ALL SELECT NULL AS id, page, 'passage' AS role, id AS reason FROM {openings}""")
