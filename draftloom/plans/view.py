"""The plan model over the driver's tables: arithmetic views, the same text for Spark and DuckDB.

Every coordinate is a multiple of one half, so sums are exact in any order. A view is a SELECT over
the tables it names in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    # Axis-parallel strokes: coord is the fixed coordinate, s to e the extent along the axis.
    "lines": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS prim_id, l_suppkey AS page,
        CASE WHEN l_linenumber % 2 = 1 THEN 'H' ELSE 'V' END AS orient, CAST((l_partkey * 7) % 97 AS DOUBLE) * 5 + CAST(l_orderkey % 3 AS DOUBLE) / 2 AS coord,
        CAST((l_orderkey * 13) % 53 AS DOUBLE) * 10 AS s, CAST((l_orderkey * 13) % 53 AS DOUBLE) * 10 + l_quantity * 4 AS e,
        CASE l_returnflag WHEN 'A' THEN 'A-WALL' WHEN 'R' THEN 'A-DIMS' ELSE '(unlayered)' END AS layer, l_partkey AS part FROM {lineitem}""",
    # Long enough strokes of the wall layer.
    "walls": "SELECT prim_id, page, orient, coord, s, e FROM {lines} WHERE layer = 'A-WALL' AND e - s >= 24",
    # The same strokes as segments, some of them a little or much off their axis.
    "segs": """SELECT prim_id, page, layer, CASE WHEN orient = 'H' THEN s ELSE coord END AS x1, CASE WHEN orient = 'H' THEN coord ELSE s END AS y1,
        CASE WHEN orient = 'H' THEN e ELSE coord + CAST(part % 5 AS DOUBLE) / 2 END AS x2, CASE WHEN orient = 'H' THEN coord + CAST(part % 5 AS DOUBLE) / 2 ELSE e END AS y2 FROM {lines}""",
    "rects": """SELECT event_id AS id, user_id % 40 AS page, CAST(event_id % 89 AS DOUBLE) * 4 AS x, CAST((event_id * 7) % 97 AS DOUBLE) * 4 AS y,
        CAST(1 + event_id % 20 AS DOUBLE) AS w, CAST(1 + event_id % 7 AS DOUBLE) AS h, event_type AS kind FROM {events}""",
    "arcs": """SELECT o_orderkey AS id, o_custkey % 50 AS page, CAST((o_orderkey * 11) % 101 AS DOUBLE) * 4 AS cx, CAST((o_orderkey * 7) % 103 AS DOUBLE) * 4 AS cy,
        CAST(20 + o_orderkey % 40 AS DOUBLE) AS r, CAST(o_custkey % 8 AS DOUBLE) * 0.25e0 AS start_at, 0.5e0 + CAST(o_orderkey % 6 AS DOUBLE) * 0.25e0 AS sweep FROM {orders}""",
    # Short texts as drawings have them: dimensions, scales, tags, room names, grid labels.
    "texts": """SELECT p_partkey AS id, p_partkey % 38 AS page, CAST((p_partkey * 3) % 89 AS DOUBLE) * 4 AS x, CAST((p_partkey * 5) % 97 AS DOUBLE) * 4 AS y,
        CASE p_partkey % 12 WHEN 0 THEN concat(p_size * 50, ' mm') WHEN 1 THEN concat(p_size, ',5 m') WHEN 2 THEN concat('1:', p_size * 10) WHEN 3 THEN concat(p_size, ' ', 500)
          WHEN 4 THEN concat('P', '-', p_size, p_size % 10) WHEN 5 THEN concat(p_size, '''-', p_size % 12, '"') WHEN 6 THEN concat('Bedroom ', p_size) WHEN 7 THEN concat('KITCHEN / ', p_type)
          WHEN 8 THEN concat(substr('ABCDEFGH', CAST(1 + p_size % 8 AS INT), 1), CASE WHEN p_size % 2 = 0 THEN '' ELSE concat(p_size) END) WHEN 9 THEN concat(p_size, '.5 m2')
          WHEN 10 THEN concat('VAV-', p_size, ' ', 'FD-', p_size % 7, CASE WHEN p_size % 3 = 0 THEN ', P-10 AHU2' ELSE '' END) ELSE concat('Corridor ', p_size) END AS text, p_size AS size FROM {part}""",
    "items": """SELECT o_orderkey AS id, o_custkey % 50 AS page, CASE o_orderkey % 7 WHEN 0 THEN 'Door' WHEN 1 THEN 'Fixture' WHEN 2 THEN 'Furniture' WHEN 3 THEN 'Equipment' WHEN 4 THEN 'Stair' WHEN 5 THEN 'Vehicle' ELSE 'Column' END AS category,
        CAST((o_orderkey * 11) % 101 AS DOUBLE) * 5 AS x, CAST((o_orderkey * 7) % 103 AS DOUBLE) * 5 AS y, CAST(2 + o_orderkey % 9 AS DOUBLE) AS w, CAST(2 + o_custkey % 9 AS DOUBLE) AS h,
        CAST(o_orderkey % 20 AS DOUBLE) / 20 AS confidence, o_orderpriority AS label, o_orderstatus AS status FROM {orders}""",
    # Crops of the items, on fewer and fuller sheets.
    "crops": "SELECT id, page % 5 AS page, confidence, w, h FROM {items}",
    # Runs of two versions over the same items, for comparisons.
    "runs": """SELECT CASE WHEN event_id % 2 = 0 THEN 'baseline' ELSE 'candidate' END AS run, concat(CASE WHEN event_id % 3 = 0 THEN 'Case-' ELSE 'case-' END, CAST(event_id % 211 AS VARCHAR(9)), '-', CAST(user_id % 9 AS VARCHAR(9))) AS item,
        min(event_type) AS status, CAST(sum(event_id % 97) % 100 AS DOUBLE) / 100 AS quality, CAST(sum(event_id % 1009) AS DOUBLE) AS duration_ms, CAST(sum(event_id % 13) AS BIGINT) AS walls, CAST(sum(user_id % 5) % 6 AS BIGINT) AS rooms FROM {events} GROUP BY 1, 2""",
    # What was said of each stroke, a sentence a row, with a figure in some.
    "evidence": """SELECT prim_id, n, CASE WHEN n = 0 AND e - s >= 120 THEN 'Trusted long exterior shell' WHEN n = 0 AND coord < 60 THEN 'exterior shell continuity, but alone is not enough' WHEN n = 0 THEN 'Wall or structural source layer' WHEN coord > 300 THEN concat('paired faces with thickness ', CAST(CAST(e - s AS BIGINT) AS VARCHAR(9)), '.5 and coverage 0.', CAST(CAST(s / 10 AS BIGINT) + 10 AS VARCHAR(9))) ELSE 'single stroke' END AS said
        FROM {walls} CROSS JOIN (VALUES (0), (1)) AS v(n) WHERE n = 1 OR coord < 200""",
    # Gaps between the strokes of a line, with the greatest end so far.
    "gaps": """SELECT page, orient, coord, s, e, prim_id, prev_e FROM (SELECT *, max(e) OVER (PARTITION BY page, orient, coord ORDER BY s, e DESC, prim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_e FROM {walls}) w WHERE prev_e IS NOT NULL""",
    "openings": "SELECT concat('o', prim_id) AS id, page, orient, coord, prev_e AS s, s AS e, s - prev_e AS width FROM {gaps} WHERE s - prev_e BETWEEN 8 AND 60",
    # Rooms on a raster of six by six, some of them missing.
    "rooms": """SELECT concat('r', page, '-', k) AS id, page, CAST(k % 6 AS DOUBLE) * 100 AS x, CAST(floor(k / 6) AS DOUBLE) * 80 AS y, CASE WHEN k % 11 = 3 THEN 200e0 ELSE 100e0 END AS w, 80e0 AS h,
        CASE k % 9 WHEN 0 THEN 'Corridor' WHEN 1 THEN 'OFFICE 101' WHEN 2 THEN 'WC' WHEN 3 THEN 'Storage' WHEN 4 THEN 'Open plan office' WHEN 5 THEN 'Stair' WHEN 6 THEN 'Kitchen / dining' WHEN 7 THEN NULL ELSE 'Terrasse' END AS label, confidence
        FROM (SELECT o_custkey AS page, o_orderkey % 36 AS k, max(CAST(o_orderkey % 20 AS DOUBLE) / 20) AS confidence FROM {orders} GROUP BY 1, 2) o""",
    # Predicted and true strokes, for scoring: some match, some are off, some lie where none of the other kind does.
    "truth": """SELECT CAST(event_id AS BIGINT) AS id, user_id % 40 AS page, CAST((event_id * 17) % 61 AS DOUBLE) * 10 AS x1, CAST((event_id * 5) % 71 AS DOUBLE) * 10 + floor((event_id % 4) / 3) * 2000 AS y1, CAST((event_id * 17) % 61 AS DOUBLE) * 10 + 40 + event_id % 30 AS x2, CAST((event_id * 5) % 71 AS DOUBLE) * 10 + floor((event_id % 4) / 3) * 2000 AS y2,
        CASE WHEN event_id % 5 = 0 THEN 'critical' ELSE 'normal' END AS importance, CASE WHEN event_id % 3 = 0 THEN 'exterior' ELSE 'interior' END AS wall_type FROM {events}""",
    "predicted": """SELECT CAST(event_id AS BIGINT) AS id, user_id % 40 AS page, CAST((event_id * 17) % 61 AS DOUBLE) * 10 + event_id % 3 + floor(((event_id + 2) % 5) / 4) * 3000 AS x1, CAST((event_id * 5) % 71 AS DOUBLE) * 10 + event_id % 4 AS y1, CAST((event_id * 17) % 61 AS DOUBLE) * 10 + 36 + event_id % 30 + floor(((event_id + 2) % 5) / 4) * 3000 AS x2, CAST((event_id * 5) % 71 AS DOUBLE) * 10 + event_id % 4 AS y2,
        CASE WHEN event_id % 6 = 0 THEN 'exterior' ELSE 'interior' END AS wall_type, CAST(event_id % 20 AS DOUBLE) / 20 AS confidence FROM {events}""",
    # What each detector matched, missed and found too much on a page, and what went wrong in the page's stages.
    "detections": f"""SELECT page, detector, CAST(sum(m) AS BIGINT) AS matched, CAST(sum(x) AS BIGINT) AS missed, CAST(sum(z) AS BIGINT) AS extra FROM (SELECT user_id % 40 AS page, CASE event_id % 13 {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate('regions dimensions grid_axes walls rooms openings object_aggregates routing_barriers routing_passages routing_obstacles routing_room_use_hints routing_suppressed_objects'.split()))} ELSE 'titles' END AS detector,
        (event_id * 7) % 11 AS m, event_id % 4 AS x, (event_id + user_id) % 3 AS z FROM {{events}}) d GROUP BY page, detector""",
    "health": """SELECT user_id % 40 AS page, CASE event_id % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'missing required' WHEN 3 THEN 'missing optional' WHEN 4 THEN 'empty required' WHEN 5 THEN 'empty optional' ELSE 'empty output' END AS issue, (user_id % 5) * (event_id % 2) AS n, user_id % 6 <> 1 AS ready, user_id % 8 <> 3 AS declared FROM {events} WHERE event_type <> 'click'""",
    # Measured dimensions: a value in mm over a drawn length.
    "dims": """SELECT p_partkey AS id, CAST(floor(p_partkey / 60) AS BIGINT) AS page, CAST((p_partkey * 7) % 6 AS DOUBLE) * 20 AS s, CAST((p_partkey * 7) % 6 AS DOUBLE) * 20 + 20 * (1 + p_size % 6) AS e, CAST(p_partkey % 4 AS DOUBLE) * 30 AS coord,
        CAST(1 + p_size % 6 AS DOUBLE) * CASE WHEN floor(p_partkey / 60) % 7 = 3 AND p_partkey % 2 = 0 THEN 310 WHEN p_partkey % 9 = 0 THEN 260 WHEN p_partkey % 9 = 1 THEN 195 ELSE 200 END AS mm FROM {part}""",
    # Undirected graph of a page's nodes: many small components and some large ones.
    "graph": """SELECT DISTINCT l_suppkey AS page, (l_partkey % 1500) * 100000 + l_suppkey AS a, ((l_partkey * 31 + l_orderkey) % 1500) * 100000 + l_suppkey AS b, l_quantity AS length FROM {lineitem}""",
    # The structural candidates and their evidence.
    "signals": """SELECT o_orderkey AS candidate, o_custkey % 50 AS page, CASE o_custkey % 6 WHEN 0 THEN 'pair' WHEN 1 THEN 'layer' WHEN 2 THEN 'room' WHEN 3 THEN 'shell' WHEN 4 THEN 'oblique' ELSE 'accepted' END AS kind,
        CAST(o_orderkey % 80 AS DOUBLE) / 64 - CAST(o_custkey % 32 AS DOUBLE) / 64 AS weight FROM {orders}""",
}


def needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)))


def loader(tables: dict[str, DataFrame]):
    """load(name) over given tables; a view that is not given is derived from those it names."""

    def load(name: str) -> DataFrame:
        return tables[name] if name in tables else over(load, VIEWS[name])

    return load


def over(load, text: str) -> DataFrame:
    """Spark SQL over the tables in braces."""
    found = {n: load(n) for n in needs(text)}
    spark = next(iter(found.values())).sparkSession if found else SparkSession.active()
    return spark.sql(text, **found)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table, or a view over such."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return sql(spark, sf_dir, VIEWS[name])


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark SQL over tables and views in braces."""
    return spark.sql(text, **{n: frame(spark, sf_dir, n) for n in needs(text)})


#: What DuckDB names otherwise.
_DUCK = ((r"(?<![\w'])r'", "'"), (r"/\*g\*/", ", 'g'"), (r"\bpercentile\(", "quantile_cont("), (r"\bbround\(", "round_even("), (r"\bsha2\((.*?), 256\)", r"sha256(\1)"), (r"\bSTRING\b", "VARCHAR"), (r"\bexplode\(", "unnest("), (r"\bsequence\(", "generate_series("))


def duck(text: str) -> str:
    """The same text for DuckDB: views become common table expressions."""
    order: list[str] = []

    def visit(t: str) -> None:
        for n in needs(t):
            if n in VIEWS and n not in order:
                visit(VIEWS[n])
                order.append(n)

    visit(text)
    plain = lambda t: re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", t).replace("{{", "{").replace("}}", "}")
    body, ctes = plain(text).lstrip(), ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    head = re.match(r"(?i)WITH( RECURSIVE)?\b", body)
    if ctes:
        body = f"WITH{head[1] or '' if head else ''} {ctes}{',' if head else ''} {body[head.end() :] if head else body}"
    for pattern, to in _DUCK:
        body = re.sub(pattern, to, body)
    return body
