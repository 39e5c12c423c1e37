"""Measurements, quality, readiness, benchmarks and comparisons of runs."""

from __future__ import annotations

from ..functions.geometry import dist
from ..operators.registry import both, near, side
from .contacts import known

# Measurements ----------------------------------------------------------------------------------
both("measurement_checks", "A5 M5", """
SELECT page, count(*) AS n, count(CASE WHEN off > 0.12e0 THEN 1 END) AS outliers, round(avg(CASE WHEN off > 0.12e0 THEN 1e0 ELSE 0e0 END), 9) AS ratio, round(max(scale) / min(scale), 6) AS spread, round(median(scale), 6) AS middle,
  count(CASE WHEN off > 0.12e0 THEN 1 END) > 0 AND NOT (count(CASE WHEN off <= 0.12e0 THEN 1 END) >= 6 AND avg(CASE WHEN off <= 0.12e0 THEN 1e0 ELSE 0e0 END) >= 0.7e0) AND (count(CASE WHEN off > 0.12e0 THEN 1 END) > 2 OR avg(CASE WHEN off > 0.12e0 THEN 1e0 ELSE 0e0 END) > 0.25e0 OR max(scale) / min(scale) >= 1.5e0) AS blocking
FROM (SELECT page, mm / (e - s) AS scale, abs(mm / (e - s) - 10) / 10 AS off FROM {dims}) d GROUP BY page""")
near("dominant_scale_cluster", "J18 A6", """
SELECT page, anchor, n, total, n >= 4 AND n >= 0.55e0 * total AND spread <= 1.05e0 AS dominant FROM (SELECT a.page, a.id AS anchor, count(*) AS n, max(t.total) AS total, round(max(b.scale) / min(b.scale), 9) AS spread, row_number() OVER (PARTITION BY a.page ORDER BY count(*) DESC, a.id) AS rn
  FROM [a] JOIN [b] ON [a=b] AND abs(b.scale - a.scale) / a.scale <= 0.03e0 JOIN (SELECT page, count(*) AS total FROM {dims} GROUP BY page) t ON t.page = a.page GROUP BY a.page, a.id) r WHERE rn = 1""",
  a=side("(SELECT id, page, mm / (e - s) AS scale FROM {dims})", 0.06, x="ln(scale)"), b=side("(SELECT id, page, mm / (e - s) AS scale FROM {dims})", 0.06, x=("ln(scale) - 0.031", "ln(scale) + 0.031")))
both("dimension_confidence", "STR6 W10", """
SELECT id, round(least(0.92e0, 0.34e0 + CASE WHEN d.coord > 0 THEN 0.18e0 ELSE 0e0 END + CASE WHEN d.mm >= 1000 THEN 0.10e0 ELSE 0e0 END + CASE WHEN w.prim_id IS NULL THEN 0e0 ELSE 0.22e0 END), 9) AS confidence
FROM {dims} d LEFT JOIN (SELECT page, coord, min(prim_id) AS prim_id FROM {walls} WHERE orient = 'H' GROUP BY page, coord) w ON w.page = d.page AND w.coord = d.coord""")
both("scale_provenance", "A12 GEO17", """
SELECT i.page, count(*) AS measured, count(CASE WHEN g.page IS NULL THEN 1 END) AS unassigned FROM {items} i LEFT JOIN (SELECT page FROM {dims} GROUP BY page HAVING max(mm / (e - s)) / min(mm / (e - s)) <= 1.05e0) g ON g.page = i.page GROUP BY i.page""")

# Regions ---------------------------------------------------------------------------------------
both("sheet_regions", "GEO6 A12 W8", """
SELECT page, region, round(score, 6) AS score, round(least(0.9e0, 0.45e0 + score / 20), 6) AS confidence FROM (SELECT t.page, r.region, sum(CASE WHEN t.x >= r.x AND t.y >= r.y THEN 1.4e0 ELSE 0e0 END) + max(r.bias) AS score, row_number() OVER (PARTITION BY t.page ORDER BY sum(CASE WHEN t.x >= r.x AND t.y >= r.y THEN 1.4e0 ELSE 0e0 END) + max(r.bias) DESC, r.region) AS rn
  FROM {texts} t CROSS JOIN (VALUES ('bottom-right', 240, 240, 1.5e0), ('right', 300, 0, 0e0), ('bottom', 0, 300, 1.0e0)) AS r(region, x, y, bias) GROUP BY t.page, r.region) s WHERE rn = 1 AND score >= 3""")
both("raster_audit", "SRC5 A12", "SELECT page, count(*) AS n, count(CASE WHEN confidence < 0.35e0 THEN 1 END) AS low, count(CASE WHEN confidence < 0.35e0 THEN 1 END) > 0.3e0 * count(*) AS flagged FROM {items} GROUP BY page")
both("image_only_pages", "A12 J20", "SELECT DISTINCT r.page FROM {rects} r ANTI JOIN {texts} t ON t.page = r.page")

# Quality ---------------------------------------------------------------------------------------
#: What is known of each page; calibrated: its measured scales agree within a twentieth once outliers are left out.
_FACTS = """SELECT p.page, p.n AS strokes, coalesce(w.n, 0) AS walls, coalesce(o.n, 0) AS openings, coalesce(r.n, 0) AS rooms, coalesce(w.conf, 0e0) AS conf, coalesce(t.n, 0) AS texts, coalesce(d.outliers, 0e0) AS outliers, coalesce(d.spread, 1e0) AS spread, coalesce(d.agree, 0) >= 4 AND d.inner_spread <= 1.05e0 AS calibrated,
    CASE WHEN d.page IS NULL THEN coalesce(i.n, 0) ELSE 0 END AS unassigned, coalesce(i.review, 0e0) AS review, coalesce(i.low, 0e0) AS low, coalesce(x.warnings, 0) AS warnings, coalesce(k.met, 0) AS met, coalesce(h.errors, 0) AS errors
  FROM (SELECT page, count(*) AS n FROM {lines} GROUP BY page) p
  LEFT JOIN (SELECT page, count(*) AS n, avg(least(0.88e0, 0.45e0 + (e - s) / 192)) AS conf FROM {walls} GROUP BY page) w ON w.page = p.page LEFT JOIN (SELECT page, count(*) AS n FROM {openings} GROUP BY page) o ON o.page = p.page LEFT JOIN (SELECT page, count(*) AS n FROM {rooms} GROUP BY page) r ON r.page = p.page
  LEFT JOIN (SELECT page, count(*) AS n FROM {texts} GROUP BY page) t ON t.page = p.page LEFT JOIN (SELECT page, count(*) AS warnings FROM {rects} WHERE w > 19 AND h > 6 GROUP BY page) x ON x.page = p.page
  LEFT JOIN (SELECT page, sum(contacts) AS met FROM (""" + known("TRUE") + """) c GROUP BY page) k ON k.page = p.page LEFT JOIN (SELECT page, sum(n) AS errors FROM {health} WHERE issue = 'error' GROUP BY page) h ON h.page = p.page
  LEFT JOIN (SELECT page, count(*) AS n, avg(CASE WHEN confidence < 0.5e0 THEN 1e0 ELSE 0e0 END) AS review, avg(CASE WHEN confidence < 0.35e0 THEN 1e0 ELSE 0e0 END) AS low FROM {items} GROUP BY page) i ON i.page = p.page
  LEFT JOIN (SELECT page, avg(CASE WHEN off > 0.12e0 THEN 1e0 ELSE 0e0 END) AS outliers, max(scale) / min(scale) AS spread, count(CASE WHEN off <= 0.12e0 THEN 1 END) AS agree, max(CASE WHEN off <= 0.12e0 THEN scale END) / min(CASE WHEN off <= 0.12e0 THEN scale END) AS inner_spread
    FROM (SELECT page, mm / (e - s) AS scale, abs(mm / (e - s) - 10) / 10 AS off FROM {dims}) m GROUP BY page) d ON d.page = p.page"""
#: What each fault of a page takes off its score.
_PENALTIES = {
    "no plan region": "CASE WHEN texts = 0 AND walls = 0 THEN 0.08e0 ELSE 0e0 END",
    "no walls": "CASE WHEN walls = 0 THEN 0.18e0 ELSE 0e0 END",
    "no topology": "CASE WHEN walls > 0 AND met = 0 THEN 0.1e0 ELSE 0e0 END",
    "no rooms": "CASE WHEN rooms = 0 AND walls >= 3 THEN 0.12e0 ELSE 0e0 END",
    "no calibration": "CASE WHEN calibrated THEN 0e0 ELSE 0.06e0 END",
    "outliers": "least(0.15e0, 0.2e0 * outliers)",
    "scale spread": "CASE WHEN spread >= 1.5e0 THEN least(0.08e0, 0.025e0 + 0.012e0 * ln(spread)) ELSE 0e0 END",
    "no scale group": "CASE WHEN unassigned > 0 THEN least(0.12e0, 0.04e0 + 0.006e0 * unassigned) ELSE 0e0 END",
    "objects to review": "least(0.08e0, 0.12e0 * review)",
    "low confidence": "least(0.06e0, 0.09e0 * low)",
    "errors": "least(0.35e0, 0.08e0 * errors)",
    "low detector confidence": "CASE WHEN walls > 0 AND conf < 0.55e0 THEN 0.1e0 ELSE 0e0 END",
    "warnings": "least(0.12e0, 0.015e0 * warnings)",
}
_SCORE = f"SELECT *, greatest(0e0, 1 - ({' + '.join(_PENALTIES.values())})) AS score FROM ({_FACTS}) f"
_GRADED = f"""SELECT page, walls, openings, rooms, calibrated, round(score, 6) AS score, round(confidence, 6) AS confidence, CASE WHEN confidence < 0.35e0 THEN 'Poor' WHEN confidence < 0.65e0 THEN 'ReviewRequired' WHEN confidence < 0.85e0 THEN 'Usable' ELSE 'Strong' END AS grade
FROM (SELECT *, round(0.65e0 * score + 0.35e0 * conf, 9) AS confidence FROM ({_SCORE}) s) c"""
both("quality_score", "Q1 A22", _GRADED)
_IMPORT = f"""
SELECT page, round(readiness, 9) AS readiness, CASE WHEN walls = 0 THEN 'Blocked' WHEN rooms = 0 OR openings = 0 OR NOT calibrated THEN 'ReviewRequired' WHEN readiness >= 0.85e0 THEN 'Strong' ELSE 'Usable' END AS grade
FROM (SELECT *, (0.30e0 + 0.20e0 * CASE WHEN calibrated THEN 1 ELSE 0.5e0 END + 0.25e0 * confidence + 0.15e0 * CASE WHEN rooms > 0 THEN 1 ELSE 0 END + 0.10e0 * CASE WHEN openings > 0 THEN 1 ELSE 0.5e0 END) * CASE WHEN walls = 0 THEN 0.5e0 WHEN rooms = 0 THEN 0.65e0 ELSE 1e0 END AS readiness FROM ({_GRADED}) g) q"""
both("import_readiness", "Q3 A22", _IMPORT)
both("visual_snapshot", "SNK8 MP2", "SELECT page, count(*) AS n, round(sum(e - s) / 490000, 9) AS density, count(CASE WHEN layer = 'A-WALL' THEN 1 END) AS walls, count(CASE WHEN layer = 'A-DIMS' THEN 1 END) AS dimensions FROM {lines} GROUP BY page")

# Benchmarks ------------------------------------------------------------------------------------
MATCH_RAW = f"""0.30e0 * (1 - least(1e0, abs(p.y1 - t.y1) / 8)) + 0.25e0 * (1 - least(1e0, ({dist("p.x1", "p.y1", "t.x1", "t.y1")} + {dist("p.x2", "p.y2", "t.x2", "t.y2")}) / 40)) + 0.15e0 * (1 - least(1e0, abs(atan2(p.y2 - p.y1, p.x2 - p.x1) - atan2(t.y2 - t.y1, t.x2 - t.x1)) / radians(8e0)))
  + 0.25e0 * greatest(0e0, least(p.x2, t.x2) - greatest(p.x1, t.x1)) / greatest(1e0, t.x2 - t.x1) + CASE WHEN p.wall_type = t.wall_type THEN 0.05e0 ELSE 0e0 END"""
MATCH_SCORE = f"round({MATCH_RAW}, 9)"
MATCH_MEETS = "abs(p.y1 - t.y1) <= 8 AND least(p.x2, t.x2) - greatest(p.x1, t.x1) >= 0.5e0 * (t.x2 - t.x1)"
#: Strokes of like height meet in bands of 8.
MATCH = f"""SELECT p.page, p.id AS p_id, t.id AS t_id, {MATCH_SCORE} AS score
FROM (SELECT *, CAST(floor(y1 / 8) AS BIGINT) + step AS band FROM {{predicted}} CROSS JOIN (VALUES (-1), (0), (1)) AS v(step)) p JOIN (SELECT *, CAST(floor(y1 / 8) AS BIGINT) AS band FROM {{truth}}) t
  ON p.page = t.page AND p.band = t.band AND {MATCH_MEETS}"""
both("target_match", "B2 GEO8", MATCH)
both("assertions", "B1 B8", """
SELECT item, name, actual, op, expected, CASE op WHEN 'min' THEN actual >= expected WHEN 'max' THEN actual <= expected ELSE actual = expected END AS passed FROM (
  SELECT lower(item) AS item, name, CASE name WHEN 'walls' THEN CAST(max(walls) AS DOUBLE) WHEN 'rooms' THEN CAST(max(rooms) AS DOUBLE) WHEN 'quality' THEN max(quality) ELSE max(duration_ms) END AS actual, op, expected
  FROM {runs} CROSS JOIN (VALUES ('walls', 'min', 6e0), ('rooms', 'min', 1e0), ('quality', 'min', 0.5e0), ('duration', 'max', 2500e0)) AS a(name, op, expected) WHERE run = 'candidate' GROUP BY lower(item), name, op, expected) x""")
both("scoreboard_grade", "B3 A13", """
SELECT item, round(score, 9) AS score, CASE WHEN score >= 0.95e0 THEN 'Excellent' WHEN score >= 0.85e0 THEN 'Strong' WHEN score >= 0.70e0 THEN 'Usable' WHEN score >= 0.50e0 THEN 'Weak' ELSE 'Failing' END AS grade FROM (
  SELECT lower(item) AS item, (0.22e0 * least(1e0, max(walls) / 40e0) + 0.18e0 * least(1e0, max(rooms) / 5e0) + 0.18e0 * max(quality) + 0.10e0 * (1 - least(1e0, min(duration_ms) / 20000))) / 0.68e0 AS score FROM {runs} WHERE run = 'candidate' GROUP BY lower(item)) s""")
#: How much each detector counts; another counts OTHER.
DETECTORS = {
    "regions": 0.08, "dimensions": 0.10, "grid_axes": 0.06, "walls": 0.22, "rooms": 0.18, "openings": 0.18, "object_aggregates": 0.08,
    "routing_barriers": 0.04, "routing_passages": 0.03, "routing_obstacles": 0.03, "routing_room_use_hints": 0.03, "routing_suppressed_objects": 0.04,
}
OTHER = 0.04
_WEIGHT = f"CASE detector {' '.join(f"WHEN '{k}' THEN {v}e0" for k, v in DETECTORS.items())} ELSE {OTHER}e0 END"
_DETECTED = f"SELECT page, count(*) AS detectors, sum(f1 * weight) / sum(weight) AS score FROM (SELECT page, {_WEIGHT} AS weight, CASE WHEN matched + missed + extra = 0 THEN 1e0 ELSE 2e0 * matched / (2 * matched + missed + extra) END AS f1 FROM {{detections}}) f GROUP BY page"
both("detector_scores", "B3 A13", f"SELECT page, detectors, round(score, 9) AS score FROM ({_DETECTED}) d")
#: What an issue of a stage takes off, and the most that its kind can.
ISSUES = {"error": (0.08, 0.20), "warning": (0.03, 0.08), "missing required": (0.03, 0.10), "missing optional": (0.01, 0.05), "empty required": (0.025, 0.16), "empty optional": (0.01, 0.06), "empty output": (0.008, 0.10)}
_HEALTH = f"""SELECT page, greatest(0e0, 1 - (CASE WHEN ready THEN 0e0 ELSE 0.35e0 END + CASE WHEN declared THEN 0e0 ELSE 0.30e0 END + loss)) AS health FROM (
  SELECT page, min(ready) AS ready, min(declared) AS declared, sum(CASE issue {' '.join(f"WHEN '{k}' THEN least({most}e0, {each}e0 * n)" for k, (each, most) in ISSUES.items())} ELSE 0e0 END) AS loss FROM (SELECT page, issue, sum(n) AS n, min(ready) AS ready, min(declared) AS declared FROM {{health}} GROUP BY page, issue) i GROUP BY page) h"""
both("pipeline_health", "B3 PP3", f"SELECT page, round(health, 9) AS health FROM ({_HEALTH}) h")
#: Whether the scale is known, what share of dimensions disagrees with it, and how far scales spread.
_MEASURED = """SELECT page, (CASE WHEN agree >= 4 AND inner_spread <= 1.05e0 THEN 1e0 ELSE 0.62e0 END) * greatest(0.25e0, 1 - outliers) / least(2e0, greatest(1e0, spread)) AS measured
  FROM (SELECT page, avg(CASE WHEN off > 0.12e0 THEN 1e0 ELSE 0e0 END) AS outliers, max(scale) / min(scale) AS spread, count(CASE WHEN off <= 0.12e0 THEN 1 END) AS agree, max(CASE WHEN off <= 0.12e0 THEN scale END) / min(CASE WHEN off <= 0.12e0 THEN scale END) AS inner_spread
    FROM (SELECT page, mm / (e - s) AS scale, abs(mm / (e - s) - 10) / 10 AS off FROM {dims}) m GROUP BY page) d"""
_READY = f"""SELECT q.page, q.quality, d.score AS detected, coalesce(m.measured, 0.465e0) AS measured, coalesce(h.health, 1e0) AS health, i.readiness FROM (SELECT page, (0.7e0 * confidence + 0.3e0 * CASE grade WHEN 'Strong' THEN 1e0 WHEN 'Usable' THEN 0.86e0 WHEN 'ReviewRequired' THEN 0.62e0 ELSE 0.35e0 END) * CASE WHEN grade = 'ReviewRequired' THEN 0.9e0 ELSE 1e0 END AS quality FROM ({_GRADED}) g) q
  LEFT JOIN ({_DETECTED}) d ON d.page = q.page LEFT JOIN ({_MEASURED}) m ON m.page = q.page LEFT JOIN ({_HEALTH}) h ON h.page = q.page JOIN ({_IMPORT}) i ON i.page = q.page"""
both("consumer_readiness", "B3", f"""
SELECT page, round(quality, 10) AS quality, round(measured, 10) AS measured, round(health, 10) AS health, ready, CASE WHEN ready >= 0.95e0 THEN 'Excellent' WHEN ready >= 0.85e0 THEN 'Strong' WHEN ready >= 0.70e0 THEN 'Usable' WHEN ready >= 0.50e0 THEN 'Weak' ELSE 'Failing' END AS grade
FROM (SELECT *, round(0.35e0 * quality + 0.22e0 * coalesce(detected, quality) + 0.14e0 * measured + 0.19e0 * readiness + 0.10e0 * health, 10) AS ready FROM ({_READY}) r) s""")
both("failure_buckets", "B4", """
SELECT bucket, count(*) AS n, min(item) AS example FROM (SELECT item, 'no rooms' AS bucket FROM {runs} WHERE rooms = 0 UNION ALL SELECT item, 'slow' AS bucket FROM {runs} WHERE duration_ms >= 2500 UNION ALL SELECT item, 'low quality' AS bucket FROM {runs} WHERE quality < 0.5e0) f GROUP BY bucket""")
both("batch_signals", "B5 B6", """
SELECT item, metric, baseline, candidate, CASE WHEN metric = 'quality' AND candidate - baseline <= -0.05e0 THEN 'Regression' WHEN metric = 'quality' AND candidate - baseline >= 0.05e0 THEN 'Improvement' WHEN metric = 'duration' AND candidate >= 1.5e0 * baseline AND candidate - baseline >= 250 THEN 'Regression'
  WHEN metric = 'walls' AND candidate = 0 AND baseline > 0 THEN 'Regression' WHEN metric = 'walls' AND abs(candidate - baseline) >= 5 AND abs(candidate - baseline) >= 0.25e0 * baseline THEN 'Drift' ELSE 'Info' END AS signal
FROM (SELECT lower(item) AS item, metric, max(CASE WHEN run = 'baseline' THEN CASE metric WHEN 'quality' THEN quality WHEN 'duration' THEN duration_ms ELSE CAST(walls AS DOUBLE) END END) AS baseline, max(CASE WHEN run = 'candidate' THEN CASE metric WHEN 'quality' THEN quality WHEN 'duration' THEN duration_ms ELSE CAST(walls AS DOUBLE) END END) AS candidate
  FROM {runs} CROSS JOIN (VALUES ('quality'), ('duration'), ('walls')) AS m(metric) GROUP BY lower(item), metric) x WHERE baseline IS NOT NULL AND candidate IS NOT NULL""")
both("compact_dictionary", "SNK2", "SELECT layer, code, n FROM (SELECT layer, dense_rank() OVER (ORDER BY layer) AS code, n FROM (SELECT layer, count(*) AS n FROM {lines} GROUP BY layer) c) d")

# Sources ---------------------------------------------------------------------------------------
both("source_kind", "SRC6 SRC7", r"""
SELECT page_id, CASE lower(regexp_extract(url, r'\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) WHEN 'pdf' THEN 'Pdf' WHEN 'dxf' THEN 'Dxf' WHEN 'dwg' THEN 'Dwg' WHEN 'png' THEN 'Raster' WHEN 'jpg' THEN 'Raster' WHEN 'html' THEN 'Document' ELSE 'Unknown' END AS kind FROM {pages}""")
both("source_capabilities", "SRC8", """
SELECT kind, CASE WHEN loader AND adapter THEN 'Ready' WHEN loader THEN 'ReviewRequired' WHEN adapter THEN 'NeedsConverter' ELSE 'Unsupported' END AS readiness FROM (VALUES ('Dxf', TRUE, TRUE), ('Json', TRUE, TRUE), ('Raster', TRUE, FALSE), ('Dwg', FALSE, TRUE), ('Pdf', FALSE, FALSE)) AS k(kind, loader, adapter)""")
