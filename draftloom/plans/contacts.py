"""What stands beside and across each stroke, counted side by side before it is joined: by bands, not by pages."""

from __future__ import annotations

_STEPS = "CROSS JOIN (VALUES (-1), (0), (1)) AS v(step)"


def known(fits: str) -> str:
    """(prim_id, page, len, faces, contacts): parallel strokes p 2 to 24 beside a stroke w that fit, and strokes across its ends."""
    return f"""SELECT w.prim_id, w.page, w.e - w.s AS len, coalesce(max(f.n), 0) AS faces, coalesce(max(c.n), 0) AS contacts FROM {{walls}} w
  LEFT JOIN (SELECT w.prim_id, count(DISTINCT p.prim_id) AS n FROM (SELECT *, CAST(floor(coord / 24) AS BIGINT) + step AS band FROM {{walls}} {_STEPS}) w JOIN (SELECT *, CAST(floor(coord / 24) AS BIGINT) AS band FROM {{walls}}) p
    ON p.page = w.page AND p.orient = w.orient AND p.band = w.band AND abs(p.coord - w.coord) BETWEEN 2 AND 24 AND {fits} GROUP BY w.prim_id) f ON f.prim_id = w.prim_id
  LEFT JOIN (SELECT w.prim_id, count(DISTINCT x.prim_id) AS n FROM (SELECT *, CAST(floor(end_at / 6) AS BIGINT) + step AS band FROM (SELECT *, s AS end_at FROM {{walls}} UNION ALL SELECT *, e AS end_at FROM {{walls}}) q {_STEPS}) w
    JOIN (SELECT *, CAST(floor(coord / 6) AS BIGINT) AS band, CASE orient WHEN 'H' THEN 'V' ELSE 'H' END AS other FROM {{walls}}) x ON x.page = w.page AND x.other = w.orient AND x.band = w.band AND abs(x.coord - w.end_at) <= 3 AND w.coord BETWEEN x.s - 3 AND x.e + 3 GROUP BY w.prim_id) c ON c.prim_id = w.prim_id
  GROUP BY w.prim_id, w.page, w.e - w.s"""
