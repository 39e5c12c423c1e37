"""DXF text files as rows of primitives, and rows as DXF text.

A file is read whole by Spark's own reader, so any store that Spark reads will do, and parsed in one
pass over its pairs of code and value. Blocks are expanded where they are inserted, also in rows and
columns, to any depth and without following a block into itself; what lies on layer 0 of a block takes
the insert's layer. An insert's visible attributes become texts with their tag. An arc in a mirrored
insert turns with it; in one scaled unequally it becomes a polyline of STEPS points a turn. With flip,
coordinates go to page space (y downward from the drawing's upper edge).

Cases: an entity of another type is left out; a broken pair ends its file's rows with an `error` row;
an empty file gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc string, idx int, kind string, layer string, x1 double, y1 double, x2 double, y2 double, points array<struct<x:double,y:double>>, closed boolean, text string, radius double, start_angle double, sweep double, block string, tag string"
_FIELDS = ("kind", "layer", "x1", "y1", "x2", "y2", "points", "closed", "text", "radius", "start_angle", "sweep", "block", "tag")
#: Points of a whole turn of an arc that is no longer round.
STEPS = 64


def pairs(text: str) -> Iterator[tuple[int, str]]:
    lines = text.splitlines()
    for i in range(0, len(lines) - 1, 2):
        yield int(lines[i].strip()), lines[i + 1].strip()


def entities(text: str) -> tuple[list[list[tuple[int, str]]], dict[str, list[list[tuple[int, str]]]], dict[str, list[float]]]:
    """Entities of the drawing, those of each block, as lists of pairs that start with the type, and the blocks' base points."""
    section, block, out, blocks, bases, at = "", None, [], {}, {}, [0.0, 0.0]
    now: list[tuple[int, str]] | None = None
    for code, value in pairs(text):
        if code == 0:
            now = None
            if value in ("SECTION", "ENDSEC", "EOF"):
                section = "" if value != "SECTION" else "?"
            elif value == "BLOCK" and section == "BLOCKS":
                block, at = "", [0.0, 0.0]
            elif value == "ENDBLK":
                block = None
            elif section in ("ENTITIES", "BLOCKS") and (section == "ENTITIES" or block):
                now = [(0, value)]
                (out if section == "ENTITIES" else blocks.setdefault(block, [])).append(now)
        elif now is not None:
            now.append((code, value))
        elif section == "?" and code == 2:
            section = value
        elif block == "" and code == 2:
            block = value
            blocks.setdefault(value, [])
            bases[value] = at
        elif block is not None and code in (10, 20):
            at[code // 20] = float(value)
    return out, blocks, bases


def _numbers(e: list[tuple[int, str]], code: int) -> list[float]:
    return [float(v) for c, v in e if c == code]


def _one(e, code: int, default: float = 0.0) -> float:
    found = _numbers(e, code)
    return found[0] if found else default


def _said(e, code: int) -> str | None:
    return next((v for c, v in e if c == code), None)


def _arc(e, move) -> dict:
    """Where move puts an arc or circle: round under a similarity, else points along it."""
    x, y, r = _one(e, 10), _one(e, 20), _one(e, 40)
    start, sweep = (math.radians(_one(e, 50)), math.radians((_one(e, 51) - _one(e, 50)) % 360)) if e[0][1] == "ARC" else (0.0, 2 * math.pi)
    (cx, cy), (ux, uy), (vx, vy) = move(x, y), move(x + 1, y), move(x, y + 1)
    ux, uy, vx, vy = ux - cx, uy - cy, vx - cx, vy - cy
    across, along = math.hypot(ux, uy), math.hypot(vx, vy)
    if math.isclose(across, along, rel_tol=1e-9) and abs(ux * vx + uy * vy) <= 1e-9 * across * along:
        turned = math.atan2(uy, ux)
        return {"kind": "Arc", "x1": cx, "y1": cy, "radius": r * across, "start_angle": turned + start if ux * vy >= uy * vx else turned - start - sweep, "sweep": sweep}
    n = max(2, math.ceil(STEPS * sweep / (2 * math.pi)))
    at = [move(x + r * math.cos(start + sweep * k / n), y + r * math.sin(start + sweep * k / n)) for k in range(n + (e[0][1] == "ARC"))]
    return {"kind": "Polyline", "points": [{"x": a, "y": b} for a, b in at], "closed": e[0][1] != "ARC"}


def flipped(rows: list[dict]) -> list[dict]:
    """rows with y downward from the greatest y of any."""
    top = max([y for r in rows for y in (r["y1"], r["y2"], *(p["y"] for p in r["points"] or ())) if y is not None], default=0.0)
    for r in rows:
        r.update({k: top - r[k] for k in ("y1", "y2") if r[k] is not None})
        r["points"] = r["points"] and [{"x": p["x"], "y": top - p["y"]} for p in r["points"]]
        if r["sweep"] is not None:
            r["start_angle"] = -r["start_angle"] - r["sweep"]
    return rows


def primitives(text: str, flip: bool = False) -> list[dict]:
    """The primitives of a drawing, blocks expanded."""
    out: list[dict] = []
    tops, blocks, bases = entities(text)

    def place(e_list, move, layer: str | None, seen: tuple[str, ...]) -> None:
        vertices: dict | None = None
        inserted = ""
        for e in e_list:
            kind = e[0][1]
            own = _said(e, 8)
            row = dict.fromkeys(_FIELDS) | {"layer": layer if layer and own in (None, "0") else own, "block": seen[-1] if seen else None}
            if kind == "LINE":
                (row["x1"], row["y1"]), (row["x2"], row["y2"]) = move(_one(e, 10), _one(e, 20)), move(_one(e, 11), _one(e, 21))
                out.append(row | {"kind": "Line"})
            elif kind == "LWPOLYLINE":
                at = [move(x, y) for x, y in zip(_numbers(e, 10), _numbers(e, 20), strict=False)]
                out.append(row | {"kind": "Polyline", "points": [{"x": x, "y": y} for x, y in at], "closed": bool(int(_one(e, 70)) & 1)})
            elif kind == "POLYLINE":
                vertices = row | {"kind": "Polyline", "points": [], "closed": bool(int(_one(e, 70)) & 1)}
                out.append(vertices)
            elif kind == "VERTEX" and vertices is not None:
                x, y = move(_one(e, 10), _one(e, 20))
                vertices["points"].append({"x": x, "y": y})
            elif kind in ("TEXT", "MTEXT"):
                row["x1"], row["y1"] = move(_one(e, 10), _one(e, 20))
                out.append(row | {"kind": "Text", "text": "".join(v for c, v in e if c in (3, 1)).replace("\\P", "\n")})
            elif kind in ("ARC", "CIRCLE"):
                out.append(row | _arc(e, move))
            elif kind == "ATTRIB" and not int(_one(e, 70)) & 1 and not int(_one(e, 60)) and (_said(e, 1) or "").strip():
                row["x1"], row["y1"] = move(_one(e, 10), _one(e, 20))
                out.append(row | {"kind": "Text", "text": _said(e, 1), "tag": _said(e, 2), "block": inserted})
            elif kind == "DIMENSION":
                (row["x1"], row["y1"]), (row["x2"], row["y2"]) = move(_one(e, 13), _one(e, 23)), move(_one(e, 14), _one(e, 24))
                out.append(row | {"kind": "Dimension", "text": _said(e, 1)})
            elif kind == "INSERT":
                name = inserted = _said(e, 2) or ""
                row["x1"], row["y1"] = move(_one(e, 10), _one(e, 20))
                out.append(row | {"kind": "Symbol", "text": name})
                if name in blocks and name not in seen:
                    dx, dy, sx, sy, a = _one(e, 10), _one(e, 20), _one(e, 41, 1.0), _one(e, 42, 1.0), math.radians(_one(e, 50))

                    base, across, up = bases[name], _one(e, 44), _one(e, 45)
                    for i in range(max(1, int(_one(e, 71, 1.0)))):
                        for j in range(max(1, int(_one(e, 70, 1.0)))):

                            def inner(x, y, move=move, dx=dx, dy=dy, sx=sx, sy=sy, a=a, ox=j * across, oy=i * up, base=base):
                                x, y = (x - base[0]) * sx + ox, (y - base[1]) * sy + oy
                                return move(dx + x * math.cos(a) - y * math.sin(a), dy + x * math.sin(a) + y * math.cos(a))

                            place(blocks[name], inner, row["layer"], (*seen, name))

    place(tops, lambda x, y: (x, y), None, ())
    return flipped(out) if flip else out


def parse(files: DataFrame, flip: bool = False) -> DataFrame:
    """Primitives of files (doc, text), one row each, numbered in the order of the file."""

    def run(batches):
        import pyarrow as pa

        point = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        kinds = {"doc": pa.string(), "idx": pa.int32(), "points": point, "closed": pa.bool_()} | dict.fromkeys(("kind", "layer", "text", "block", "tag"), pa.string())
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                try:
                    rows = primitives(text or "", flip)
                except ValueError as bad:
                    rows = [dict.fromkeys(_FIELDS) | {"kind": "error", "text": str(bad)}]
                for s in range(0, len(rows), 10_000):
                    part = rows[s : s + 10_000]
                    cols = {"doc": [doc] * len(part), "idx": list(range(s, s + len(part)))} | {f: [r[f] for r in part] for f in _FIELDS}
                    yield pa.record_batch({n: pa.array(v, kinds.get(n, pa.float64())) for n, v in cols.items()})

    return files.select("doc", "text").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str, flip: bool = False) -> DataFrame:
    """Primitives of every DXF file under path, in any folder below it."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.dxf").text(path, wholetext=True)
    return parse(files.select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text")), flip)


def write_lines(segs: DataFrame, by: str = "page") -> DataFrame:
    """(doc, text): a DXF text of the segments (layer, x1, y1, x2, y2) of each page."""
    say = lambda c: F.col(c).cast("string")
    one = F.concat(F.lit("0\nLINE\n8\n"), F.col("layer"), F.lit("\n10\n"), say("x1"), F.lit("\n20\n"), say("y1"), F.lit("\n11\n"), say("x2"), F.lit("\n21\n"), say("y2"), F.lit("\n"))
    body = F.array_join(F.sort_array(F.collect_list(one)), "")
    return segs.groupBy(F.col(by).cast("string").alias("doc")).agg(F.concat(F.lit("0\nSECTION\n2\nENTITIES\n"), body, F.lit("0\nENDSEC\n0\nEOF\n")).alias("text"))
