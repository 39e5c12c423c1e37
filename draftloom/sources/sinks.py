"""Results as GeoJSON, JSON, SVG, Markdown, DXF and schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.registry import query


def geojson(segs: DataFrame) -> DataFrame:
    """(id, feature): a LineString for each segment."""
    p = lambda x, y: F.array(F.col(x), F.col(y))
    geometry = F.struct(F.lit("LineString").alias("type"), F.array(p("x1", "y1"), p("x2", "y2")).alias("coordinates"))
    return segs.select(F.col("prim_id").alias("id"), F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct("layer", "page").alias("properties"))).alias("feature"))


@query("geojson_features", "SNK6 JS1", """
SELECT prim_id AS id, CAST(to_json({{'type': 'Feature', 'geometry': {{'type': 'LineString', 'coordinates': [[x1, y1], [x2, y2]]}}, 'properties': {{'layer': layer, 'page': page}}}}) AS VARCHAR) AS feature FROM {segs}""")
def geojson_features(load):
    """A GeoJSON feature for each stroke."""
    return geojson(load("segs"))


@query("arc_samples", "SNK6 GEO16", """
SELECT id, k, round(cx + r * cos(start_at + sweep * k / 8), 4) AS x, round(cy + r * sin(start_at + sweep * k / 8), 4) AS y FROM {arcs} CROSS JOIN (SELECT CAST(unnest(range(0, 9)) AS INT) AS k) s""")
def arc_samples(load):
    """Nine points along each arc."""
    a = load("arcs").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8))))
    at = F.col("start_at") + F.col("sweep") * F.col("k") / 8
    return a.select("id", "k", F.round(F.col("cx") + F.col("r") * F.cos(at), 4).alias("x"), F.round(F.col("cy") + F.col("r") * F.sin(at), 4).alias("y"))


@query("svg_overlay", "SNK7", """
SELECT page, concat('<svg>', string_agg(concat('<line x1="', x1, '" y1="', y1, '" x2="', x2, '" y2="', y2, '"/>'), '' ORDER BY concat('<line x1="', x1, '" y1="', y1, '" x2="', x2, '" y2="', y2, '"/>')), '</svg>') AS svg FROM {segs} WHERE layer = 'A-WALL' GROUP BY page""")
def svg_overlay(load):
    """An SVG of each page's wall strokes."""
    line = F.concat(F.lit('<line x1="'), F.col("x1").cast("string"), F.lit('" y1="'), F.col("y1").cast("string"), F.lit('" x2="'), F.col("x2").cast("string"), F.lit('" y2="'), F.col("y2").cast("string"), F.lit('"/>'))
    return load("segs").where("layer = 'A-WALL'").groupBy("page").agg(F.concat(F.lit("<svg>"), F.array_join(F.sort_array(F.collect_list(line)), ""), F.lit("</svg>")).alias("svg"))


@query("scan_json", "SNK1 JS1", """
SELECT page, count(*) AS strokes, CAST(sum(e - s) AS DOUBLE) AS total FROM {lines} GROUP BY page""")
def scan_json(load):
    """Each page's result as one JSON text, read back by its schema."""
    facts = load("lines").groupBy("page").agg(F.count(F.lit(1)).alias("strokes"), F.sum(F.col("e") - F.col("s")).alias("total"))
    text = facts.select(F.to_json(F.struct("page", "strokes", "total")).alias("json"))
    return text.select(F.from_json("json", "page bigint, strokes bigint, total double").alias("r")).select("r.*")


@query("dxf_roundtrip", "SRC2 SRC3 SRC11", "SELECT CAST(page AS VARCHAR) AS doc, layer, x1, y1, x2, y2 FROM {segs}")
def dxf_roundtrip(load):
    """Strokes written as DXF texts, a file a page, and parsed back."""
    from . import dxf

    return dxf.parse(dxf.write_lines(load("segs"))).select("doc", "layer", "x1", "y1", "x2", "y2")


#: Codes are dealt by hash, so that no task need number all strings.
BUCKETS = 64


def compact(table: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(dictionary of code and value, table with codes for the strings of columns); a null stays null."""
    from pyspark.sql import Window

    of = F.pmod(F.xxhash64("value"), F.lit(BUCKETS))
    values = table.select(F.explode(F.array(*(F.col(c) for c in columns))).alias("value")).where("value is not null").distinct().withColumn("bucket", of)
    book = values.select((F.row_number().over(Window.partitionBy("bucket").orderBy("value")) * BUCKETS + F.col("bucket")).alias("code"), "value")
    coded = table
    for c in columns:
        coded = coded.join(book.select(F.col("code").alias("__code"), F.col("value").alias("__value")), F.col(c) == F.col("__value"), "left").withColumn(c, F.col("__code")).drop("__code", "__value")
    return book, coded


def expand(book: DataFrame, coded: DataFrame, columns: list[str]) -> DataFrame:
    """What compact was given."""
    for c in columns:
        coded = coded.join(book.select(F.col("code").alias("__code"), F.col("value").alias("__value")), F.col(c) == F.col("__code"), "left").withColumn(c, F.col("__value")).drop("__code", "__value")
    return coded


@query("compact_roundtrip", "SNK2", "SELECT prim_id, orient, layer, s, e FROM {lines}")
def compact_roundtrip(load):
    """Strokes with codes for their strings, expanded again."""
    return expand(*compact(load("lines").select("prim_id", "orient", "layer", "s", "e"), ["orient", "layer"]), ["orient", "layer"])


def write_placement(tables: dict[str, DataFrame], path: str) -> None:
    """Tables of a placement or structure export, a Parquet folder each."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def schema_of(table: DataFrame) -> str:
    """The JSON schema of a table."""
    return table.schema.json()


def markdown(report: DataFrame, title: str, most: int = 200) -> str:
    """A report of few rows as a Markdown table; most: the rows it shows."""
    rows = report.limit(most).collect()
    lines = [f"# {title}", "", "| " + " | ".join(report.columns) + " |", "|" + " --- |" * len(report.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"
