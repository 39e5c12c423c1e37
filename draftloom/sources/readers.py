"""JSON manifests and profiles, recognised lines and texts, and choice of a reader by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas of the documents that can be read.
MANIFEST = "fixtures array<struct<id:string, sourcePath:string, optional:boolean, properties:map<string,string>, expectations:string>>"
LAYER_PROFILE = "overrides array<struct<pattern:string, category:string, sourceFormat:string>>"
LABEL_PROFILE = "rules array<struct<signature:string, detectedTagPattern:string, symbolNamePattern:string, layerPattern:string, matchCategory:string, category:string, label:string, requiresReview:boolean, confidence:double>>"
CORRECTIONS = "actions array<struct<targetKind:string, decision:string, applyScope:string, signature:string, originalCategory:string, correctedCategory:string, detectedTags:array<string>>>"
WALL_TRUTH = "pages array<struct<number:int, width:double, height:double>>, entries array<struct<id:string, page:int, label:string, x1:double, y1:double, x2:double, y2:double, wallType:string, importance:string>>"
BATCH = "inputs array<string>, maxDegreeOfParallelism int, retryCount int"
SCHEMAS = {"manifest": MANIFEST, "layer-profile": LAYER_PROFILE, "label-profile": LABEL_PROFILE, "corrections": CORRECTIONS, "wall-truth": WALL_TRUTH, "batch": BATCH}


def read_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A row for each element of the documents' list; documents that don't fit the schema are rows with `bad` set."""
    schema = SCHEMAS[kind]
    whole = spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").schema(f"{schema}, bad string").json(path)
    first = whole.columns[1 if kind == "wall-truth" else 0]
    rows = whole.select("bad", F.explode_outer(first).alias("item"))
    return rows.select("bad", "item.*") if first != "inputs" else rows


def raster_primitives(lines: DataFrame, texts: DataFrame, least: float = 0.0) -> DataFrame:
    """Recognised lines (page, x1, y1, x2, y2, confidence) and texts (page, x, y, text, confidence) as primitives."""
    a = lines.select("page", F.lit("Line").alias("kind"), "x1", "y1", "x2", "y2", F.lit(None).cast("string").alias("text"), "confidence")
    b = texts.select("page", F.lit("Text").alias("kind"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lit(None).cast("double").alias("x2"), F.lit(None).cast("double").alias("y2"), "text", "confidence")
    return a.unionByName(b).where(F.col("confidence") >= least)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Primitives by the first reader that knows the path's ending; an error that names what is missing else."""
    from . import dxf

    end = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if end in ("dxf", ""):
        return dxf.read(spark, path)
    if end in ("parquet", "orc", "json"):
        return getattr(spark.read, end)(path)
    raise NotImplementedError(f"{path}: .{end} needs a converter or library that isn't here (dwg: a converter to dxf; pdf: a parser)")
