"""Sharding by histogram sort: shards of near equal bytes, in key order, with one exchange.

Keys are (hash of the text, doc_id, number of the row), so equal texts lie next to each other and no
two keys are equal; where a boundary falls in a group of copies, it moves to the group's nearer end
if that is within TOLERANCE, else the group is cut. Boundaries are sought for
equal shares of the bytes. Each round, every partition counts the rows and bytes below all probes,
the sums narrow the interval that holds each boundary, and keys drawn from the intervals (PROBES
each in expectation, all keys of a small one) are the next probes. Rounds end when every boundary is
within TOLERANCE of its share of bytes, or lies between neighbouring keys. Counts are exact, so the
rows before each part are known, and slots need no further pass: the rows move once, to their part.

A shard is several parts where it has more than ROWS rows, so no task holds a whole shard.

Cases: a null text has no bytes (size 16), a null doc_id sorts first; repeated rows have keys of
their own by row number; fewer rows than shards leave shards empty; an empty table gives an empty
result. Other columns are carried only if asked for.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARDS, TOLERANCE, PROBES, ROWS = 40, 0.002, 48, 2_000_000
FIRST = 2048
_KEY = ("__h", "__i", "__r")


def keys_of(batch) -> np.ndarray:
    """Keys as 24 bytes each, in big-endian order."""
    cols = [batch.column(c).to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for c in _KEY]
    return np.ascontiguousarray(np.stack(cols, 1).astype(">u8")).view("S24").ravel()


def keyed(docs: DataFrame) -> DataFrame:
    """docs with their keys."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"__h": F.xxhash64(text), "__i": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "__r": F.monotonically_increasing_id()})


def counted(rows: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows in each interval between probes (len + 1 of each)."""
    shared = rows.sparkSession.sparkContext.broadcast(probes)

    def run(batches):
        import pyarrow as pa

        probes = shared.value
        total, n = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(probes, keys_of(batch), "right")
            np.add.at(total, at, batch.column("size").to_numpy())
            n += np.bincount(at, minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.record_batch({"at": pa.array(some, pa.int64()), "b": pa.array(total[some]), "n": pa.array(n[some])})

    got = rows.select(*_KEY, "size").mapInArrow(run, "at long, b long, n long").groupBy("at").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).collect()  # a row for each probe
    shared.unpersist()
    total, n = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in got:
        total[r["at"]], n[r["at"]] = r["b"], r["n"]
    return total, n


def drawn(rows: DataFrame, low: np.ndarray, high: np.ndarray, share: np.ndarray, turn: int) -> np.ndarray:
    """Keys in intervals [low, high), each with the chance of its interval."""
    shared = rows.sparkSession.sparkContext.broadcast((low, high, share))

    def run(batches):
        import pyarrow as pa

        low, high, share = shared.value
        for batch in batches:
            k = keys_of(batch)
            i = np.searchsorted(low, k, "right") - 1
            inside = (i >= 0) & (k < high[i.clip(0)])
            luck = (batch.column("__luck").to_numpy().astype(np.int64) & 0xFFFFF) / float(1 << 20)
            keep = k[inside & (luck < share[i.clip(0)])]
            if len(keep):
                yield pa.record_batch({"k": pa.array([keep.tobytes()], pa.binary())})

    luck = F.xxhash64(*_KEY, F.lit(turn)).alias("__luck")
    got = rows.select(*_KEY, luck).mapInArrow(run, "k binary").collect()  # PROBES keys for each boundary in expectation, a row a batch
    shared.unpersist()
    return np.unique(np.concatenate([np.zeros(0, "S24"), *(np.frombuffer(r["k"], "S24") for r in got)]))


def splitters(rows: DataFrame, parts: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """parts - 1 boundaries of rows (keys, size) and the rows below each."""
    step = (1 << 64) // FIRST
    probes = np.array([(i * step).to_bytes(8, "big").ljust(24, b"\0") for i in range(1, FIRST)], "S24")
    total, n = counted(rows, probes)
    share = int(total.sum()) / parts
    goal = np.arange(1, parts) * share
    below_b, below_n = np.cumsum(total)[:-1], np.cumsum(n)[:-1]
    inside = n
    for turn in range(64):
        # For each goal the nearest probes on either side.
        i = np.searchsorted(below_b, goal, "left")  # first probe with at least so many bytes below it
        left, right = (i - 1), i.clip(max=len(probes) - 1)
        miss_l = np.where(left >= 0, np.abs(below_b[left.clip(0)] - goal), goal)
        miss_r = np.where(i < len(probes), np.abs(below_b[right] - goal), np.inf)
        todo = (np.minimum(miss_l, miss_r) > tolerance * share) & (inside[i] > 1)
        if not todo.any():
            break
        spots = np.unique(i[todo])
        low = np.array([probes[j - 1] if j else b"" for j in spots.tolist()], "S24")
        high = np.array([probes[j] if j < len(probes) else b"\xff" * 24 for j in spots.tolist()], "S24")
        new = drawn(rows, low, high, np.minimum(1.0, PROBES / inside[spots]), turn)
        keep = np.unique(np.concatenate([np.arange(len(probes))[np.unique(np.concatenate([left[left >= 0], right]))]]))
        probes = np.unique(np.concatenate([probes[keep], new]))
        total, n = counted(rows, probes)
        below_b, below_n, inside = np.cumsum(total)[:-1], np.cumsum(n)[:-1], n
    i = np.searchsorted(below_b, goal, "left").clip(max=len(probes) - 1)
    left = (i - 1).clip(0)
    best = np.where(np.abs(below_b[left] - goal) <= np.abs(below_b[i] - goal), left, i)
    # Where copies are cut, the ends of their group are counted too.
    heads = [int.from_bytes(k.ljust(24, b"\0")[:8], "big") for k in probes[best].tolist()]
    ends = np.array([[min(h + i, (1 << 64) - 1).to_bytes(8, "big").ljust(24, b"\0") for h in heads] for i in (0, 1)], "S24")
    every = np.unique(np.concatenate([probes[best], *ends]))
    total, n = counted(rows, every)
    below_b, below_n = np.cumsum(total)[:-1], np.cumsum(n)[:-1]
    choices = np.searchsorted(every, np.stack([*ends, probes[best]]))
    miss = np.abs(below_b[choices] - goal)
    at = np.where(miss[:2].min(0) <= tolerance * share, choices[miss[:2].argmin(0), np.arange(len(goal))], choices[2])
    return every[at], below_n[at]


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """docs (doc_id, text, ... with keys and size) with shard and slot: the rows move once."""
    spark = docs.sparkSession
    narrow = stored(docs.select(*_KEY, "size"), "keys")
    n = narrow.count()
    many = max(1, -(-n // (shards * ROWS)))
    bounds, below = splitters(narrow, shards * many, tolerance) if n else (np.zeros(0, "S24"), np.zeros(0, np.int64))
    before = np.concatenate([[0], below])
    shared = spark.sparkContext.broadcast((bounds, before - np.repeat(before[::many], many)[: len(before)] if n else before))
    from pyspark.sql import types as T

    def run(batches):
        import pyarrow as pa

        bounds, first = shared.value
        for batch in batches:
            part = np.searchsorted(bounds, keys_of(batch), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32)), pa.array(first[part].astype(np.int64))], names=[*batch.schema.names, "__part", "__first"])

    placed = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__first", T.LongType())]))
    slot = F.row_number().over(Window.partitionBy("__part").orderBy(*_KEY)) - 1 + F.col("__first")
    return placed.withColumn("slot", slot.cast("long")).withColumn("shard", F.floor(F.col("__part") / many).cast("int")).drop("__part", "__first", *_KEY)


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, by the law of bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = keyed(docs).withColumns({"size": F.octet_length(text).cast("long") + 16, "text_crc32": F.crc32(text)}).drop("text")
    # Narrow rows: written once, so that every round reads keys and not texts.
    return shard(stored(rows, "rows")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Whole documents, written to a folder for each shard, in slot order."""
    sized = keyed(docs).withColumn("size", F.octet_length(F.coalesce("text", F.lit("")).cast("binary")).cast("long") + 16)
    # Stored, so that the numbers of the rows are the same in both readings.
    shard(stored(sized, "sized"), shards).drop("size").write.partitionBy("shard").parquet(path)
