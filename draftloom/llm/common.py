"""What the operators of this subpackage share: written tables, byte-level words, components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Most buckets of a table that Spark allows.
BUCKETS = 100_000
#: Edges of a graph that the driver takes at most.
FEW = 200_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a local one only where all run in one process (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or "file:///tmp/checkpoints").rstrip("/") + "/" + spark.sparkContext.applicationId


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: lineage is cut, lost executors lose nothing.

    The files go when the driver's JVM ends, or earlier by release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = where
    return out


def hashed(x: np.ndarray) -> np.ndarray:
    """Spark's hash of integers (Murmur3, 32 bits, seed 42), as buckets are found by it."""
    with np.errstate(over="ignore"):
        turn = lambda v, n: (v << np.uint32(n)) | (v >> np.uint32(32 - n))
        k = turn(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return (h ^ (h >> np.uint32(16))).view(np.int32)


def dealt(parts: int, ways: int) -> np.ndarray:
    """A different number for each of parts, such that the hash deals them to the buckets in turn."""
    many = 4 * parts + 32 * ways
    while True:
        bucket = np.mod(hashed(np.arange(many, dtype=np.uint32)), ways)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(ways))
        size = np.diff(np.append(first, many))
        p = np.arange(parts)
        if (size[p % ways] > p // ways).all():
            return order[first[p % ways] + p // ways].astype(np.int32)
        many *= 2


def bucketed(df: DataFrame, name: str) -> DataFrame:
    """df with its partitions' numbers as src, written to the shared folder in buckets of src and read back.

    Grouping by src then needs no exchange. Nothing is exchanged to write it either: a partition is a
    file, and as far as may be (BUCKETS) a bucket of its own: src is a number that Spark's hash sends
    there. The table is listed in the session's catalog until forget(), or the driver's end.
    """
    spark = df.sparkSession
    table, path = f"{name}_{uuid.uuid4().hex}", f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    parts = max(1, df.rdd.getNumPartitions())
    ways = min(parts, BUCKETS)
    src = F.coalesce(F.get(F.lit(dealt(parts, ways)), F.spark_partition_id()), -1 - F.spark_partition_id())
    df.withColumn("src", src).write.bucketBy(ways, "src").sortBy("src").option("path", path).saveAsTable(table)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.table(table)
    out._stored_at, out._table = where, table
    return out


def forget(df: DataFrame) -> None:
    """Takes a bucketed() table off the catalog, and its files, which no later plan reads."""
    df.sparkSession.sql(f"drop table if exists {df._table}")
    release(df)


def hand_back() -> None:
    """Gives the memory that a worker has freed back to the system: workers live on between tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run):
    """run over a task's batches; when they end, the worker hands freed memory back."""

    def work(batches):
        try:
            yield from run(batches)
        finally:
            hand_back()

    return work


def release(df: DataFrame | None) -> None:
    """Deletes the files of a stored() table that no later plan reads."""
    where = getattr(df, "_stored_at", None)
    if where is not None:
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def held_out() -> Column:
    """crc32 of doc_id as text is divisible by 5; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string column; nulls are empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, off


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 64), _BASE, np.uint64)]), dtype=np.uint64)
    return _powers


def word_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words in the bytes of one text, in order."""
    full = ~SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], full, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    off = np.cumsum(size) - size
    at = np.arange(off[-1] + size[-1]) - np.repeat(off, size)
    h = np.add.reduceat((b[full].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[at], off)
    return mix(h + size.astype(np.uint64) * _M2)


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all runs of k words; a text of fewer words is one shingle, an empty one none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = (h ^ words[i : n - k + 1 + i]) * _M1 + np.uint64(i + 1)
        h ^= h >> np.uint64(29)
    return mix(h + np.uint64(k))


def solved(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), FEW of them at most: root is the least node of its component."""
    import pyarrow as pa
    import pyarrow.compute as pc

    table = edges.select("a", "b").toArrow()
    both = pa.concat_arrays([x for c in ("a", "b") for x in [pa.array([], table.schema.field(c).type), *table.column(c).chunks]]).dictionary_encode()
    order = pc.sort_indices(both.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ends = place[both.indices.to_numpy()]
    root = list(range(len(order)))
    for x, y in zip(ends[: len(table)].tolist(), ends[len(table) :].tolist(), strict=True):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        root[max(x, y)] = min(x, y)
    for i, x in enumerate(root):
        root[i] = root[x]  # the lesser ones are settled
    nodes = both.dictionary.take(pa.array(order))
    found = edges.sparkSession.createDataFrame(pa.table({"node": nodes, "root": nodes.take(pa.array(root, pa.int64()))}))
    return stored(found, "solved")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is one node of its component.

    Each round every node follows its neighbour of least hash twice, and edges are carried over to
    where their ends went; hashed order keeps paths short, so rounds are few. Once at most FEW edges
    are left, the driver solves them: the many small tables of rounds cost more than they hold.
    Joins have both sides read from files: Spark may split hot keys. edges are read twice.
    """

    def order(x: str) -> Column:
        return F.struct(F.xxhash64(x).alias("h"), F.col(x).alias("n"))

    def onward(label: DataFrame, to: DataFrame) -> DataFrame:
        """label (node, root), with roots that are nodes of to replaced by those in to."""
        out = stored(label.join(to.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")), "label")
        release(label)
        release(to)
        return out

    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    if edges.count() <= FEW:
        return solved(edges)
    left, label = stored(edges.distinct(), "edges"), None
    while (n := left.count()) > FEW:
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", order("a"))["n"].alias("up")), "up")
        far = up.select(F.col("node").alias("up"), F.col("up").alias("root"))
        to = stored(up.join(far, "up").select("node", "root"), "to")
        ends = left.join(to.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").select("b", "ra")
        ends = stored(ends, "ends")
        moved = ends.join(to.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
        after = stored(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        label = to if label is None else onward(label, to)
        for x in (left, up, ends):
            release(x)
        left = after
    if n:
        label = solved(left) if label is None else onward(label, solved(left))
    release(left)
    return label
