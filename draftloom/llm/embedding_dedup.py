"""Near duplicates among embeddings by randomised-rotation binary codes.

A vector is turned by CODES random rotations; its codes are the signs of its coordinates, and beside
each is stored the correction factor f, the cosine between the turned vector and its code. For a
vector q, <q, code> / f is an unbiased estimate of the cosine; the mean over the rotations is off by
more than EPSILON sqrt(mean(1 / f^2 - 1)) / sqrt(CODES (d - 1)) only with negligible chance. A pair
whose estimate plus that bound is below the threshold is dropped; every other pair is recomputed in
double precision. On its query side a vector is known by coordinates rounded at random to 8 bits.

Codes, factors and rounded coordinates are stored packed, once. They alone travel to the buckets,
where the estimates are made; vectors follow only to places where they have a pair left open. The
product with a code of signs is done by the linear algebra library, which beats counting bits here.

Pairs to estimate share a bucket in one of several tables: a few signs under further rotations. The
number of signs follows the number of vectors, the number of tables follows from it, such that a pair
at the threshold meets with a chance of RECALL (pairs above it more often). Buckets of more than
BLOCK vectors are compared in pairs of blocks. A block reports sums of links by vector and a star for
each component in it, never the pairs; a pair that meets in several tables counts in the first.

Equal vectors are one node with a number of copies.

Cases: a vector that is null, empty, zero, or holds a null or non-finite component links with nothing
(also not with its copies) and is kept with component_id vec_id; vectors of different lengths don't
link; a null vec_id takes part by its vector and has the least id of its component that is not null;
of repeated ids each row counts. Labels and other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mix, stored

THRESHOLD, RECALL, EPSILON = 0.9, 1 - 1e-5, 4.5
#: Rotations whose signs and factors make the estimates.
CODES = 3
#: Vectors to a bucket on average, and to a block.
BUCKET, BLOCK = 1024, 1024


def rotation(dim: int, turn: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([dim, turn, 11]).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def shape(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Signs to a table and tables for n vectors."""
    bits = max(2, round(math.log2(max(4, n / BUCKET))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - meet))


def code(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (as -1 and 1) and correction factors of turned unit vectors."""
    signs = np.where(x >= 0, np.float32(1), np.float32(-1))
    return signs, (x * signs).sum(1) / np.float32(math.sqrt(x.shape[1]))


def estimates(q: np.ndarray, signs: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of unit vectors q with those coded by signs (n, rotations, d) and factors f (n, rotations), and their bounds."""
    n, turns, d = signs.shape
    weighed = (signs / (f * np.float32(math.sqrt(d) * turns))[:, :, None]).reshape(n, turns * d)
    turned = np.hstack([q @ rotation(d, t) for t in range(1, turns + 1)])
    spread = np.maximum((1 / (f * f) - 1).mean(1), 0)
    return turned @ weighed.T, EPSILON * np.sqrt(spread) / np.float32(math.sqrt(max(1, turns * (d - 1)))) + ROUNDING


#: What rounding to 8 bits moves an estimate by: EPSILON deviations, each at most half of 1 / 127 over a factor of 0.75.
ROUNDING = np.float32(EPSILON * 0.5 / 127 / 0.75)


def encoded(x: np.ndarray, tables_: int, bits: int, luck: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes of unit vectors x, a row of bytes each, and their buckets; luck: a seed for each vector.

    A row: scale, CODES factors (4 bytes each), d rounded coordinates (1 byte each), then the signs under as
    many rotations as the tables take, and CODES at least, bit by bit.
    """
    n, d = x.shape
    turns = max(CODES, -(-bits * tables_ // d))
    signs = np.zeros((n, turns, d), bool)
    f = np.zeros((n, CODES), np.float32)
    for t in range(1, turns + 1):
        y = x @ rotation(d, t)
        signs[:, t - 1] = y >= 0
        if t <= CODES:
            f[:, t - 1] = code(y)[1]
    scale = np.abs(x).max(1, keepdims=True) / np.float32(127)
    at = mix(luck[:, None] + np.arange(1, d + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rounded = np.floor(x / scale + (at >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)).clip(-128, 127).astype(np.int8)
    flat = signs.reshape(n, turns * d)
    rows = np.hstack([scale.astype("<f4").view(np.uint8), f.astype("<f4").view(np.uint8), rounded.view(np.uint8), np.packbits(flat, 1)])
    return rows, buckets_of(flat, d, bits, tables_)


def buckets_of(flat: np.ndarray, d: int, bits: int, tables_: int) -> np.ndarray:
    s = flat[:, : bits * tables_].reshape(len(flat), tables_, bits).astype(np.uint64)
    at = (s << np.arange(bits, dtype=np.uint64)).sum(2, dtype=np.uint64)
    return mix(mix(at + np.full(1, d, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.arange(1, tables_ + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)


def decoded(rows: np.ndarray, d: int, bits: int, tables_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query sides, signs (as -1 and 1), factors and buckets of encoded() rows."""
    head = 4 * (1 + CODES)
    scale, f = rows[:, :4].copy().view("<f4"), rows[:, 4:head].copy().view("<f4")
    flat = np.unpackbits(rows[:, head + d :], 1).astype(bool)
    signs = np.where(flat[:, : CODES * d], np.float32(1), np.float32(-1)).reshape(len(rows), CODES, d)
    return rows[:, head : head + d].view(np.int8).astype(np.float32) * scale, signs, f, buckets_of(flat, d, bits, tables_)


def unit(v: np.ndarray) -> np.ndarray:
    return (v / np.abs(v).max(1, keepdims=True) / np.linalg.norm(v / np.abs(v).max(1, keepdims=True), axis=1, keepdims=True)).astype(np.float32)


def links(frame: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of frame (vec_id, embedding)."""
    frame = frame.select("vec_id", "embedding")
    of_id = frame.schema["vec_id"].dataType.simpleString()
    # Vectors travel in the precision that they come in; all sums are in double precision.
    form = np.dtype("<f4" if frame.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8")

    def keys(batches):
        import pyarrow as pa

        for batch in batches:
            out, vecs = [], []
            for v in batch.column("embedding"):
                a = None
                if v.is_valid and len(v.values) and not v.values.null_count:
                    a = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # minus zero is zero
                    a = a if np.isfinite(a).all() and a.any() else None
                vecs.append(None if a is None else a.astype(form).tobytes())
                out.append(None if a is None else hashlib.md5(vecs[-1], usedforsecurity=False).digest())
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "key": pa.array(out, pa.binary()), "v": pa.array(vecs, pa.binary())})

    rows = stored(frame.mapInArrow(keys, f"vec_id {of_id}, key binary, v binary"), "vectors")
    nodes = stored(rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")), "nodes")
    bits, count = shape(nodes.count(), threshold)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            vs, keys_ = batch.column("v").to_pylist(), batch.column("key").to_pylist()
            codes: list = [None] * len(vs)
            lists: list = [None] * len(vs)
            sizes = np.array([len(v) // form.itemsize for v in vs], np.int64)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                luck = np.array([int.from_bytes(keys_[i][:8], "little") for i in at], np.uint64)
                rows_, buckets = encoded(unit(np.stack([np.frombuffer(vs[i], form) for i in at]).astype(np.float64)), count, bits, luck)
                for i, r, b in zip(at.tolist(), rows_, buckets, strict=True):
                    codes[i], lists[i] = r.tobytes(), b
            yield pa.record_batch({"key": batch.column("key"), "d": pa.array(sizes, pa.int32()), "code": pa.array(codes, pa.binary()), "buckets": pa.array(lists, pa.list_(pa.int64()))})

    placed = stored(nodes.select("key", "v").mapInArrow(place, "key binary, d int, code binary, buckets array<long>"), "placed")
    members = placed.select("key", F.explode("buckets").alias("bucket"))
    full = stored(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "full")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    inside = members.join(full, "bucket").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    units = inside.select("bucket", "key", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    units = stored(units.select("bucket", "key", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")), "units")
    codes = placed.select("key", "d", "code")

    def sides(pdf):
        """Codes of a unit and the places of its left and right side."""
        part, i, j = pdf["part"].to_numpy(), pdf["i"].iloc[0], pdf["j"].iloc[0]
        rows_ = np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(pdf), -1)
        left, right = (np.arange(len(pdf)),) * 2 if i == j else (np.flatnonzero(part == i), np.flatnonzero(part == j))
        return decoded(rows_, int(pdf["d"].iloc[0]), bits, count), left, right, i == j

    def open_pairs(q, signs, f, left, right, same):
        """Pairs (first, second) whose estimate leaves them open, some at a time."""
        for s in range(0, len(left), 256):
            a = left[s : s + 256]
            est, bound = estimates(q[a], signs[right], f[right])
            x, y = np.nonzero(est + bound >= threshold)
            x, y = a[x], right[y]
            yield (x[x < y], y[x < y]) if same else (x, y)

    def sift(pdf):
        (q, signs, f, _), left, right, same = sides(pdf)
        some = np.zeros(len(pdf), bool)
        for x, y in open_pairs(q, signs, f, left, right, same):
            some[x] = some[y] = True
        return pdf.loc[some, ["bucket", "key", "part", "i", "j"]]

    def block(pdf):
        import pandas as pd

        bucket = pdf["bucket"].iloc[0]
        (q, signs, f, at), left, right, same = sides(pdf)
        v, copies = np.stack([np.frombuffer(x, form) for x in pdf["v"]]).astype(np.float64), pdf["copies"].to_numpy()
        table = int(np.flatnonzero(at[0] == bucket)[0])
        v = v / np.abs(v).max(1, keepdims=True)
        norm = np.linalg.norm(v, axis=1)
        total, pairs = np.zeros(len(v), np.int64), []
        for left_, right_ in open_pairs(q, signs, f, left, right, same):
            for r in range(0, len(left_), 65536):
                x, y = left_[r : r + 65536], right_[r : r + 65536]
                near = np.einsum("nd,nd->n", v[x], v[y]) / (norm[x] * norm[y]) >= threshold
                x, y = x[near], y[near]
                first = (at[x, :table] != at[y, :table]).all(1)
                np.add.at(total, x[first], copies[y[first]])
                np.add.at(total, y[first], copies[x[first]])
                pairs.append((x, y))
        x, y = (np.concatenate(c) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        label = np.arange(len(v))
        while len(x):
            low = label.copy()
            np.minimum.at(low, x, label[y])
            np.minimum.at(low, y, label[x])
            low = low[low]
            if (low == label).all():
                break
            label = low
        some = np.flatnonzero((total > 0) | (label != np.arange(len(v))))
        key = pdf["key"].to_numpy()
        return pd.DataFrame({"a": key[some], "b": key[label[some]], "n": total[some]})

    left_open = units.join(codes, "key").groupBy("bucket", "i", "j").applyInPandas(sift, "bucket long, key binary, part int, i int, j int")
    left_open = stored(left_open, "open")
    carried = nodes.select("key", "copies", "v").join(codes, "key")
    found = stored(left_open.join(carried, "key").groupBy("bucket", "i", "j").applyInPandas(block, "a binary, b binary, n long"), "found")
    root = components(found.select("a", "b"))
    sums = found.groupBy("a").agg(F.sum("n").alias("n"))
    nodes = nodes.select("key", "least", "copies").join(root.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    nodes = stored(nodes.join(sums.withColumnRenamed("a", "key"), "key", "left"), "rooted")
    least = stored(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    nodes = stored(nodes.join(least, "root").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "linked")
    # Rows without a usable vector have no key; they are spread by a key of their own.
    out = rows.where("key is not null").select("vec_id", "key").join(nodes, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
