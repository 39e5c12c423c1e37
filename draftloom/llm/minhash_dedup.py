"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Weights: term frequency times smoothed inverse document frequency of runs of five words. Document
frequencies are exact counts over all documents: parts of the table hand their shingles to ranges of
hashes, where they are summed, and get back the counts of those in more than one document. The
texts stay where they are: they are written once, bucketed by part, and read as they lie.
Signatures: BANDS x ROWS samples by improved consistent weighted sampling. Texts that agree in all
samples of a band share a bucket. Verification, in parts that lose no candidate:

* every text against three leaders of each of its buckets (as many pairs as there are members);
* in buckets of more than BLOCK texts that are still in different components, new leaders from those
  outside the bucket's largest component, ROUNDS times;
* then, in buckets whose texts are still in different components: those of at most BLOCK texts are
  compared whole, across components; in larger ones a text is compared with those that share one of
  the rarest shingles of both, without which no two texts are similar enough (a prefix filter), in
  blocks where a shingle is common. Blocks emit a spanning forest, never all pairs.

Equal texts are one node throughout. A link is a weighted Jaccard similarity of at least 0.8.
Shingles are told apart by hashes of 40 bits and as many more as number the ranges; pairs are
compared by 32 bits of them, which can move a similarity by some 1e-4 in texts of 10,000 words.

Cases: null and empty texts and texts of white space only have no shingles: they group with texts
equal to them (null counts as empty) and nothing else; texts under five words are one shingle; a
null doc_id is grouped by its text (group_id is the least non-null doc_id of the group, else null).
Repeated rows are copies. Extra columns are kept aside, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, components, forget, hand_back, mix, release, shingles, stored, tidy, utf8, word_hashes

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 14, 4
#: Bytes of text to a range of hashes where document frequencies are counted, and the least number of ranges.
GROUP, GROUPS = 1 << 23, 256
#: Shingles that a task holds before it hands them over.
HELD = 1 << 21
#: Texts to a block where a bucket is compared whole.
BLOCK = 512
LEADERS, ROUNDS = 3, 2

_rng = np.random.default_rng(20)
_K = BANDS * ROWS
_MUL = _rng.integers(1, 2**63, _K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = _rng.gamma(2, 1, 65536).astype(np.float32).clip(1e-3)
_BETA = _rng.random(65536, np.float32)
_LNC = np.log(_rng.gamma(2, 1, 65536).clip(1e-6)).astype(np.float32)


def weights(tf: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    return (tf * (np.log((1 + n) / (1 + df)) + 1)).astype(np.float32)


def summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes without repeats, and the sums of their counts."""
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(c, first) if len(first) else c


def counts(u: np.ndarray, h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Document frequencies of shingles u, out of the counts c of hashes h (sorted); 1 where h has none."""
    if not len(h):
        return np.ones(len(u), np.int64)
    at = np.searchsorted(h, u).clip(max=len(h) - 1)
    return np.where(h[at] == u, c[at], 1)


def vector(text: bytes, h: np.ndarray, c: np.ndarray, n: int, mask: np.uint64 = np.uint64(2**64 - 1)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted shingle hashes of a text, their weights and document frequencies."""
    u, tf = np.unique(shingles(word_hashes(np.frombuffer(text, np.uint8)), WORDS) & mask, return_counts=True)
    df = counts(u, h, c)
    return u, weights(tf, df, n), df


def prefix(u: np.ndarray, w: np.ndarray, df: np.ndarray) -> bytes:
    """32 bits of the rarest shingles that hold more than 1 - SIMILARITY of the weight, less those of one document.

    Two texts as similar as SIMILARITY share one of them: were the first shingle they have in common,
    by rarity, outside of one text's, all they have in common would weigh less than SIMILARITY of it.
    """
    order = np.lexsort((u, df))
    after = w[order][::-1].cumsum(dtype=np.float64)[::-1]  # from each to the end
    first = order[after >= SIMILARITY * (1 - 1e-5) * w.sum(dtype=np.float64)]
    return np.unique((u[first[df[first] > 1]] >> np.uint64(32)).astype("<u4")).tobytes()


def packed(u: np.ndarray, w: np.ndarray) -> bytes:
    """A vector by the upper 32 bits of its hashes: all of them, then all weights."""
    u, at = np.unique((u >> np.uint64(32)).astype("<u4"), return_inverse=True)
    return u.tobytes() + np.bincount(at, w, len(u)).astype("<f4").tobytes()


def unpacked(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b, "<u4", len(b) // 8), np.frombuffer(b, "<f4", offset=len(b) // 2)


def signature(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The samples of a weighted set, 64 bits each."""
    best, sample, lw = np.full(_K, np.inf, np.float32), np.zeros(_K, np.uint64), np.log(w)
    rows = np.arange(_K)
    for s in range(0, len(u), 512):
        x, y = u[s : s + 512], lw[s : s + 512]
        m = x[None, :] * _MUL[:, None]
        i = (m >> np.uint64(48)).astype(np.intp)
        r, beta = _R[i], _BETA[i]
        t = np.floor(y / r + beta)
        m >>= np.uint64(32)
        m &= np.uint64(0xFFFF)
        a = _LNC[m.astype(np.intp)] - r * (t - beta + np.float32(1))
        j = a.argmin(1)
        low = a[rows, j]
        new = low < best
        best[new] = low[new]
        sample[new] = mix(x[j[new]] + t[rows, j][new].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return sample


def bands(sample: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for x in sample.reshape(BANDS, ROWS).T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x)
    return h.view(np.int64)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    (u, w), (v, z) = sorted((a, b), key=lambda x: len(x[0]))
    if not len(u):
        return 0.0
    at = np.searchsorted(v, u).clip(max=len(v) - 1)
    hit = v[at] == u
    both = float(np.minimum(w[hit], z[at[hit]]).sum(dtype=np.float64))
    return both / (float(w.sum(dtype=np.float64)) + float(z.sum(dtype=np.float64)) - both)


def texts_of(batch) -> Iterator[bytes]:
    data, off = utf8(batch.column("text"))
    for s, e in zip(off[:-1], off[1:], strict=True):
        yield data[s:e].tobytes()


def coded(h: np.ndarray, bits: int, width: int) -> bytes:
    """Sorted hashes of one range (equal upper bits) by the width bits that follow: differences of 32 bits where they fit."""
    v = (h << np.uint64(bits)) >> np.uint64(64 - width)
    d = np.diff(v, prepend=np.zeros(1, np.uint64))
    return b"\0" + d.astype("<u4").tobytes() if len(d) and d.max() < 1 << 32 else b"\1" + v.astype("<u8").tobytes()


def decoded(b: bytes, span: int, bits: int, width: int) -> np.ndarray:
    v = np.frombuffer(b, "<u8", offset=1) if b[0] else np.frombuffer(b, "<u4", offset=1).astype(np.uint64).cumsum(dtype=np.uint64)
    return (np.uint64(span) << np.uint64(64 - bits)) | (v << np.uint64(64 - bits - width))


def frequencies(texts: DataFrame, groups: int) -> tuple[DataFrame, np.uint64]:
    """(src, u, c) of texts (src, text): for each src, shingles of its texts that are in more than one document, and in how many; the bits of hashes that count.

    A row holds the shingles of one src (or some of them) in one of about as many ranges of hashes as groups says.
    """
    bits = max(1, (groups - 1).bit_length())
    width = min(40, 64 - bits)
    mask = np.uint64((1 << 64) - (1 << (64 - bits - width)))
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def part(batches):
        import pyarrow as pa

        hs, held, of = [], 0, None

        def handed():
            h, n = np.unique(np.concatenate(hs), return_counts=True)
            cut = np.append(np.searchsorted(h, edges), len(h))
            at = np.flatnonzero(cut[1:] > cut[:-1]).tolist()
            us = [coded(h[cut[i] : cut[i + 1]], bits, width) for i in at]
            cs = [b"" if (n[cut[i] : cut[i + 1]] == 1).all() else n[cut[i] : cut[i + 1]].astype("<i8").tobytes() for i in at]
            return pa.record_batch({"src": pa.array([of] * len(at), pa.int32()), "span": pa.array(at, pa.int32()), "u": pa.array(us, pa.binary()), "c": pa.array(cs, pa.binary())})

        for batch in batches:
            for src, text in zip(batch.column("src").to_pylist(), texts_of(batch), strict=True):
                if src != of or held > HELD:
                    if held:
                        yield handed()
                    hs, held, of = [], 0, src
                hs.append(np.unique(shingles(word_hashes(np.frombuffer(text, np.uint8)), WORDS) & mask))
                held += len(hs[-1])
        if held:
            yield handed()

    def total(key, table):
        import pyarrow as pa

        span = key[0].as_py()
        us = [decoded(x.as_py(), span, bits, width) for x in table.column("u")]
        cs = [np.frombuffer(x.as_py(), "<i8") if len(x.as_py()) else np.ones(len(u), np.int64) for x, u in zip(table.column("c"), us, strict=True)]  # none: all are 1
        every = np.sort(np.concatenate(us))
        twice = every[1:][every[1:] == every[:-1]]  # in more than one row
        many = np.unique(np.concatenate([twice, *(u[c > 1] for u, c in zip(us, cs, strict=True))]))
        n = np.zeros(len(many), np.int64)
        hits = []
        for u, c in zip(us, cs, strict=True):
            at = np.searchsorted(u, many).clip(max=len(u) - 1)
            hit = np.flatnonzero(u[at] == many)
            n[hit] += c[at[hit]]
            hits.append(hit)
        out = [(src, many[hit].tobytes(), n[hit].astype("<i8").tobytes()) for src, hit in zip(table.column("src").to_pylist(), hits, strict=True) if len(hit)]
        src, us, ns = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"src": pa.array(src, pa.int32()), "u": pa.array(us, pa.binary()), "c": pa.array(ns, pa.binary())})

    parts = texts.select("src", "text").mapInArrow(tidy(part), "src int, span int, u binary, c binary")
    return parts.groupBy("span").applyInArrow(total, "src int, u binary, c binary"), mask


def looked_up(table) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes and counts in rows of frequencies()."""
    us, cs = ([np.frombuffer(x.as_py(), form) for x in table.column(name)] for name, form in (("u", "<u8"), ("c", "<i8")))
    h, c = np.concatenate([np.zeros(0, np.uint64), *us]), np.concatenate([np.zeros(0, np.int64), *cs])
    order = np.argsort(h)
    return h[order], c[order]


def open_buckets(inside: DataFrame, group: DataFrame) -> DataFrame:
    """(bucket, n, key, root) of the members of buckets whose texts are in different components."""
    now = inside.where(F.col("n") > 2).join(group.select(F.col("node").alias("key"), "root"), "key", "left").select("bucket", "n", "key", F.coalesce("root", "key").alias("root"))
    now = stored(now, "now")
    some = stored(now.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket"), "open")
    return now.join(some, "bucket", "left_semi")


def led(members: DataFrame, turn: int) -> DataFrame:
    """(a, b) of members (bucket, key) with leaders of their buckets."""
    first = [F.min(F.struct(F.xxhash64("key", F.lit(turn * LEADERS + i)).alias("h"), F.col("key").alias("k"))).alias(f"l{i}") for i in range(LEADERS)]
    leaders = stored(members.groupBy("bucket").agg(*first).select("bucket", F.array_distinct(F.array(*(f"l{i}.k" for i in range(LEADERS)))).alias("leaders")), "leaders")
    pairs = members.join(leaders, "bucket").select("key", F.explode("leaders").alias("leader")).where("key <> leader")
    return stored(pairs.select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).distinct(), "pairs")


def verified(pairs: DataFrame, vecs: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that are as similar as SIMILARITY."""

    def verify(batches):
        import pyarrow as pa

        for batch in batches:
            ok = [jaccard(unpacked(x.as_py()), unpacked(y.as_py())) >= SIMILARITY for x, y in zip(batch.column("ua"), batch.column("ub"), strict=True)]
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(ok, pa.bool_()))

    one = stored(pairs.join(vecs.select(F.col("key").alias("a"), F.col("u").alias("ua")), "a"), "half")
    two = one.join(vecs.select(F.col("key").alias("b"), F.col("u").alias("ub")), "b")
    links = stored(two.mapInArrow(tidy(verify), "a binary, b binary"), "links")
    release(one)
    return links


def compared(rest: DataFrame, vecs: DataFrame) -> DataFrame:
    """Links (a, b), a spanning forest of each block's, between members of rest (bucket, n, key, root) of different roots."""
    small = rest.where(F.col("n") <= BLOCK).select(F.col("bucket").alias("of"), F.lit(False).alias("rare"), "key", "root")
    large = stored(rest.where(F.col("n") > BLOCK).select("key", "root").distinct(), "large")

    def rarest(batches):
        import pyarrow as pa

        for batch in batches:
            lists = [np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in batch.column("rare")]
            at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            of = np.concatenate([np.zeros(0, np.int64), *lists])
            yield pa.record_batch({"of": pa.array(of), "rare": pa.array(np.ones(len(of), bool)), "key": batch.column("key").take(pa.array(at)), "root": batch.column("root").take(pa.array(at))})

    by_rare = large.join(vecs.select("key", "rare"), "key").mapInArrow(rarest, "of long, rare boolean, key binary, root binary")
    units = stored(small.unionByName(by_rare), "units")
    size = units.groupBy("of", "rare").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("of", "rare", "size")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    units = units.join(stored(size, "sizes"), ["of", "rare"]).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    units = units.select("of", "rare", "key", "root", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    units = units.select("of", "rare", "key", "root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))

    def block(pdf):
        import pandas as pd

        roots = {}

        def find(x):
            while roots.setdefault(x, x) != x:
                roots[x] = x = roots[roots[x]]
            return x

        vs = [(k, r, unpacked(u)) for k, r, u in zip(pdf["key"], pdf["root"], pdf["u"], strict=True)]
        vs.sort(key=lambda v: v[2][1].sum(dtype=np.float64))
        total = np.array([v[2][1].sum(dtype=np.float64) for v in vs])
        out = []
        for i, (k, r, x) in enumerate(vs):
            for j in range(i + 1, int(np.searchsorted(total, total[i] / SIMILARITY * (1 + 1e-6), "right"))):
                l, s, y = vs[j]  # lighter than similarity allows beyond that
                if find(r) != find(s) and jaccard(x, y) >= SIMILARITY:
                    roots[find(r)] = find(s)
                    out.append((k, l))
        return pd.DataFrame(out, columns=["a", "b"])

    return stored(units.join(vecs.select("key", "u"), "key").groupBy("of", "rare", "i", "j").applyInPandas(block, "a binary, b binary"), "more")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, group_id, n_copies) of every row of docs (doc_id, text, ...).

    text_key: MD5 of the text; group_id: least doc_id of all rows whose texts are linked; n_copies:
    rows with the same text.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = bucketed(docs.select("doc_id", F.unhex(F.md5("text")).alias("key"), "text"), "texts")
    rows = stored(texts.select("doc_id", "key"), "keys")
    size = texts.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    n_docs, groups = size["n"], max(GROUPS, -(-(size["bytes"] or 0) // GROUP))
    often, mask = frequencies(texts, groups)
    often = stored(often, "frequencies")

    def sketch(some, known):
        import pyarrow as pa

        h, c = looked_up(known)
        found = {}
        for batch in some.to_batches():
            for key, text in zip(batch.column("key").to_pylist(), texts_of(batch), strict=True):
                if key not in found:  # as many as the part has rows, at most
                    u, w, _ = vector(text, h, c, n_docs, mask)
                    found[key] = bands(signature(u, w)) if len(u) else None
        out = pa.table({"key": pa.array(list(found), pa.binary()), "bands": pa.array(list(found.values()), pa.list_(pa.int64()))})
        del h, c, found
        hand_back()
        return out

    signed = texts.select("src", "key", "text").groupBy("src").cogroup(often.groupBy("src")).applyInArrow(sketch, "key binary, bands array<long>")
    signed = stored(signed.groupBy("key").agg(F.first("bands").alias("bands")), "sketches")
    members = signed.select("key", F.explode("bands").alias("bucket"))
    full = stored(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "full")
    inside = stored(members.join(full, "bucket"), "members")
    pairs = led(inside, 0)

    # Texts of the keys asked for: a bitmap of fixed size keeps most others from being weighed.
    asked = stored(inside.select("key").distinct(), "asked")
    place = F.conv(F.hex(F.substring("key", 1, 3)), 16, 10).cast("long") + 1
    bits = asked.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    wanted = np.zeros(1 << 21, np.uint8)
    for r in bits.collect():  # 512 rows of 4 kB at most
        wanted[(r["at"] - 1) * 4096 : r["at"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    wanted = spark.sparkContext.broadcast(wanted)

    def weigh(some, known):
        import pyarrow as pa

        h, c = looked_up(known)
        bits, found = wanted.value, {}
        for batch in some.to_batches():
            for key, text in zip(batch.column("key").to_pylist(), texts_of(batch), strict=True):
                at = int.from_bytes(key[:3], "big")
                if bits[at >> 3] >> (at & 7) & 1 and key not in found:
                    u, w, df = vector(text, h, c, n_docs, mask)
                    found[key] = packed(u, w), prefix(u, w, df)
        us, rare = zip(*found.values(), strict=True) if found else ((), ())
        out = pa.table({"key": pa.array(list(found), pa.binary()), "u": pa.array(us, pa.binary()), "rare": pa.array(rare, pa.binary())})
        del h, c, found, us, rare
        hand_back()
        return out

    found = texts.select("src", "key", "text").groupBy("src").cogroup(often.groupBy("src")).applyInArrow(weigh, "key binary, u binary, rare binary")
    vecs = stored(found.join(asked, "key", "left_semi").groupBy("key").agg(F.first("u").alias("u"), F.first("rare").alias("rare")), "vectors")
    release(often)
    forget(texts)

    links = verified(pairs, vecs)
    group = components(links)
    for turn in range(1, ROUNDS + 1):
        rest = stored(open_buckets(inside, group), "rest")
        large = rest.where(F.col("n") > BLOCK)
        sizes = large.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("bucket").agg(F.max_by("root", F.struct("m", "root")).alias("most"))
        outside = stored(large.join(sizes, "bucket").where("root <> most").select("bucket", "key"), "outside")
        if outside.isEmpty():
            break
        links = links.unionByName(verified(led(outside, turn), vecs))
        group = components(links)
    else:
        rest = open_buckets(inside, group)
    group = components(links.unionByName(compared(rest, vecs)))
    release(vecs)

    keys = rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies"))
    placed = stored(keys.join(group.select(F.col("node").alias("key"), "root"), "key", "left").select("key", "least", "n_copies", F.coalesce("root", "key").alias("root")), "placed")
    least = stored(placed.groupBy("root").agg(F.min("least").alias("group_id")), "least")
    placed = stored(placed.join(least, "root").select("key", "n_copies", "group_id"), "groups")
    return rows.select("doc_id", "key").join(placed, "key").select("doc_id", F.lower(F.hex("key")).alias("text_key"), "group_id", "n_copies")


def op10_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, group_id (its class), n_copies, kept (it is the one that stays)."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "group_id", "n_copies", F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, one of each group: the one of least doc_id; of rows of equal doc_id and text the one of least hash.

    The columns are those of docs, whatever their names.
    """
    found = near_duplicates(docs)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("group_id"))).groupBy(F.col("doc_id").alias("id"), F.unhex("text_key").alias("key")).agg(F.count(F.lit(1)).alias("times"))
    stay = stored(stay, "stay").select(F.struct("id", "key", "times").alias("stay"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.select(row.alias("row"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"))
    kept = keyed.join(stay, F.col("row.doc_id").eqNullSafe(F.col("stay.id")) & (F.col("key") == F.col("stay.key")))
    plain = [F.to_json(F.struct(f"row.`{c}`")) if "map<" in kind else F.col(f"row.`{c}`") for c, kind in docs.dtypes]
    several = kept.where("stay.times > 1").groupBy("stay.id", "key").agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
    return kept.where("stay.times = 1").select("row.*").unionByName(several.select("row.*"))
