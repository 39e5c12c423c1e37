"""Embeddings, URLs, mixing, packing, sharding, near duplicates, pipeline: brute force, round trips, odd input."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from draftloom.llm import embedding_dedup, minhash_dedup, mixing, packing, sharding, url_filter
from draftloom.llm.common import shingles, word_hashes
from draftloom.llm.registry import ORACLES
from tests.conftest import SMALL
from tests.helpers import same

from .conftest import WORDS, prose


def reach(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


# Embeddings ------------------------------------------------------------------------------------


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 24))
    x = (centres[rng.integers(0, 60, 900)] + rng.normal(size=(900, 24)) * rng.choice([0.1, 0.25, 0.4], (900, 1))).astype(np.float32)
    x[100:160] = x[5]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [None] * 24, [1.0] * 12]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900 + i, v) for i, v in enumerate(odd)]
    got = {r["vec_id"]: r for r in embedding_dedup.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    y = x.astype(np.float64)
    cos = (y @ y.T) / np.linalg.norm(y, axis=1)[:, None] / np.linalg.norm(y, axis=1)
    near = cos >= 0.9
    np.fill_diagonal(near, False)
    root = reach(900, np.argwhere(near).tolist())
    found = sum(got[i]["n_links"] for i in range(900))
    assert found <= near.sum() and found >= 0.99 * near.sum()  # none below, buckets find nearly all
    assert [got[i]["component_id"] for i in range(900)] == root
    assert all(got[900 + i]["n_links"] == 0 and got[900 + i]["kept"] for i in range(6))


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(400, 64))
    b = 0.95 * a + 0.3 * rng.normal(size=(400, 64))
    turned = [embedding_dedup.unit(v) for v in (a, b)]
    true = (turned[0] * turned[1]).sum(1)
    errors = []
    for turn in range(12):
        spin = embedding_dedup.rotation(64, 100 + turn)
        q, r = (t @ spin for t in turned)
        rows, buckets = embedding_dedup.encoded(r, 4, 7, np.arange(400, dtype=np.uint64))
        side, signs, f, again = embedding_dedup.decoded(rows, 64, 7, 4)
        assert np.abs(side - r).max() <= np.abs(r).max() / 127 and (again == buckets).all()
        q, *_ = embedding_dedup.decoded(embedding_dedup.encoded(q, 4, 7, np.arange(400, dtype=np.uint64))[0], 64, 7, 4)
        est, bound = embedding_dedup.estimates(q, signs, f)
        assert (np.abs(np.diag(est) - true) <= bound).all()
        errors.append(np.diag(est) - true)
    assert abs(np.mean(errors)) < 0.005


def test_embeddings_on_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, key string, n string")
    assert embedding_dedup.links(empty).count() == 0
    rows = [(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (7, [0.0, 1.0])]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(0, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (7, 0, 7, True)]


# URLs ------------------------------------------------------------------------------------------


def test_rules_and_reputation(spark):
    urls = ["http://Example.com/en/x?q", "https://www.example.com/en/", "http://a.example.com/en/1", "http://b.net/es/1", "http://b.net/de/1", "nothing", None, "http://bad.org", "http://deep.bad.org/x", "http://new.ok.org/x", "x://?q", "http://notexample.com/en/"]
    host, path = url_filter.parts()
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").select("page_id", host.alias("host"), path.alias("path"))
    outcomes = spark.createDataFrame([("bad.org", 1)] * 60 + [("ok.org", 0)] * 200 + [("other.com", 0)] * 300, "host string, bad long")
    got = {r["page_id"]: r for r in url_filter.judge(pages, outcomes).collect()}
    assert [(got[i]["host"], got[i]["path"]) for i in (0, 5, 6, 7, 10)] == [("example.com", "/en/x"), ("", ""), ("", ""), ("bad.org", ""), ("", "")]
    assert [got[i]["rule"] for i in range(6)] == ["example.com/en/", "www.example.com/en/", "example.com/en/", "net/es/", None, None]
    assert [got[i]["verdict"] for i in range(12)] == ["block", "allow", "block", "block", "allow", "allow", "allow", "block", "block", "allow", "allow", "allow"]
    assert url_filter.judge(pages.limit(0), outcomes.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, outcomes.limit(0)).where("rule is null").collect()} == {"allow"}


def test_url_query_equals_its_sql(spark):
    same(url_filter.op4_url_filter(spark, SMALL), ORACLES["op4_url_filter"], SMALL)


# Mixing ----------------------------------------------------------------------------------------


def fill(sizes):
    """Targets by repeated resharing of what is above twice a source's size."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while open_ and left > 1e-9:
        part = {s: left * w[s] / sum(w[o] for o in open_) for s in open_}
        over = {s for s in open_ if target[s] + part[s] > 2 * sizes[s]}
        if not over:
            for s in open_:
                target[s] += part[s]
            break
        for s in over:
            left -= 2 * sizes[s] - target[s]
            target[s] = 2.0 * sizes[s]
            open_.discard(s)
    return target


def test_targets_and_epochs(spark):
    rows = [(i, prose(3 + i % 40, i), ("a", "b", "c", "d", None)[min(4, i % 17)]) for i in range(700)] + [(None, prose(9, 1), "a"), (701, None, "b"), (702, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = fill(dict(sizes))
    for r in got:
        assert math.isclose(r["target"], want[r["source"]], abs_tol=1e-6) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    whole = defaultdict(set)
    for r in got:
        if r["size"]:
            whole[r["source"]].add(r["taken"] // r["size"])
    assert all(max(v) - min(v) <= 1 for v in whole.values())  # complete epochs first
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got))


def test_weights_of_quality_decide_who_is_drawn(spark):
    rows = [(i, " ".join(["word"] * 20) + (" |" * 30 if i % 2 else "") + f" {i}", "a" if i < 1000 else "b") for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    first = sorted((r for r in got if r["source"] == "b"), key=lambda r: r["draw"])[:500]
    assert sum(r["doc_id"] % 2 == 0 for r in first) > 300  # even ones weigh more


def test_mix_query_and_rows(spark, edges, empty):
    same(mixing.op5_mixing(spark, SMALL), ORACLES["op5_mixing"], SMALL)
    out = mixing.take(edges)
    assert out.columns == edges.columns
    words = sum(len((r["text"] or "").split()) for r in out.collect())
    assert words == mixing.mix(edges).agg({"taken": "sum"}).first()[0]
    assert mixing.take(empty).count() == 0 and mixing.mix(empty).count() == 0


# Packing ---------------------------------------------------------------------------------------


def test_pieces_are_the_tokenizers_and_packed_without_gaps(spark, edges):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    extra = [(100, "It's <|startoftext|> naïve ﬁ ZÜRICH 42 don't !!! a_b"), (101, "日本語 x\u3000y"), (102, "İstanbul ǅ ß"), (103, "l'été d'1 're''s")]
    docs = edges.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).union(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))
    want = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[r["doc_id"], k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.pack(docs).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 4096
    total = sum(r["length"] for r in got)
    assert len(sequences) <= math.ceil(total / 4096) * 1.03 + 2


def test_plan_holds_all_lengths_in_few_sequences():
    rng = np.random.default_rng(3)
    for counts in ({}, {1: 5}, {4096: 3, 4095: 2, 1: 2}, dict(Counter(rng.integers(1, 4097, 3000).tolist())), {2049: 40, 2047: 40}, dict(Counter(rng.integers(1000, 2500, 2000).tolist()))):
        held, used = Counter(), 0
        for m, room, items in packing.plan(dict(counts)):
            assert sum(n * q for n, q in items) + room == 4096
            used += m
            for n, q in items:
                held[n] += m * q
        assert held == Counter(counts)
        least = max(math.ceil(sum(n * k for n, k in counts.items()) / 4096), sum(k for n, k in counts.items() if n > 2048))
        assert used <= 1.08 * least + 20


def test_packing_an_empty_table(empty):
    assert packing.pack(empty).count() == 0


# Sharding --------------------------------------------------------------------------------------


def test_shards_are_even_and_slots_gapless(spark, edges, empty):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    for frame, shards in ((docs.union(docs), 7), (edges.select("doc_id", "text"), 3)):
        sized = sharding.keyed(frame).selectExpr("*", "octet_length(coalesce(text, '')) + 16L AS size")
        got = sharding.shard(sized, shards).collect()
        assert len(got) == frame.count()
        slots, load, texts = defaultdict(list), Counter(), defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            load[r["shard"]] += r["size"]
            texts[r["text"] or ""].append((r["shard"], r["slot"]))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        mean, largest = sum(load.values()) / shards, max(r["size"] for r in got)
        assert all(0 <= s < shards for s in load) and max(load.values()) <= mean * 1.01 + largest
        for at in texts.values():  # equal texts lie next to each other
            at.sort()
            assert all(b == (s, n + 1) or b == (s + 1, 0) for (s, n), b in zip(at, at[1:], strict=False))
    assert sharding.shard(sharding.keyed(empty.select("doc_id", "text")).selectExpr("*", "16L AS size")).count() == 0


def test_shard_query(spark):
    rows = sharding.op9_sharding(spark, SMALL).collect()
    want = {r["doc_id"]: (len(r["text"].encode()) + 16, zlib.crc32(r["text"].encode())) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == want
    assert {r["law"] for r in rows} == {"bytes"} and {r["shard"] for r in rows} <= set(range(40))


# Near duplicates -------------------------------------------------------------------------------


def weighted_jaccard(texts):
    """Similarities of all pairs, with exact document frequencies."""
    sets = [Counter(shingles(word_hashes(np.frombuffer(t.encode(), np.uint8))).tolist()) for t in texts]
    df = Counter(u for s in sets for u in s)
    n = len(texts)
    weigh = [{u: k * (math.log((1 + n) / (1 + df[u])) + 1) for u, k in s.items()} for s in sets]
    for i in range(n):
        for j in range(i):
            both = sum(min(w, weigh[j].get(u, 0)) for u, w in weigh[i].items())
            total = sum(weigh[i].values()) + sum(weigh[j].values()) - both
            yield i, j, both / total if total else 0.0


def test_groups_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = []
    for base in range(40):
        words = [WORDS[k] + str(rng.integers(40)) for k in rng.integers(0, len(WORDS), 200)]
        texts.append(" ".join(words))
        for changes in (0, 1, 2, 60)[: 1 + base % 4]:
            copy = list(words)
            for at in rng.integers(0, 200, changes):
                copy[at] = f"new{rng.integers(1000)}"
            texts.append(" ".join(copy))
    close = [(i, j, s) for i, j, s in weighted_jaccard(texts) if s > 0.3]
    assert not [s for *_, s in close if 0.78 < s < 0.82]  # none that the sketch of frequencies could turn
    want = reach(len(texts), [(i, j) for i, j, s in close if s >= 0.8])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in minhash_dedup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(6)
    hits = total = 0
    for k in range(60):  # sets of their own each time: the samples' hash functions are fixed
        u = np.unique(rng.integers(1, 2**63, 400, dtype=np.uint64))
        v = np.unique(np.concatenate([u[: 300 + k], rng.integers(1, 2**63, 100 - k, dtype=np.uint64)]))
        w, z = np.ones(len(u), np.float32), np.ones(len(v), np.float32)
        hits += (minhash_dedup.signature(u, w) == minhash_dedup.signature(v, z)).mean()
        total += minhash_dedup.jaccard((u, w), (v, z))
    assert abs(hits - total) / 60 < 0.03


def test_near_duplicates_on_odd_input(edges, empty):
    rows = minhash_dedup.near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    group = defaultdict(set)
    for r in rows:
        group[r["doc_id"]].add(r["group_id"])
    assert group[1] == group[5] == group[8] == group[10] == {1} and group[2] == group[3] == {2} and group[6] == {6}
    kept = minhash_dedup.keep_one(edges)
    assert kept.columns == edges.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 5 not in ids and 8 not in ids and 10 not in ids and {2, 6, 7, 9} <= set(ids)
    assert minhash_dedup.keep_one(empty).count() == 0


# Pipeline --------------------------------------------------------------------------------------


def test_stages_keep_columns_and_take_effect(spark, edges, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixture", "packed"]
    for docs in (edges, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SMALL).columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() >= docs.count()


def test_pipeline_runs_and_repeats(spark):
    rows = [sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SMALL).collect()) for _ in range(2)]
    assert rows[0] and rows[0] == rows[1]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert len({r[0] for r in rows[0]}) <= docs
