"""Cases that an operator which does only a part of the job gets wrong."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np

import corpus_pipeline
from draftloom.llm import common, embedding_dedup, minhash_dedup, packing, sharding, toxicity, url_filter
from draftloom.llm.common import bucketed, dealt, forget, hashed, shingles, stored, word_hashes
from tests.conftest import SMALL

from .conftest import prose


def test_rare_shingles_weigh_by_exact_document_frequencies(spark):
    common, one, two = (" ".join(f"{kind}{i}" for i in range(n)) for kind, n in (("c", 500), ("p", 90), ("q", 90)))
    texts = [" ".join((common, one)), " ".join((common, two))]
    for k in range(3000):  # each of the two endings is in 60 of these
        texts.append(" ".join([f"w{k}x{i}" for i in range(1500)] + [one] * (k < 60) + [two] * (60 <= k < 120)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["group_id"] for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got.pop(1) == 0  # 0.81 by exact counts
    assert all(i == g for i, g in got.items())


def test_pairs_at_the_threshold_are_not_lost(spark):
    rng = np.random.default_rng(4)
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, 2000, 64)))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x = np.concatenate([a, 0.9001 * a + np.sqrt(1 - 0.9001**2) * b])  # i and 2000 + i
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in range(4000)] == [(1, i % 2000) for i in range(4000)]


def test_the_fast_merges_are_the_vocabularys():
    """Each token's own text is that token for both engines, so they agree on all pieces; and they do on random ones."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    encode, ids = packing.merges_of(packing.vocabulary())
    words = [w for w in tokenizer.get_vocab(with_added_tokens=False) if w.endswith("</w>") and w[:-4].isascii() and w[:-4].isalpha() and w.islower()]
    rng = np.random.default_rng(7)
    letters = np.array([*"abcdefghijklmnopqrstuvwxyzàéíöüßñ"])
    words = [w[:-4] for w in words] + ["".join(rng.choice(letters, n)) for n in rng.integers(1, 40, 20_000)]
    for w, e in zip(words, tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
        assert ids[encode(w.encode() + b"\xff")].tolist() == e.ids
    import json

    with open(packing.vocabulary(), encoding="utf-8") as file:
        merges = json.load(file)["model"]["merges"]
    model = tokenizer.model
    for left, right in merges:  # by the vocabulary; its texts are of the file's own alphabet
        body = (left + right).removesuffix("</w>")
        if body != left + right:
            assert [t.value for t in model.tokenize(body)] == [left + right]


def test_forgetting_changes_no_tokens():
    few, many = packing.WordTokens(packing.vocabulary(), 10), packing.WordTokens(packing.vocabulary())
    texts = [f"Word{i % 7} other{i} don't <|endoftext|> naïve, {'x' * (i % 50)}!" for i in range(300)]
    assert [few(t) for t in texts] == many.many(texts)


def test_no_link_is_lost_about_the_threshold(spark):
    """Groups equal those by all pairs, similarities near 0.8 among them, by exact 64-bit document frequencies."""
    rng = np.random.default_rng(8)
    passage = [f"pass{i}" for i in range(60)]
    texts = []
    for base in range(60):
        words = [f"v{k}" for k in rng.integers(0, 3000, 300)]
        words[20:20] = passage[: base % 3 * 30]
        texts.append(" ".join(words))
        for changes in (2, 4, 6, 8, 10, 12):
            copy = list(words)
            for at in rng.integers(0, len(copy), changes):
                copy[at] = f"new{rng.integers(10_000)}"
            texts.append(" ".join(copy))
    sets = [dict(zip(*np.unique(shingles(word_hashes(np.frombuffer(t.encode(), np.uint8))), return_counts=True), strict=True)) for t in texts]
    df = Counter(h for s in sets for h in s)
    weight = [{h: k * (np.log((1 + len(texts)) / (1 + df[h])) + 1) for h, k in s.items()} for s in sets]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = links = 0
    for i, j in combinations(range(len(texts)), 2):
        if i // 7 == j // 7 or i % 7 == j % 7 == 0:
            a, b = weight[i], weight[j]
            both = sum(min(w, b[h]) for h, w in a.items() if h in b)
            s = both / (sum(a.values()) + sum(b.values()) - both)
            near += 0.75 < s < 0.85
            if s >= 0.8:
                links += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert near > 50 and links > 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["group_id"] for r in minhash_dedup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [find(i) for i in range(len(texts))]


def test_a_bucket_of_very_many_texts(spark):
    """50,000 texts in one bucket by a passage they all have: pairs among them are found without comparing all with all."""
    n, rng = 50_000, np.random.default_rng(3)
    common = np.sort(rng.integers(0, 2**63, 20, dtype=np.uint64) << np.uint64(1))
    rows = []
    for i in range(n):
        twin = i // 2 if i < 2000 else i  # the first 2,000 are 1,000 pairs
        own = np.random.default_rng([1, twin]).integers(0, 2**63, 40, dtype=np.uint64) << np.uint64(1)
        u = np.sort(np.concatenate([common, own]))
        df = np.where(np.isin(u, common), n, 2 if i < 2000 else 1)
        w = minhash_dedup.weights(np.ones(len(u)), df, n)
        rows.append((i.to_bytes(8, "big"), minhash_dedup.packed(u, w), minhash_dedup.prefix(u, w, df)))
    vecs = spark.createDataFrame(rows, "key binary, u binary, rare binary").repartition(8).persist()
    rest = vecs.selectExpr("1L bucket", f"{n}L n", "key", "key root")
    got = {tuple(sorted(int.from_bytes(x, "big") for x in r)) for r in minhash_dedup.compared(rest, vecs).collect()}
    assert got == {(2 * k, 2 * k + 1) for k in range(1000)}
    vecs.unpersist()


def test_new_leaders_find_what_the_first_miss(spark, monkeypatch):
    """With blocks of four, buckets of a chain of near copies are large: rounds of leaders and rare shingles link them all."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    words = prose(300, 9).split()
    words = [f"{w}{i}" for i, w in enumerate(words)]
    texts = []
    for k in range(40):
        words = list(words)
        words[(k * 7) % 300] = f"edit{k}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["group_id"] for r in minhash_dedup.near_duplicates(docs).collect()} == {0}


def test_of_equal_ids_and_texts_the_same_row_stays(spark):
    text = prose(60, 4)
    rows = [(1, text, f"s{i}", {"k": i}) for i in range(9)] + [(2, text, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stay string, key map<string, int>")
    got = [minhash_dedup.keep_one(docs.repartition(n)).collect() for n in (1, 3, 7)]
    assert len(got[0]) == 1 and got[0] == got[1] == got[2]


def test_stages_leave_columns_of_other_names_alone(spark, edges):
    """score, size, key and the like are the caller's: the same values come out, of the same types."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, edges, SMALL)
        assert got.dtypes == edges.dtypes, name
        rows = got.collect()
        assert rows and all(r[c] == "x" for r in rows for c in edges.columns[5:]), name


def test_shards_are_those_of_a_sort(spark):
    """Slots follow the order of all keys; boundaries are within tolerance of equal bytes; small groups of copies stay whole."""
    rng = np.random.default_rng(6)
    texts = [f"text {rng.integers(700)} " + "y" * int(rng.integers(60)) * (i % 3 == 0) for i in range(6000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    sized = stored(sharding.keyed(docs).selectExpr("*", "octet_length(text) + 16L AS size"), "sized")
    keys = {r["doc_id"]: (r["__h"], r["__i"], r["__r"]) for r in sized.collect()}
    got = sorted(sharding.shard(sized, 5, 0.02).collect(), key=lambda r: (r["shard"], r["slot"]))
    assert [r["doc_id"] for r in got] == sorted(keys, key=keys.get)
    total, load, homes = sum(r["size"] for r in got), Counter(), {}
    for r in got:
        load[r["shard"]] += r["size"]
        homes.setdefault(r["text"], set()).add(r["shard"])
    assert all(abs(n - total / 5) <= 2 * 0.02 * total / 5 + 100 for n in load.values())
    assert all(len(h) == 1 for h in homes.values())


def test_labels_of_other_values_do_not_count(spark):
    docs = spark.createDataFrame([(i, prose(30, i) + (" vile slur" if i % 3 == 0 else "")) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, (1 if i % 3 == 0 else 0) if i % 10 else [2, None][i % 20 == 0]) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model["words"]["vile"] > 0 and min(model["words"].values()) < -toxicity.DRIFT  # clean words have odds of their own
    rows = toxicity.score(docs, model).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in rows)


def test_partitions_get_buckets_of_their_own(spark):
    x = np.arange(5000, dtype=np.uint32)
    assert [r[0] for r in spark.range(5000).selectExpr("hash(cast(id as int))").collect()] == hashed(x).tolist()
    for parts, ways in ((1, 1), (37, 37), (250, 100)):
        src = dealt(parts, ways)
        assert len(set(src.tolist())) == parts and np.bincount(np.mod(hashed(src), ways), minlength=ways).max() <= -(-parts // ways)
    table = bucketed(spark.range(1000).repartition(9), "numbers")
    grouped = table.groupBy("src").agg({"id": "count"})
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString() and grouped.count() == 9
    forget(table)


def test_hosts_well_above_the_rate_of_all_are_blocked(spark):
    """A fifth of all pages is bad; a host at three times that goes, one at the rate stays; user and port don't part a domain."""
    rows = [(f"h{k}.example.org", int(i % 5 == 0)) for k in range(30) for i in range(100)] + [("worse.com", int(i % 5 < 3)) for i in range(300)]
    outcomes = spark.createDataFrame(rows, "host string, bad long")
    hosts = ["worse.com", "www.worse.com:8080", "me@worse.com", "h3.example.org", "new.example.org"]
    pages = spark.createDataFrame([(i, h, "/") for i, h in enumerate(hosts)], "page_id long, host string, path string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, outcomes, []).collect()}
    assert [got[i] for i in range(5)] == ["block", "block", "block", "allow", "allow"]


def test_components_of_few_edges_take_one_table(spark, monkeypatch):
    """Each table is files in the shared folder; rounds of five tables for a small graph are most of what a run writes."""
    rng = np.random.default_rng(6)
    pairs = [*rng.integers(0, 900, (500, 2)).tolist(), *([i, i + 1] for i in range(1000, 1300)), [5000, 5000], [1, 2], [2, 1]]
    least = {i: i for p in pairs for i in p}
    for _ in least:
        before = dict(least)
        for x, y in pairs:
            least[x] = least[y] = min(least[x], least[y])
        if least == before:
            break
    del least[5000]  # no edge to another
    edges = spark.createDataFrame([[x.to_bytes(8, "big"), y.to_bytes(8, "big")] for x, y in pairs], "a binary, b binary").persist()
    names, write = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: names.append(name) or write(df, name))

    def grouped(few):
        monkeypatch.setattr(common, "FEW", few, raising=False)
        groups = {}
        for r in common.components(edges).collect():
            groups.setdefault(bytes(r["root"]), []).append(int.from_bytes(r["node"], "big"))
        return sorted(sorted(g) for g in groups.values())

    expected = {}
    for x, to in least.items():
        expected.setdefault(to, []).append(x)
    expected = sorted(sorted(g) for g in expected.values())
    assert grouped(200_000) == expected
    assert len(names) == 1
    assert grouped(0) == grouped(40) == expected  # rounds only; rounds, then the driver
    none = common.components(edges.limit(0))
    assert none.columns == ["node", "root"] and none.count() == 0
    edges.unpersist()


def test_texts_leave_the_disk_before_pairs_are_compared(spark, monkeypatch):
    """The copy of all texts and the vectors of the pairs are not on disk together; no table is written only to be grouped."""
    docs = spark.createDataFrame([(i, prose(80, i // 2)) for i in range(20)] + [(20, None)], "doc_id long, text string")
    steps, write, drop, verify = [], minhash_dedup.stored, minhash_dedup.forget, minhash_dedup.verified
    monkeypatch.setattr(minhash_dedup, "stored", lambda df, name: steps.append(name) or write(df, name))
    monkeypatch.setattr(minhash_dedup, "forget", lambda df: steps.append("forget") or drop(df))
    monkeypatch.setattr(minhash_dedup, "verified", lambda *x: steps.append("verified") or verify(*x))
    got = {r["doc_id"]: (r["group_id"], r["n_copies"]) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {i: (i // 2 * 2, 2) for i in range(20)} | {20: (20, 1)}
    assert steps.index("forget") < steps.index("verified")
    assert "parts" not in steps
