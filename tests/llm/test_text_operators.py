"""Toxicity, personal data, quality rules, language: against brute force, on held-out rows, on odd input."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from draftloom.llm import language_id, pii, quality_rules, toxicity
from draftloom.llm.registry import ORACLES
from tests.conftest import SMALL
from tests.helpers import same

from .conftest import prose

SF = "/root/testdata/sf0.01"


def brute_segments(x, lo=0):
    """The best segment, then those left and right of it: the definition of all maximal segments."""
    best, at = 0.0, None
    for i in range(len(x)):
        total = 0.0
        for j in range(i, len(x)):
            total += x[j]
            if total > best + 1e-12:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    i, j = at
    return [*brute_segments(x[:i], lo), (lo + i, lo + j, best), *brute_segments(x[j:], lo + j)]


def test_segments_are_all_maximal_ones():
    rng = np.random.default_rng(1)
    for n in range(1, 60):
        x = rng.normal(-0.3, 1, n)
        got, want = sorted(toxicity.segments(x)), sorted(brute_segments(list(x)))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_rate_solves_the_moment_equation():
    values, weight = np.array([-1.0, 1.0]), np.array([0.75, 0.25])
    rate = toxicity.rate_of(values, weight)
    assert abs((weight * np.exp(rate * values)).sum() - 1) < 1e-6


def test_toxicity_finds_planted_passages(spark):
    bad = "scum vermin filth"
    docs = [(i, prose(60, i) + (f" {bad} " * 2 if i % 5 == 0 else " ") + prose(40, i + 999)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(frame, labels)
    new = spark.createDataFrame([(1, prose(90, 7000)), (2, prose(30, 7001) + " vermin scum filth scum " + prose(30, 7002)), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(new, model).collect()}
    assert got[1]["score"] < 0.5 and got[3]["score"] < 0.5 and got[2]["score"] > 0.5
    p = got[2]["passages"][0]
    assert new.collect()[1]["text"].split()[p["start"] : p["end"]] == ["vermin", "scum", "filth", "scum"]


def test_toxicity_on_odd_input(spark, edges, empty):
    labels = spark.createDataFrame([(1, 1), (1, None), (6, 0), (None, 1)], "doc_id long, toxic int")
    for docs in (edges, empty):
        for known in (labels, labels.limit(0)):
            rows = toxicity.score(docs, toxicity.train(docs, known)).collect()
            assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)


def rules(text):
    """The base patterns as they stand."""
    def luhn(d):
        s = [int(c) for c in d[::-1]]
        return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0

    digits = lambda m: re.sub(r"[^0-9]", "", m)
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0])]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("a1.@+- (0)52%_x9é") for _ in range(rng.randrange(60)))
        assert sorted(pii.base_spans(text)) == sorted(rules(text)), text
    for text in ("+1 (555) 123-4567 4111 1111 1111 1111 10.0.0.256 1.2.3.4.5.6.7.8 a@b.c@d.e", "@" * 50 + "a@b.co", "1." * 40):
        assert sorted(pii.base_spans(text)) == sorted(rules(text))


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in pii.new_weights().items()}
    x, y = rng.integers(0, 98, (3, 9)), np.zeros((3, 9), int)
    y[0, 2:5], y[1, 4:6] = (1, 2, 2), (3, 4)

    def loss(q):
        em = pii.forward(q, x).astype(np.float64)
        _, _, z = pii.crf_marginals(em, q)
        tr, st = np.where(pii.ALLOWED, q["T"], -30), np.where(pii.STARTS, q["S"], -30)
        path = sum(em[n, np.arange(9), y[n]].sum() + st[y[n, 0]] + tr[y[n, :-1], y[n, 1:]].sum() for n in range(3))
        return (z.sum() - path) / 3

    g = pii.gradients(p, x, y)
    for name in ("V", "T", "Uf", "Wb", "bf", "E"):
        at = tuple(rng.integers(0, s) for s in p[name].shape) if name != "T" else (1, 2)
        at = (x[0, 3], 2) if name == "E" else at
        up, down = ({**p, name: p[name].copy()} for _ in range(2))
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        assert abs((loss(up) - loss(down)) / 2e-3 - g[name][at]) < 2e-3, name


def test_decoding_is_the_best_path():
    rng = np.random.default_rng(2)
    p = {"T": rng.normal(size=(pii.TAGS, pii.TAGS)), "S": rng.normal(size=pii.TAGS)}
    em = rng.normal(size=(4, pii.TAGS))
    tr, st = np.where(pii.ALLOWED, p["T"], -1e4), np.where(pii.STARTS, p["S"], -1e4)
    paths = np.stack(np.meshgrid(*[range(pii.TAGS)] * 4, indexing="ij"), -1).reshape(-1, 4)
    totals = em[np.arange(4), paths].sum(1) + st[paths[:, 0]] + tr[paths[:, :-1], paths[:, 1:]].sum(1)
    assert (pii.decode(em, p) == paths[totals.argmax()]).all()
    many = [rng.normal(size=(n, pii.TAGS)).astype(np.float32) for n in (4, 1, 70, 7, 7, 300, 2)]
    p = {k: v.astype(np.float32) for k, v in p.items()}
    assert all((pii.decode(e, p) == y).all() for e, y in zip(many, pii.decode_many(many, p), strict=True))


@pytest.fixture(scope="module")
def personal(spark):
    rng = random.Random(4)
    docs = []
    for i in range(900):
        kind = (f"user{i}.x@mail{i % 7}.example.org", f"{i % 250}.{i % 99}.7.{i % 31}", f"+1 555 {100 + i % 900} {1000 + i}", "4111 1111 1111 1111")[i % 4]
        docs.append((i, f"{prose(rng.randrange(3, 20), i)} {kind} {prose(rng.randrange(3, 20), i + 5000)}"))
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_network_adds_what_rules_miss_and_keeps_base_spans(spark, personal):
    model = pii.train(personal)
    texts = [f"{prose(6, i)} user{i}.y [at] nothing {prose(5, i)}" if i % 2 else f"{prose(6, i)} someone{i} @ mail{i % 7}.example.org {prose(5, i)}" for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = pii.find(docs, model).collect()
    hits = sum(bool(r["spans"]) for r in found if r["doc_id"] % 2 == 0)
    assert hits >= 15  # of 20 written with blanks around the @
    kept = pii.find(personal, model).where("exists(base_spans, b -> not array_contains(spans, b))")
    assert kept.isEmpty()


def test_personal_data_on_odd_input(spark, edges, empty, personal):
    long = spark.createDataFrame([(1, prose(20_000, 1) + " a@b.co " + prose(20_000, 2) + " 10.1.2.3")], "doc_id long, text string")
    assert [len(r["base_spans"]) for r in pii.find(long, pii.train(personal)).collect()] == [2]
    for docs in (edges, empty):
        out = pii.redact(docs)
        assert out.columns == docs.columns and out.count() == docs.count()
    nine = {r["doc_id"]: r["text"] for r in pii.redact(edges).collect()}[9]
    assert nine == "é😀 ümlaut <email> <ip>"


def test_op2_digests(spark):
    got = {r["doc_id"]: r for r in pii.op2_pii(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        spans = sorted(rules(r["text"]))
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        g = got[r["doc_id"]]
        assert [g["n_email"], g["n_ip"], g["n_card"], g["n_phone"]] == [sum(k == i for k, *_ in spans) for i in range(4)]
        assert g["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(g["spans"].split(","))


def figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams: dict = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_quality_figures_equal_brute_force(spark, edges):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("a b c dd | # é😀".split()) for _ in range(rng.randrange(90))).replace("dd", "dd\n") for _ in range(300)] + ["a a a a a", "x\n\nx\n \nx", None, ""]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, domain string")
    for frame in (docs, edges.withColumnRenamed("source", "domain")):
        for r in quality_rules.judge(frame).join(frame.select("doc_id", "text"), "doc_id").collect():
            want = figures(r["text"])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_hosts_of_failing_documents_go_whole(spark):
    good, bad = prose(70, 1), prose(70, 2) + " | " * 40
    rows = [(i, prose(70, i) if i % 10 else bad, "fine") for i in range(200)] + [(1000 + i, bad if i % 20 else good, "spam") for i in range(200)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, domain string")).collect()}
    assert kept[1] and not kept[10] and not kept[1000] and not kept[1001]


def test_quality_on_odd_input(spark, edges, empty):
    for docs in (edges, empty):
        assert quality_rules.judge(docs.withColumnRenamed("source", "domain")).count() == docs.count()


def test_quality_query_equals_its_sql(spark):
    same(quality_rules.op7_quality_rules(spark, SMALL), ORACLES["op7_quality_rules"], SMALL)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.op8_language_id(spark, SF).join(docs, "doc_id").where("held_out and lang is not null").selectExpr("avg(cast(lang_pred = lang as double)) a", "count(*) n").first()
    assert got["n"] > 50 and got["a"] >= 0.95


def test_language_hierarchy_and_ties():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(60, 8)) * 0.1 + np.eye(8)[k] for k in range(3)]).astype(np.float32)
    model = language_id.fit(x, ["en"] * 60 + ["de"] * 60 + ["fr"] * 60)
    assert len(model["families"]) == 2 and len(model["pairs"]) == 1  # germanic, romance
    assert [language_id.predict(model, np.eye(8, dtype=np.float32)[k])[0] for k in range(3)] == ["en", "de", "fr"]


def test_language_on_odd_input(edges, empty):
    for docs in (edges, empty):
        rows = language_id.identify(docs, language_id.train(docs)).collect()
        assert len(rows) == docs.count()
        assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or "")) for r in rows)
        kept = language_id.keep_known(docs)
        assert kept.columns == docs.columns and kept.count() <= docs.count()
