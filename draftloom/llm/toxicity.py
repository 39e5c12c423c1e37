"""Toxicity by maximum-scoring segments.

Tokens score by log-odds of toxic against clean documents under a chain of Dirichlet priors: a word's
prior is the posterior of its first five letters, theirs is that of the first four, and so on to even
odds; PRIOR documents' weight each. A drift, the same for all, makes clean tokens negative on
average. One scan, linear
in the text, then finds all maximal-scoring segments (every passage that no longer or shorter one
beats). Segment scores are put in terms of chance by the extreme-value law: of n clean tokens,
P(best >= s) = 1 - exp(-K n exp(-lambda s)); lambda solves the moment equation of the clean token
scores, K is fitted to clean documents' best segments. A document's evidence is the chance of its
best segment and the number of passages significant on their own; a logistic curve fitted on labelled
documents that the tokens were not counted on turns that into a score.

Learning uses a bounded sample of the labelled rows outside the held-out fold (TOXIC and CLEAN in
expectation), half for the tokens and half for the curve. Every document is scored whole.

Cases: a null or empty text has the score of no evidence; without labels of both kinds every score is
0; a label other than 0 and 1 (null too) doesn't count, of several for a document the highest counts; a null doc_id
has no label; repeated rows get equal scores. Columns of other names are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, stored, tidy

#: Labelled documents learned from, in expectation.
TOXIC, CLEAN = 3000, 6000
#: The drift was chosen on labelled rows outside of the held-out fold.
PRIOR, DRIFT, STEMS = 4.0, 2.0, (5, 4)
#: Documents of the sample's half that a unit is in, at least, to have counts of its own.
SEEN = 2
#: Words whose scores a worker remembers at a time.
REMEMBERED = 300_000

_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


class Scores(dict):
    """Score by word: its own, else its longest known beginning's, else that of an unseen word: even odds less the drift."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        super().__init__()
        self.words, self.stems = words, stems

    def __missing__(self, word: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        score = self.words.get(word)
        if score is None:
            score = next((self.stems[word[:k]] for k in STEMS if len(word) > k and word[:k] in self.stems), -DRIFT)
        self[word] = score
        return score


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), by Ruzzo and Tompa's scan; linear in the scores.

    Runs of one sign count as one step: a maximal segment holds a positive run whole.
    """
    positive = scores > 0
    if not positive.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[False], positive, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # start, end, sum before, sum after, last with a smaller sum before
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        now = [s, e, total[s], total[e]]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= now[3]:
                found.append([*now, j])
                break
            now = [found[j][0], now[1], found[j][2], now[3]]
            del found[j:]
    return [(s, e, float(b - a)) for s, e, a, b, _ in found]


def evidence(text: str | None, scores: Scores, law: tuple[float, float]) -> tuple[float, int, list[tuple[int, int, float]]]:
    """-log of the chance of the best segment, the number of significant ones, and those."""
    t = tokens(text)
    if not t:
        return 0.0, 0, []
    found = segments(np.fromiter(map(scores.__getitem__, t), np.float64, len(t)))
    if not found:
        return 0.0, 0, []
    rate, k = law
    expected = lambda s: k * len(t) * math.exp(-rate * s)
    best = expected(max(s for _, _, s in found))
    significant = [x for x in found if expected(x[2]) < 0.05]
    return min(60.0, -math.log(max(1e-300, -math.expm1(-best)))), len(significant), significant


def logit(q: float) -> float:
    return math.log(q / (1 - q))


def rate_of(values: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of E exp(rate x) = 1, for scores of negative mean."""
    p = weight / weight.sum()
    low, high = 1e-3, 1.0
    while (p * np.exp(high * values)).sum() < 1 and high < 50:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * values)).sum() < 1 else (low, mid)
    return low


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> dict | None:
    spark = docs.sparkSession
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    n = dict(known.groupBy("toxic").count().collect())
    if not n.get(0) or not n.get(1):
        return None
    luck = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) / (1 << 20)
    chosen = known.where(luck < F.when(F.col("toxic") == 1, min(1.0, toxic / n[1])).otherwise(min(1.0, clean / n[0])))
    chosen = chosen.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2)).cast("int"))
    picked = spark.createDataFrame(chosen.collect(), chosen.schema)  # TOXIC + CLEAN rows in expectation
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("toxic", "half", "text")

    def units(batches):
        import pyarrow as pa

        seen: tuple[Counter, Counter] = (Counter(), Counter())
        docs_of = [0, 0]
        for batch in batches:
            for y, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = set(tokens(text))
                docs_of[y] += 1
                seen[y].update(words)
                for k in STEMS:
                    seen[y].update({f"{w[:k]}*" for w in words if len(w) > k})
        seen[0][""], seen[1][""] = docs_of
        keys = list(seen[0].keys() | seen[1].keys())
        for s in range(0, len(keys), 10_000):
            part = keys[s : s + 10_000]
            yield pa.record_batch({"unit": pa.array(part, pa.string()), "clean": pa.array([seen[0][k] for k in part], pa.int64()), "toxic": pa.array([seen[1][k] for k in part], pa.int64())})

    counted = sample.where("half = 0").select("toxic", "text").mapInArrow(tidy(units), "unit string, clean long, toxic long").groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = stored(counted, "units")
    got = {r["unit"]: (r["clean"], r["toxic"]) for r in counted.where(f"clean + toxic >= {SEEN}").collect()}  # units of the sample's half: at most its words over SEEN
    n0, n1 = got.pop("", (0, 0))
    if not n0 or not n1:
        return None

    def posterior(unit: str, above: float) -> float:
        c, t = got.get(unit, (0, 0))
        c = c * n1 / n0 if n0 > n1 else c  # as if there were as many clean documents
        t = t * n0 / n1 if n1 > n0 else t
        return (t + PRIOR * above) / (c + t + PRIOR)

    def chain(word: str) -> float:
        q = 0.5
        for k in reversed(STEMS):
            if len(word) > k:
                q = posterior(f"{word[:k]}*", q)
        return q

    stems = {}
    for unit in got:
        if unit.endswith("*"):
            stem = unit[:-1]
            q = posterior(unit, posterior(f"{stem[: STEMS[1]]}*", 0.5) if len(stem) > STEMS[1] else 0.5)
            stems[stem] = logit(q) - DRIFT
    words = {u: logit(posterior(u, chain(u))) - DRIFT for u in got if not u.endswith("*")}
    shared = spark.sparkContext.broadcast((words, stems))

    def best(batches):
        import pyarrow as pa

        scores = Scores(*shared.value)
        for batch in batches:
            rows = []
            for y, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                x = [scores[t] for t in tokens(text)]
                found = segments(np.array(x)) if x else []
                values, times = np.unique(np.round(x, 2), return_counts=True) if x and not y else (np.zeros(0), np.zeros(0))
                rows.append((y, len(x), [s for _, _, s in found], values.tolist(), times.astype(float).tolist()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), *[pa.list_(pa.float64())] * 3), strict=True)], names=["toxic", "n", "segments", "x", "times"])

    rows = sample.where("half = 1").select("toxic", "text").mapInArrow(tidy(best), "toxic int, n long, segments array<double>, x array<double>, times array<double>").collect()  # the sample's other half
    rows.sort(key=lambda r: (r["toxic"], r["n"], r["segments"]))
    hist: Counter = Counter()
    for r in rows:
        for v, t in zip(r["x"], r["times"], strict=True):
            hist[v] += t
    if not hist or not any(r["toxic"] for r in rows):
        return None
    values = np.array(sorted(hist))
    rate = rate_of(values, np.array([hist[v] for v in values])) if values.max() > 0 else 1.0
    calm = [(r["n"], max(r["segments"], default=0.0)) for r in rows if not r["toxic"] and r["n"]]
    k = (len(calm) / max(1e-9, sum(m * math.exp(-rate * s) for m, s in calm))) if calm else 1.0
    law = (rate, k)

    def facts(m: int, found: list[float]) -> list[float]:
        if not found:
            return [0.0, 0.0]
        expected = [k * m * math.exp(-rate * s) for s in found]
        return [min(60.0, -math.log(max(1e-300, -math.expm1(-min(expected))))), math.log1p(sum(e < 0.05 for e in expected))]

    x = np.array([facts(r["n"], r["segments"]) for r in rows])
    y = np.array([float(r["toxic"] == 1) for r in rows])
    share = n[1] / (n[0] + n[1])
    weight = np.where(y > 0, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    return {"words": words, "stems": stems, "law": law, "curve": curve(x, y, weight).tolist()}


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights and intercept of a logistic curve by Newton's method, with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (weight * (p - y)) + 0.1 * w)
        w = w - step * min(1.0, 5 / (1e-9 + np.abs(step).max()))
    return w


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with score, n_passages and passages (first token, end, score) that are significant."""
    from pyspark.sql import types as T

    docs = docs.drop("score", "n_passages", "passages")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        model = shared.value
        scores = Scores(model["words"], model["stems"]) if model else None
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            out, lists = [], []
            for text in batch.column("text").to_pylist():
                if scores is None:
                    out.append((0.0, 0))
                    lists.append([])
                    continue
                x, n, found = evidence(text, scores, model["law"])
                a, b, c = model["curve"]
                out.append((1 / (1 + math.exp(-max(-500, min(500, a * x + b * math.log1p(n) + c)))), n))
                lists.append([{"start": s, "end": e, "score": v} for s, e, v in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _ in out], pa.float64()), pa.array([n for _, n in out], pa.int32()), pa.array(lists, kind)], names=[*batch.schema.names, "score", "n_passages", "passages"])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.IntegerType()), T.StructField("passages", T.ArrayType(passage))]))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    found = score(docs.withColumn("held_out", held_out()), model)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")
