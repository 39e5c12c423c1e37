"""Language identification by hierarchical discrimination.

First a linear machine for each family picks the language family, then, inside a family of several
languages, one-versus-one linear support vector machines vote for the language (a tie goes to the
larger sum of margins, then to the first name). Features: square roots of hashed counts of one to
three letters with word edges, over the whole text, scaled to length 1.

Learning uses a bounded sample of the labelled rows outside the held-out fold: SAMPLE rows in all,
dealt evenly over the languages, chosen by hash of text and doc_id. Everything else covers all rows.

Cases: a text that is null or has no letter is `und` with score 0, also where nothing was learned;
a null lang is never learned from; a null doc_id counts as the empty text in the fold; repeated
rows get equal answers. Input columns named lang_pred or score are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hand_back, held_out, tidy

#: Rows learned from, in all.
SAMPLE = 3000
DIM = 1 << 12
#: Families by ISO 639-1 code; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk".split(),
    "indic": "hi bn ur mr gu pa ne".split(),
    "turkic": "tr az kk uz ky tt".split(),
    "uralic": "fi et hu".split(),
    "sinitic": "zh yue".split(),
    "semitic": "ar he mt am".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_alpha: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _alpha
    if _alpha is None:
        _alpha = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.bool_)
    return _alpha


def features(text: str | None) -> np.ndarray | None:
    """DIM numbers; None if text has no letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = letters()[c]
    if not keep.any():
        return None
    c = np.concatenate([[0], np.where(keep, c, 0), [0]]).astype(np.uint32)
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]  # one gap between words
    a, b, d = c[:-2], c[1:-1], c[2:]
    one = b * np.uint32(0x9E3779B1)
    two = one ^ ((d + np.uint32(1)) * np.uint32(0x85EBCA77))
    three = two ^ ((a + np.uint32(3)) * np.uint32(0xC2B2AE3D))
    shift = np.uint32(20)
    x = np.zeros(DIM)
    for h, salt in ((one, 1), (two, 2), (three, 3)):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * salt)
        x += np.bincount((h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39) >> shift, minlength=DIM)
    x = np.sqrt(x)
    return (x / np.sqrt((x * x).sum())).astype(np.float32)


def support_vector_machine(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weights and bias (last; x has ones there) that minimise squared hinge loss, classes balanced; y is -1 or 1."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    rate = 1 / (2 * float((share * np.einsum("ij,ij->i", x, x)).sum()) + reg)
    for t in range(rounds):  # accelerated gradient
        miss = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (reg * v - 2 * x.T @ (share * y * miss))
        v = new + (t / (t + 3)) * (new - w)
        w = new
    return w


def fit(x: np.ndarray, langs: list[str]) -> dict:
    """The machines learned from features x."""
    return machines(np.hstack([x, np.ones((len(x), 1), np.float32)]), langs)


def machines(x: np.ndarray, langs: list[str]) -> dict:
    """The machines: one against the rest by family, one against one inside a family; the last column of x is ones."""
    names = sorted(set(langs))
    families = sorted({FAMILY_OF.get(n, f"only {n}") for n in names})
    of = np.array([families.index(FAMILY_OF.get(n, f"only {n}")) for n in langs])
    lang = np.array([names.index(n) for n in langs])
    model = {"names": names, "families": [[i for i, n in enumerate(names) if FAMILY_OF.get(n, f"only {n}") == f] for f in families]}
    model["top"] = np.stack([support_vector_machine(x, np.where(of == k, 1, -1).astype(np.float32)) for k in range(len(families))]) if len(families) > 1 else None
    model["pairs"] = {}
    for members in model["families"]:
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                rows = (lang == a) | (lang == b)
                model["pairs"][a, b] = support_vector_machine(x[rows], np.where(lang[rows] == a, 1, -1).astype(np.float32))
    return model


def predict(model: dict, x: np.ndarray) -> tuple[str, float]:
    def sure(margin: float) -> float:
        return float(1 / (1 + np.exp(-4 * margin)))

    k, score = 0, 1.0
    if model["top"] is not None:
        m = model["top"][:, :-1] @ x + model["top"][:, -1]
        k = int(m.argmax())
        score = sure(float(m[k] - np.delete(m, k).max()) / 2)
    members = model["families"][k]
    if len(members) == 1:
        return model["names"][members[0]], score
    votes, margins, least = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0), dict.fromkeys(members, 9.0)
    for i, a in enumerate(members):
        for b in members[i + 1 :]:
            w = model["pairs"][a, b]
            m = float(w[:-1] @ x + w[-1])
            votes[a if m >= 0 else b] += 1
            for n, y in ((a, m), (b, -m)):
                margins[n] += y
                least[n] = min(least[n], y)
    best = max(members, key=lambda n: (votes[n], margins[n], -n))
    return model["names"][best], score * sure(least[best])


def train(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """A model from the labelled rows outside the held-out fold; None if there are none."""
    rows = docs.select("doc_id", "lang", "text").where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = dict(docs.select("doc_id", "lang").where(~held_out() & F.col("lang").isNotNull()).groupBy("lang").count().collect())
    if not counts:
        return None
    each = max(1, sample // len(counts))
    share = F.create_map(*(F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, each / n))))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)

    def vectors(batches):
        import pyarrow as pa

        for batch in batches:
            out = [(lang, x) for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True) if (x := features(t)) is not None]
            yield pa.record_batch({"lang": pa.array([k for k, _ in out], pa.string()), "x": pa.array([x.astype("<f2").tobytes() for _, x in out], pa.binary())})

    got = chosen.mapInArrow(tidy(vectors), "lang string, x binary").distinct().orderBy("lang", "x").collect()  # SAMPLE rows in expectation
    if not got:
        return None
    # Filled in place: the driver holds the sample once, and a machine's share of it.
    x, langs = np.ones((len(got), DIM + 1), np.float32), [r["lang"] for r in got]
    for i, r in enumerate(got):
        x[i, :-1] = np.frombuffer(r["x"], "<f2")
    del got
    model = machines(x, langs)
    del x
    hand_back()
    return model


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with lang_pred and score."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size for a set of languages

    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            out = [("und", 0.0) if model is None or (x := features(t)) is None else predict(model, x) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k for k, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql import types as T

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text", held_out().alias("held_out")), train(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame) -> DataFrame:
    """docs with lang as predicted, without those that have no letter or no language learned; other columns, whatever their names, stay."""
    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    found = identify(rows, train(docs)).where("lang_pred <> 'und'")
    return found.select(*(F.col("lang_pred").cast(t).alias(c) if c == "lang" else F.col(f"row.`{c}`") for c, t in docs.dtypes))
