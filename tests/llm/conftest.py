from __future__ import annotations

import random

import pytest

WORDS = "the house on a hill was old and nobody in town could say who had built it or why its windows faced north river stone bridge market light garden winter letter harbour engine quiet morning copper field".split()


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def edges(spark):
    """Documents with nulls in every column, blanks, copies, a very long text, and columns of clashing names."""
    long = prose(30_000, 5)
    rows = [
        (1, prose(80, 1), "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \n\t ", "de", "b"), (None, prose(60, 2), "en", "a"), (5, prose(80, 1), None, "b"), (6, long, "en", "a"),
        (7, "12345", "en", "c"), (8, prose(80, 1), "en", "a"), (8, prose(80, 1), "en", "a"), (9, "é😀 ümlaut a@b.co 10.0.0.1", "de", None), (10, prose(80, 1) + " end", "en", "b"), (None, None, None, None),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, key string, group_id string, spans string, kept string, draw string, n string, bin string, target string, shard string, slot string, of string, bucket string"
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["x"] * 14) for r in rows], schema)


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)
