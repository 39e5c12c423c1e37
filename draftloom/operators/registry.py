"""Queries by name: (spark, sf_dir) -> DataFrame, their DuckDB SQL, and what they cover."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..plans import view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}
_FRAMES: dict[str, Callable] = {}


def both(name: str, covers: str, text: str) -> None:
    """An operator of one text for both engines: relational algebra over plan tables in braces."""
    _FRAMES[name] = lambda load: view.over(load, text)
    QUERIES[name] = lambda spark, sf_dir: view.sql(spark, sf_dir, text)
    ORACLES[name] = view.duck(text)
    COVERS[name] = covers.split()


def query(name: str, covers: str, oracle: str | None = None):
    """An operator by DataFrame functions of load(table name) -> DataFrame; oracle: the plain SQL form."""

    def register(f):
        _FRAMES[name] = f
        QUERIES[name] = lambda spark, sf_dir: f(lambda n: view.frame(spark, sf_dir, n))
        if oracle is not None:
            ORACLES[name] = view.duck(oracle)
        COVERS[name] = covers.split()
        return f

    return register


class Side(NamedTuple):
    """A table of a near join: as it is, and with the cells that its rows touch."""

    plain: str
    dealt: str
    cells: tuple[str, ...]


def side(source: str | tuple[str, str], size: float, **cells: str | tuple[str, str]) -> Side:
    """source with cells of size by name: a row is in the one of a place, or in all that an interval (low, high) touches.

    Of two sides that meet in a cell name at most one may have an interval there, so that a pair meets once.
    A place that starts with "=" is the cells themselves. Null places are in no cell; the row stays.
    """
    plain, dealt = source if isinstance(source, tuple) else (source, source)
    for name, at in cells.items():
        low, high = at if isinstance(at, tuple) else (at, at)
        cell = low[1:] if low[0] == "=" else f"explode_outer(sequence(floor(({low}) / {size}), floor(({high}) / {size})))" if isinstance(at, tuple) else f"floor(({at}) / {size})"
        dealt = f"(SELECT *, {cell} AS in_{name} FROM {dealt} s_)"
    return Side(plain, dealt, tuple(cells))


def near_texts(text: str, **by: Side | tuple[str, str]) -> tuple[str, str]:
    """The plain SQL of a near join, and the one dealt by cells: [a] is a side, [a=b] their condition; a pair of texts stands for itself."""
    met = lambda m: f"{m[1]}.page = {m[2]}.page"
    dealt_met = lambda m: met(m) + "".join(f" AND {m[1]}.in_{c} = {m[2]}.in_{c}" for c in by[m[1]].cells if c in by[m[2]].cells)
    plain, dealt = re.sub(r"\[(\w+)=(\w+)\]", met, text), re.sub(r"\[(\w+)=(\w+)\]", dealt_met, text)
    for n, s in by.items():
        as_ = f" {n}" if isinstance(s, Side) else ""
        plain, dealt = plain.replace(f"[{n}]", s[0] + as_), dealt.replace(f"[{n}]", s[1] + as_)
    return plain, dealt


def near(name: str, covers: str, text: str, **by: Side | tuple[str, str]) -> None:
    """A near join that Spark runs by cells and DuckDB by comparing all rows of a page."""
    plain, dealt = near_texts(text, **by)
    query(name, covers, plain)(lambda load: view.over(load, dealt))


def apply(name: str, **tables: DataFrame) -> DataFrame:
    """The operator over one's own plan tables, instead of the driver's."""
    return _FRAMES[name](view.loader(tables))
