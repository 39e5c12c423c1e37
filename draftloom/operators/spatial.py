"""Proximity joins by equal cells: a side is put in the cells it touches, pairs meet in a cell.

The plain form of such a join compares all pairs of a page. Here pages, cells and residual tests bound
each comparison, and the equal part of the condition lets Spark deal, spill and split hot keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components, written


def cells(low: Column, high: Column, size: float) -> Column:
    """Numbers of the cells that an interval touches."""
    return F.sequence(F.floor(low / size), F.floor(high / size))


def band_join(a: DataFrame, b: DataFrame, keys: list[str], coord: str, reach: float, prefix: tuple[str, str] = ("a_", "b_")) -> DataFrame:
    """Pairs with equal keys and coordinates at most reach apart; columns of the sides get prefixes.

    b is put in its own band and both neighbours; a pair meets in a's band alone, so just once.
    """
    left = a.select(*(F.col(c).alias(prefix[0] + c) for c in a.columns)).withColumn("band", F.floor(F.col(prefix[0] + coord) / reach))
    right = b.select(*(F.col(c).alias(prefix[1] + c) for c in b.columns))
    at = F.floor(F.col(prefix[1] + coord) / reach)
    right = right.withColumn("band", F.explode(F.array(at - 1, at, at + 1)))
    on = (left["band"] == right["band"]) & (F.abs(F.col(prefix[0] + coord) - F.col(prefix[1] + coord)) <= reach)
    for k in keys:
        on = on & (F.col(prefix[0] + k) == F.col(prefix[1] + k))
    return left.join(right, on).drop("band")


def grid_join(a: DataFrame, b: DataFrame, size: float, reach: float = 0.0, prefix: tuple[str, str] = ("a_", "b_")) -> DataFrame:
    """Pairs of boxes (page, x, y, w, h) on a page whose boxes, a's grown by reach, touch.

    Both sides go to the cells they touch; of the cells that a pair shares, only the one with the
    corner of their overlap counts, so no pair comes twice and nothing need be made distinct.
    """
    p, q = prefix
    left = a.select(*(F.col(c).alias(p + c) for c in a.columns))
    right = b.select(*(F.col(c).alias(q + c) for c in b.columns))
    lx, ly, lX, lY = F.col(p + "x") - reach, F.col(p + "y") - reach, F.col(p + "x") + F.col(p + "w") + reach, F.col(p + "y") + F.col(p + "h") + reach
    rx, ry, rX, rY = F.col(q + "x"), F.col(q + "y"), F.col(q + "x") + F.col(q + "w"), F.col(q + "y") + F.col(q + "h")
    left = left.withColumn("gx", F.explode(cells(lx, lX, size))).withColumn("gy", F.explode(cells(ly, lY, size)))
    right = right.withColumn("hx", F.explode(cells(rx, rX, size))).withColumn("hy", F.explode(cells(ry, rY, size)))
    touch = (lx <= rX) & (rx <= lX) & (ly <= rY) & (ry <= lY)
    own = (F.floor(F.greatest(lx, rx) / size) == F.col("gx")) & (F.floor(F.greatest(ly, ry) / size) == F.col("gy"))
    on = (F.col(p + "page") == F.col(q + "page")) & (F.col("gx") == F.col("hx")) & (F.col("gy") == F.col("hy"))
    return left.join(right, on).where(touch & own).drop("gx", "gy", "hx", "hy")


def touching(boxes: DataFrame, reach: float, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """boxes (id, x, y, w, h, keys) with component: the least id among boxes of equal keys that touch within reach, alone or by way of others.

    No pair is listed, so crowded places cost no more than others. Boxes in one cell of size reach touch, so a
    cell goes by its least id; what remains is whether cells side by side, or at a corner, have boxes that touch.
    """
    keys, at = list(keys), [*keys, "gx", "gy"]
    ends = boxes.select("id", *keys, "x", "y", (F.col("x") + F.col("w")).alias("xe"), (F.col("y") + F.col("h")).alias("ye"))
    dealt = ends.withColumn("gx", F.explode(cells(F.col("x"), F.col("xe"), reach))).withColumn("gy", F.explode(cells(F.col("y"), F.col("ye"), reach)))
    # What lies beyond a cell's own sides makes no difference there.
    parts = dealt.groupBy(*at, F.greatest("x", F.col("gx") * reach).alias("x"), F.least("xe", (F.col("gx") + 1) * reach).alias("xe")).agg(F.min("y").alias("y"), F.max("ye").alias("ye"), F.min("id").alias("name"))
    parts = written(parts, "parts")
    each = written(parts.groupBy(*at).agg(F.min("name").alias("name"), F.min("x").alias("x"), F.max("xe").alias("xe"), F.min("y").alias("y"), F.max("ye").alias("ye")), "cells")

    def beside(dx: int, dy: int, low: str, high: str) -> DataFrame:
        other = each.select(*keys, (F.col("gx") - dx).alias("gx"), (F.col("gy") - dy).alias("gy"), F.col("name").alias("b"), F.col(low).alias("low"))
        return each.join(other, at).where(F.col("low") - reach <= F.col(high)).select(F.col("name").alias("a"), "b")

    # Cells that meet in a corner: u and v are how far the left one's boxes come towards it, and how far they must come.
    def corner(left: bool, down: bool, rising: bool) -> Column:
        along, up = (F.col("xe") if left else F.col("x") - reach), (F.col("ye") if down else F.col("y") - reach)
        return F.struct((F.col("gx") + int(left)).alias("cx"), (F.col("gy") + int(down)).alias("cy"), F.lit(rising).alias("rising"), F.lit(left).alias("is_left"), along.alias("u"), (up if rising else -up).alias("v"))

    named = parts.drop("name").join(each.select(*at, "name"), at)
    four = named.select(*keys, "name", F.explode(F.array(corner(True, True, True), corner(False, False, True), corner(True, False, False), corner(False, True, False))).alias("c")).select(*keys, "name", "c.*")
    where = [*keys, "cx", "cy", "rising"]
    best = four.groupBy(*where, "is_left", "u").agg(F.when(F.col("is_left"), F.max("v")).otherwise(F.min("v")).alias("v"), F.min("name").alias("name"))
    upto = Window.partitionBy(*where).orderBy(F.desc("u"), F.desc("is_left")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = best.withColumn("most", F.max(F.when(F.col("is_left"), F.col("v"))).over(upto))
    met = met.groupBy(*where).agg(F.min(F.when(F.col("is_left"), F.col("name"))).alias("a"), F.min(F.when(~F.col("is_left"), F.col("name"))).alias("b"), F.max(~F.col("is_left") & (F.col("v") <= F.col("most"))).alias("met"))
    links = beside(1, 0, "x", "xe").unionByName(beside(0, 1, "y", "ye")).unionByName(met.where("met").select("a", "b"))
    found = connected_components(links)
    of = each.join(found, each["name"] == found["node"], "left").select(*(F.col(k).alias("__" + k) for k in at), F.coalesce("component", "name").alias("component"))
    here = F.floor(F.col("x") / reach), F.floor(F.col("y") / reach)
    on = (here[0] == F.col("__gx")) & (here[1] == F.col("__gy"))
    for k in keys:
        on = on & (F.col(k) == F.col("__" + k))
    return boxes.join(of, on, "left").select(*boxes.columns, F.coalesce("component", "id").alias("component"))


def nearest(a: DataFrame, b: DataFrame, radius: float, k: int, distance: Column, key: str = "id", prefix: tuple[str, str] = ("a_", "b_")) -> DataFrame:
    """For each row of a the k nearest boxes of b within radius, ranked; ties by b's key.

    distance: of the prefixed boxes, none where they overlap. Boxes in one place go as one, with the k of least key. The
    radius starts where b's density has some k boxes and doubles: who has k within it is done, since all others are further.
    """
    p, q = prefix
    box, rest = ["page", "x", "y", "w", "h"], [c for c in b.columns if c not in ("page", "x", "y", "w", "h", key)]
    least = b.withColumn("__n", F.row_number().over(Window.partitionBy(*box).orderBy(key))).where(F.col("__n") <= k)
    places = written(least.groupBy(*box).agg(F.sort_array(F.collect_list(F.struct(key, *rest))).alias("all")).withColumn("first", F.col("all")[0][key]), "places")
    of_page = places.groupBy("page").agg(F.sum(F.size("all")).alias("n"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))
    room = of_page.agg(F.sum("n").alias("n"), F.sum("area").alias("area")).first()
    start = math.sqrt(4 * k * (room["area"] or 0) / (math.pi * room["n"])) if room["n"] else radius
    reach = radius / 2 ** max(0, min(6, math.floor(math.log2(radius / start)) if start else 6))
    mine, left, done = Window.partitionBy(p + key), a, None
    while True:
        near = grid_join(left, places, max(reach, 8.0), reach, prefix).withColumn("distance", F.round(distance, 6)).where(F.col("distance") <= reach)
        near = near.withColumn("rank", F.row_number().over(mine.orderBy("distance", q + "first"))).where(F.col("rank") <= k)
        near = near.withColumn("__b", F.explode(q + "all")).drop(q + "all", q + "first", "rank").withColumns({q + c: F.col("__b")[c] for c in (key, *rest)}).drop("__b")
        near = near.withColumn("rank", F.row_number().over(mine.orderBy("distance", q + key))).where(F.col("rank") <= k)
        if reach >= radius:
            return near if done is None else done.unionByName(near)
        full = written(near.withColumn("__n", F.count(F.lit(1)).over(mine)).where(F.col("__n") == k).drop("__n"), "nearest")
        left = left.join(full.where("rank = 1").select(F.col(p + key).alias("__done")), F.col(key).eqNullSafe(F.col("__done")), "left_anti")
        done = full if done is None else done.unionByName(full)
        reach = min(radius, 2 * reach)
