"""Voronoi cells by spatial tiles: each cell from the points around its tile, and its corners proved against all others.

The box of all points is cut into 4 ** level square tiles, at a level for each place: the coarsest at which a tile and
the eight around it hold at most `most` points of the group, so dense places have small tiles and no task has more points
at once. A point's cell is cut out of the box by the bisectors to the points of these nine tiles. It is certain if no point
outside them can be near enough. A cell that isn't is proved corner by corner: a corner is right if no point of the group
is nearer to it than the cell's own. The nearest such point of each corner is looked up by a join on tiles as wide as
the circle around the corner, cuts the cell, and new corners are looked up in the next round, until none has such a point.

Points at one place have the same cell. Points without both coordinates, groups of fewer than two points, and cells of
fewer than three corners are left out; more than `most` points within a 2 ** 24th of the box's sides are an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvan.session import cut

MOST_LEVELS = 24
#: Points of the nine tiles around a tile, on which its cells are worked out at once.
MOST_POINTS = 1_024
#: A corner's circle is taken this much smaller, so that rounding proves nothing wrong.
SLACK = 1 - 1e-9

Polygon = list[tuple[float, float]]


def clip(polygon: Polygon, p: np.ndarray, q: np.ndarray) -> Polygon:
    """The part of a convex polygon that is no nearer to q than to p."""
    mid, normal = (p + q) / 2, q - p
    side = [(x - mid[0]) * normal[0] + (y - mid[1]) * normal[1] for x, y in polygon]
    out = []
    for k, a in enumerate(polygon):
        m = (k + 1) % len(polygon)
        if side[k] <= 0:
            out.append(a)
        if side[k] * side[m] < 0:
            t = side[k] / (side[k] - side[m])
            b = polygon[m]
            out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
    return out


def reach(polygon: Polygon, p: np.ndarray) -> float:
    """The distance from p within which a point must lie to cut the polygon: twice that to its farthest corner."""
    return 2 * max((np.hypot(x - p[0], y - p[1]) for x, y in polygon), default=0.0)


def cell(box: Polygon, p: np.ndarray, others: np.ndarray) -> Polygon:
    """The polygon of p among others, none of which is p, nearest first."""
    away = np.hypot(*(others - p).T) if len(others) else np.zeros(0)
    polygon = box
    for k in np.argsort(away, kind="stable"):
        if away[k] > reach(polygon, p) or len(polygon) < 3:
            break
        polygon = clip(polygon, p, others[k])
    return polygon


def _tile(v: Column, low: float, side: float, level: int | Column) -> Column:
    at = F.floor((v - low) / side * F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level))
    return at.cast("long")


def _around(df: DataFrame, level: int, low: tuple[float, float], side: float) -> DataFrame:
    """df with tx, ty of the tile at the level and of the eight around it: nine rows for one."""
    step = F.array(*(F.lit(k).cast("long") for k in (-1, 0, 1)))
    own = df.withColumns({"ox": _tile(F.col("x"), low[0], side, level), "oy": _tile(F.col("y"), low[1], side, level)})
    return own.select("*", F.explode(F.transform(step, lambda k: F.col("ox") + k)).alias("tx")).select("*", F.explode(F.transform(step, lambda k: F.col("oy") + k)).alias("ty"))


def _first_cells(sites: DataFrame, todo: DataFrame, level: int, low, side, box: Polygon, most: int) -> tuple[DataFrame, DataFrame]:
    """Cells (x, y, corners, certain) of the places of todo whose nine tiles hold few points, and the rest of todo."""
    around = _around(sites, level, low, side)
    full = around.groupBy("g", "tx", "ty").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("g", "tx", "ty")
    mine = todo.withColumns({"tx": _tile(F.col("x"), low[0], side, level), "ty": _tile(F.col("y"), low[1], side, level)})
    rest = cut(mine.join(full, ["g", "tx", "ty"], "left_semi").select("g", "x", "y"))
    ready = cut(mine.join(full, ["g", "tx", "ty"], "left_anti"))
    wanted = around.join(ready.select("g", "tx", "ty").distinct(), ["g", "tx", "ty"], "left_semi").select("g", "tx", "ty", "x", "y")
    both = wanted.join(ready.select("g", "tx", "ty", "x", "y", F.lit(True).alias("own")), ["g", "tx", "ty", "x", "y"], "left")
    width = side / 2**level
    inside = (min(c[0] for c in box), max(c[0] for c in box), min(c[1] for c in box), max(c[1] for c in box))

    def cells(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = pdf[["x", "y"]].to_numpy()
        tx, ty = int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0])
        left, right = low[0] + (tx - 1) * width, low[0] + (tx + 2) * width
        lower, upper = low[1] + (ty - 1) * width, low[1] + (ty + 2) * width
        out = []
        for i in np.flatnonzero(pdf["own"].notna().to_numpy()):
            p = xy[i]
            polygon = cell(box, p, np.delete(xy, i, 0))
            # Beyond the box there are no points.
            free = min(p[0] - left if left > inside[0] else np.inf, right - p[0] if right < inside[1] else np.inf, p[1] - lower if lower > inside[2] else np.inf, upper - p[1] if upper < inside[3] else np.inf)
            out.append((pdf["g"].iloc[0], p[0], p[1], [list(c) for c in polygon], bool(reach(polygon, p) <= free)))
        return pd.DataFrame(out, columns=["g", "x", "y", "corners", "certain"])

    kind = sites.schema["g"].dataType.simpleString()
    return both.groupBy("g", "tx", "ty").applyInPandas(cells, f"g {kind}, x double, y double, corners array<array<double>>, certain boolean"), rest


def _nearer(sites: DataFrame, corners: DataFrame, low, side) -> DataFrame:
    """g, x, y and the points that prove a corner wrong: for each corner the nearest point within its circle.

    A circle meets at most four tiles as wide as it; sites are looked up at the levels that some circle has.
    """
    width = F.greatest(2 * F.col("r"), F.lit(side / 2**MOST_LEVELS))
    level = F.greatest(F.lit(0), F.least(F.lit(MOST_LEVELS), F.floor(F.log2(F.lit(side) / width)))).cast("int")
    balls = cut(corners.withColumn("level", level))
    levels = [r["level"] for r in balls.select("level").distinct().collect()]
    if not levels:
        return balls.select("g", "x", "y", F.col("cx").alias("qx"), F.col("cy").alias("qy"))
    spread = lambda c, at: F.explode(F.sequence(_tile(F.col(c) - F.col("r"), low[at], side, F.col("level")), _tile(F.col(c) + F.col("r"), low[at], side, F.col("level"))))
    balls = balls.select("*", spread("cx", 0).alias("tx")).select("*", spread("cy", 1).alias("ty"))
    there = sites.select("g", F.col("x").alias("qx"), F.col("y").alias("qy"), F.explode(F.array(*map(F.lit, sorted(levels)))).alias("level"))
    there = there.withColumns({"tx": _tile(F.col("qx"), low[0], side, F.col("level")), "ty": _tile(F.col("qy"), low[1], side, F.col("level"))})
    away = F.hypot(F.col("qx") - F.col("cx"), F.col("qy") - F.col("cy"))
    hits = balls.join(there, ["g", "level", "tx", "ty"]).withColumn("d", away).filter(F.col("d") < F.col("r") * SLACK)
    near = hits.groupBy("g", "x", "y", "cx", "cy").agg(F.min(F.struct("d", "qx", "qy")).alias("q"))
    return near.select("g", "x", "y", "q.qx", "q.qy")


def _cut_again(open_: DataFrame, found: DataFrame) -> DataFrame:
    """The open cells that a point was found for, cut by what was found."""
    by = found.groupBy("g", "x", "y").agg(F.collect_set(F.array("qx", "qy")).alias("others"))

    @F.pandas_udf("array<array<double>>")
    def again(corners: pd.Series, others: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for polygon, q, *p in zip(corners, others, x, y, strict=True):
            polygon, p = [tuple(c) for c in polygon], np.array(p)
            for o in sorted((np.array(o) for o in q), key=lambda o: ((o - p) ** 2).sum()):
                polygon = clip(polygon, p, o)
            out.append([list(c) for c in polygon])
        return pd.Series(out)

    return open_.join(by, ["g", "x", "y"]).select("g", "x", "y", again("corners", "others", "x", "y").alias("corners"))


def voronoi(points: DataFrame, group: str, id_: str, pad: float = 0.04, most: int = MOST_POINTS) -> DataFrame:
    """id, cell: the polygon of each point's cell among the points of its group, within the padded box of all points."""
    known = points.select(F.col(group).alias("g"), F.col(id_).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    ends = known.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    x0, x1, y0, y1 = ends[:4] if ends[4] else (0.0, 1.0, 0.0, 1.0)
    px, py = (x1 - x0) * pad, (y1 - y0) * pad
    box = [(x0 - px, y0 - py), (x1 + px, y0 - py), (x1 + px, y1 + py), (x0 - px, y1 + py)]
    low, side = (box[0][0], box[0][1]), max(x1 - x0 + 2 * px, y1 - y0 + 2 * py, 1e-300) * (1 + 1e-9)
    # A null group is a group; -0.0 is 0.0.
    many = known.groupBy("g").count().filter("count > 1").select(F.col("g").alias("h"))
    kept = cut(known.join(many, F.col("g").eqNullSafe(F.col("h")), "left_semi").select(F.struct("g").alias("g"), "id", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y")))
    sites = cut(kept.select("g", "x", "y").distinct())
    largest = sites.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    # The levels before this one could only take places with few points far around.
    level = max(0, int(np.ceil(np.log2(max(1, largest / most)) / 2)) - 2)
    todo, made = sites, []
    while not todo.isEmpty():
        if level > MOST_LEVELS:
            raise ValueError("too many points in too small a place")
        cells, todo = _first_cells(sites, todo, level, low, side, box, most)
        made.append(cut(cells))
        level += 1
    if not made:
        return kept.select(F.col("id").alias(id_), F.array().cast("array<array<double>>").alias("cell")).limit(0)
    found = made[0]
    for more in made[1:]:
        found = found.unionByName(more)
    done, open_ = [found.filter("certain").drop("certain")], cut(found.filter("not certain").drop("certain"))
    while not open_.isEmpty():
        corners = open_.select("g", "x", "y", F.explode("corners").alias("c")).select("g", "x", "y", F.col("c")[0].alias("cx"), F.col("c")[1].alias("cy"))
        corners = corners.withColumn("r", F.hypot(F.col("cx") - F.col("x"), F.col("cy") - F.col("y")))
        wrong = cut(_nearer(sites, corners, low, side))
        done.append(open_.join(wrong.select("g", "x", "y").distinct(), ["g", "x", "y"], "left_anti"))
        open_ = cut(_cut_again(open_, wrong))
    cells = done[0]
    for more in done[1:]:
        cells = cells.unionByName(more)
    return kept.join(cells, ["g", "x", "y"]).filter("size(corners) >= 3").select(F.col("id").alias(id_), F.col("corners").alias("cell"))


def area(cell: Column) -> Column:
    """A polygon's area, by the products of neighbouring corners."""
    n = F.size(cell)
    one = lambda c, i: c[0] * F.get(cell, F.pmod(i + 1, n))[1] - F.get(cell, F.pmod(i + 1, n))[0] * c[1]
    return F.abs(F.aggregate(F.transform(cell, one), F.lit(0.0), lambda s, x: s + x)) / 2
