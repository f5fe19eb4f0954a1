"""Low-dimensional projections of vectors and the tables drawn from them: folds, parent means, bounds, centroids, density, contours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silvan.functions import vector as V
from silvan.session import cut

#: Partial sums that one task adds up, and rounds of that; the driver gets one of each FAN_IN ** ROUNDS partitions'.
FAN_IN, ROUNDS = 64, 2


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors that are not null, as rows; all are of one length."""
    column = column.drop_null()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance: one row of sums for each partition, added up by a tree of tasks. Null vectors are left out."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, total = 0, None
        for b in batches:
            x = _matrix(b.column(0))
            if len(x):
                own = np.vstack((x.sum(0), x.T @ x))
                n, total = n + len(x), own if total is None else total + own
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["k", "n", "s"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_buffer(), np.float64) for s in t["s"])
        return pa.table({"k": t["k"][:1], "n": pa.array([sum(t["n"].to_pylist())], pa.int64()), "s": pa.array([total.tobytes()], pa.binary())})

    sums = df.select(vector).mapInArrow(part, "k long, n long, s binary")
    for _ in range(ROUNDS):
        sums = sums.withColumn("k", F.expr(f"k div {FAN_IN}")).groupBy("k").applyInArrow(add, "k long, n long, s binary")
    rows = sums.collect()
    if not rows:
        raise ValueError("no vectors")
    n = sum(r["n"] for r in rows)
    total = sum(np.frombuffer(bytes(r["s"]), np.float64) for r in rows)
    d = int((np.sqrt(1 + 4 * len(total)) - 1) / 2)
    mean = total[:d] / n
    return n, mean, (total[d:].reshape(d, d) - n * np.outer(mean, mean)) / max(1, n - 1)


def explained_variance(df: DataFrame, vector: str, threshold: float = 0.95, most: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, axes (columns) and shares of variance of the components kept: the first that reach the threshold, at most `most`."""
    n, mean, cov = moments(df, vector)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)
    values, axes = np.maximum(values[order], 0), axes[:, order]
    shares = values / max(values.sum(), 1e-300)
    fit = min(most, len(values), n)
    kept = min(fit, int(np.searchsorted(np.cumsum(shares[:fit]), threshold)) + 1)
    # The sign of an axis is free; its largest entry is made positive.
    axes = axes[:, :kept] * np.sign(axes[np.abs(axes[:, :kept]).argmax(0), np.arange(kept)])
    return mean, axes, shares[:kept]


def pca(df: DataFrame, vector: str, threshold: float = 0.95, most: int = 50) -> DataFrame:
    """df with `coords`: the centred vector on the kept components; null for a null vector, and for all if there is none."""
    try:
        mean, axes, _ = explained_variance(df, vector, threshold, most)
    except ValueError:
        return df.withColumn("coords", F.lit(None).cast("array<double>"))
    held = df.sparkSession.sparkContext.broadcast((mean, axes))  # as many numbers as a vector has, for each component

    @F.pandas_udf("array<double>")
    def place(v: pd.Series) -> pd.Series:
        mean, axes = held.value
        here, out = np.flatnonzero(v.notna()), np.full(len(v), None, object)
        if len(here):
            for i, row in zip(here, (np.stack(v.to_numpy()[here]).astype(np.float64) - mean) @ axes, strict=True):
                out[i] = row
        return pd.Series(out)

    return df.withColumn("coords", place(F.col(vector)))


def stratified_sample(df: DataFrame, stratum: str, id_: str, n: int, seed: int = 42) -> DataFrame:
    """min(n, size) rows of each stratum without replacement, by a seeded hash of the id."""
    order = Window.partitionBy(stratum).orderBy(F.xxhash64(F.col(id_), F.lit(seed)), id_)
    return df.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= n).drop("__n")


def fold_to_units(bridge: DataFrame, positions: DataFrame) -> DataFrame:
    """unit_id, coords: the average of the spans' coords by weight. positions: span_id, coords."""
    return V.weighted_average(bridge.join(positions, "span_id"), "unit_id", "coords", "weight", unit_length=False).withColumnRenamed("vector", "coords")


def parent_means(tree: DataFrame, placed: DataFrame, dims: int, id_: str = "id") -> DataFrame:
    """id, coords of leaves and all parents above them: a parent takes the plain mean of its children placed in earlier
    waves, in the wave in which its first child was placed; later children change nothing.

    So its children of the wave before are all that count, and a step joins that wave with the parents still to be placed.
    placed may bring its parent_id; without it, placed and tree meet once more. Joins hold the parents, which are few to the
    leaves, by their ids; leaves go past them and are never sorted.
    """
    t = tree.select(F.col(id_).alias("id"), F.col("parent_id").alias("up"))
    ups = t.select(F.col("up").alias("id")).filter("id is not null").distinct()
    begun = placed.join(ups.hint("shuffle_hash"), "id", "left_semi").select("id")
    rest = cut(t.join(ups.hint("shuffle_hash"), "id", "left_semi").join(begun, "id", "left_anti"))
    fresh = placed.select("id", "coords", F.col("parent_id").alias("up")) if "parent_id" in placed.columns else placed.select("id", "coords").join(t, "id", "left")
    out = [placed.select("id", "coords")]
    while True:
        mean = fresh.filter("up is not null").groupBy(F.col("up").alias("id")).agg(*(F.avg(F.col("coords")[k]).alias(f"c{k}") for k in range(dims)))
        fresh = cut(mean.select("id", F.array(*(f"c{k}" for k in range(dims))).alias("coords")).join(rest.hint("shuffle_hash"), "id"))
        if fresh.isEmpty():
            return reduce(DataFrame.unionByName, out)
        rest = cut(rest.join(fresh.select("id"), "id", "left_anti"))
        out.append(fresh.select("id", "coords"))


def bounds(points: DataFrame, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Least and greatest of each axis, -1 and 1 if there is no point."""
    one = lambda f, a, v: F.coalesce(f(a), F.lit(v))
    return points.agg(*(c for a in axes for c in (one(F.min, a, -1.0).alias(f"{a}_min"), one(F.max, a, 1.0).alias(f"{a}_max"))))


def centroids(points: DataFrame, group: str, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    return points.groupBy(group).agg(*(F.avg(a).alias(a) for a in axes), F.count("*").alias("n"))


def density(points: DataFrame, group: str, cells: int = 48, pad: float = 0.18, cutoff: float = 3.0) -> DataFrame:
    """group, i, j, value on a lattice of (cells + 1)^2 for each group of two points or more: Gaussian kernels with a
    bandwidth of an 18th of the padded box's longer side, cut off at 3 bandwidths.

    Each point meets only the lattice rows and columns in its reach, which is a fixed number, never the whole lattice.
    """
    box = points.groupBy(group).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n")).filter("n > 1")
    w, h = F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-6)), F.greatest(F.col("y1") - F.col("y0"), F.lit(1e-6))
    box = box.select(group, (F.col("x0") - w * pad).alias("left"), (F.col("y0") - h * pad).alias("top"), (w * (1 + 2 * pad)).alias("w"), (h * (1 + 2 * pad)).alias("h"))
    box = box.withColumns({"band": F.greatest("w", "h") / 18, "dx": F.col("w") / cells, "dy": F.col("h") / cells})
    p = points.select(group, "x", "y").join(box, group)
    reach = F.col("band") * cutoff
    span = lambda v, low, step: F.sequence(
        F.greatest(F.ceil((v - reach - low) / step), F.lit(0)).cast("int"), F.least(F.floor((v + reach - low) / step), F.lit(cells)).cast("int")
    )
    near = p.select("*", F.explode(span(F.col("x"), F.col("left"), F.col("dx"))).alias("i")).select("*", F.explode(span(F.col("y"), F.col("top"), F.col("dy"))).alias("j"))
    sq = (F.pow(F.col("left") + F.col("i") * F.col("dx") - F.col("x"), 2) + F.pow(F.col("top") + F.col("j") * F.col("dy") - F.col("y"), 2)) / F.pow("band", 2)
    kept = near.withColumn("sq", sq).filter(F.col("sq") <= cutoff * cutoff)
    return kept.groupBy(group, "i", "j").agg(F.sum(F.exp(-F.col("sq") / 2)).alias("value"))


def contour_crossings(field: DataFrame, group: str, shares: tuple[float, ...] = (0.18, 0.32, 0.48, 0.66)) -> DataFrame:
    """group, level, i, j, edge, at: where each lattice edge (right 'x' or down 'y' from i, j) crosses a share of the group's
    greatest value, as a fraction along the edge. Lattice points without a value are 0."""
    top = field.groupBy(group).agg(F.max("value").alias("top"))
    a = field.select(group, "i", "j", "value")
    # Every edge with a valued end: from the point itself, and from its left and upper neighbours.
    edges = a.select(group, F.explode(F.array(*(F.struct((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.lit(e).alias("edge")) for e, di, dj in (("x", 0, 0), ("y", 0, 0), ("x", 1, 0), ("y", 0, 1))))).alias("e")).select(group, "e.*").distinct().filter("i >= 0 and j >= 0")
    first = a.withColumnRenamed("value", "v0")
    second = a.select(group, F.col("i").alias("i1"), F.col("j").alias("j1"), F.col("value").alias("v1"))
    e = edges.withColumns({"i1": F.col("i") + (F.col("edge") == "x").cast("int"), "j1": F.col("j") + (F.col("edge") == "y").cast("int")})
    e = e.join(first, [group, "i", "j"], "left").join(second, [group, "i1", "j1"], "left").join(top, group).na.fill(0.0, ["v0", "v1"])
    e = e.withColumn("level", F.explode(F.array(*(F.lit(s) for s in shares)))).withColumn("cut", F.col("level") * F.col("top"))
    hit = e.filter((F.col("v0") < F.col("cut")) != (F.col("v1") < F.col("cut")))
    return hit.select(group, "level", "i", "j", "edge", ((F.col("cut") - F.col("v0")) / (F.col("v1") - F.col("v0"))).alias("at"))


def contour_segments(field: DataFrame, group: str, shares: tuple[float, ...] = (0.18, 0.32, 0.48, 0.66)) -> DataFrame:
    """group, level, i, j, part, x0, y0, x1, y1: the pieces of the contours in each lattice cell, in lattice units.

    A cell whose sides (upper, right, lower, left) are crossed twice has one piece, one crossed four times two, from the
    first to the second crossing and from the third to the fourth.
    """
    c = contour_crossings(field, group, shares)
    across = F.col("edge") == "x"
    x, y = F.col("i") + F.when(across, F.col("at")).otherwise(0.0), F.col("j") + F.when(across, 0.0).otherwise(F.col("at"))
    # An edge is the upper or left side of its own cell, and the lower or right side of the one before it.
    own = F.struct(F.col("i").alias("ci"), F.col("j").alias("cj"), F.when(across, 0).otherwise(3).alias("side"))
    before = F.struct((F.col("i") - F.when(across, 0).otherwise(1)).alias("ci"), (F.col("j") - F.when(across, 1).otherwise(0)).alias("cj"), F.when(across, 2).otherwise(1).alias("side"))
    sides = c.select(group, "level", x.alias("x"), y.alias("y"), F.explode(F.array(own, before)).alias("s")).filter("s.ci >= 0 and s.cj >= 0")
    # At most four crossings a cell.
    cells = sides.groupBy(group, "level", F.col("s.ci").alias("i"), F.col("s.cj").alias("j")).agg(F.sort_array(F.collect_list(F.struct("s.side", "x", "y"))).alias("p"))
    pieces = F.transform(F.sequence(F.lit(0), F.size("p") - 2, F.lit(2)), lambda k: F.struct((k / 2).cast("int").alias("part"), F.get("p", k)["x"].alias("x0"), F.get("p", k)["y"].alias("y0"), F.get("p", k + 1)["x"].alias("x1"), F.get("p", k + 1)["y"].alias("y1")))
    return cells.filter("size(p) >= 2").select(group, "level", "i", "j", F.explode(pieces).alias("q")).select(group, "level", "i", "j", "q.*")
