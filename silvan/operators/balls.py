"""An index for exact vector search: vectors in files by the ball they are in, read in order of how near a ball can come.

Centres are fitted on a bounded sample of the vectors' directions; every vector goes to the ball of its nearest centre, and
a ball's radius is the widest angle between its centre and a vector of it. No vector of a ball is nearer to a query than the
angle to the centre less the radius. A search reads the balls that can come nearest until they hold a page, and then those
that can come as near as the page's last row; all others have no row in it. The rows and their order are those of the
search without an index. Vectors that are null, zero or of another length come last in a page and are in a ball of their
own, which is read if the others don't fill the page.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvan.operators import search
from silvan.operators.manifold import SEED, take_sample, unit_rows

SAMPLE_ROWS = 20_000
ROUNDS = 10
#: Radians that rounding may have taken off an angle.
SLACK = 1e-6
OTHERS = -1


def fit_centres(sample: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """At most n directions, by a few rounds of nearest-centre averages from rows drawn at random."""
    x = unit_rows(sample)
    x = x[np.linalg.norm(x, axis=1) > 0.5]
    centres = x[np.sort(np.random.default_rng(seed).permutation(len(x))[:n])]
    for _ in range(ROUNDS):
        at = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-300), centres)
    return centres


def write_index(df: DataFrame, path: str, n_balls: int = 256, id_: str = "vec_id", vector: str = "embedding", files: int = 1) -> None:
    """df, all columns, in folders by ball, and the table of balls. A ball's rows are dealt over `files` files."""
    spark = df.sparkSession
    # Vectors of the most frequent length are indexed, all others are in the ball of the rest.
    width = df.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    try:
        centres = fit_centres(take_sample(df.filter(F.size(vector) == (width[0] if width else 0)), id_, vector, SAMPLE_ROWS), n_balls)
    except ValueError:
        centres = np.zeros((0, 0))
    held = spark.sparkContext.broadcast(centres)  # n_balls vectors

    @F.pandas_udf("ball int, angle double")
    def assign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        centres = held.value
        for v in batches:
            ball, angle = np.full(len(v), OTHERS, np.int32), np.full(len(v), np.nan)
            here = np.array([i for i, x in enumerate(v) if x is not None and len(x) == centres.shape[1]], np.int64)
            if len(here) and len(centres):
                x = np.stack(v.to_numpy()[here]).astype(np.float64)
                usable = np.isfinite(x).all(1) & (np.linalg.norm(x, axis=1) > 0)
                here, x = here[usable], unit_rows(x[usable])
                products = x @ centres.T
                ball[here] = products.argmax(1)
                angle[here] = np.arccos(np.clip(products.max(1), -1, 1)) if len(here) else []
            yield pd.DataFrame({"ball": ball, "angle": angle})

    rows = df.withColumn("__at", assign(F.col(vector)))
    salt = F.pmod(F.xxhash64(id_), F.lit(files))
    rows.select(*df.columns, F.col("__at.ball").alias("ball"), F.col("__at.angle").alias("angle")).repartition("ball", salt).write.partitionBy("ball").parquet(f"{path}/vectors")
    found = spark.read.parquet(f"{path}/vectors").groupBy("ball").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    # As many rows as there are balls.
    table = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "ball int, centre array<double>")
    found.join(table, "ball", "left").coalesce(1).write.parquet(f"{path}/balls")


@dataclass(frozen=True)
class Read:
    """What a search has read: balls and rows of all."""

    balls: int
    rows: int
    all_balls: int
    all_rows: int


class Balls:
    """An index that is written. `last` tells what the last search read."""

    def __init__(self, spark: SparkSession, path: str):
        table = spark.read.parquet(f"{path}/balls").toPandas()
        self.vectors = spark.read.parquet(f"{path}/vectors").drop("angle")
        self.sizes = dict(zip(table["ball"].tolist(), table["n"].tolist(), strict=True))
        inner = table[table["centre"].notna()]
        self.numbers = inner["ball"].to_numpy()
        self.centres = np.stack(inner["centre"].to_numpy()) if len(inner) else np.zeros((0, 0))
        self.radii = inner["radius"].to_numpy(np.float64)
        self.last: Read | None = None

    def _bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The balls in order of the least angle that a vector in them can have to the query, and these angles."""
        angle = np.arccos(np.clip(self.centres @ (q / np.linalg.norm(q)), -1, 1))
        least = np.maximum(0, angle - self.radii - SLACK)
        order = np.argsort(least, kind="stable")
        return self.numbers[order], least[order]

    def _wanted(self, q: np.ndarray, need: int, id_: str, vector: str) -> list[int]:
        """The balls in which a row of the first `need` can be."""
        if not len(self.centres) or len(q) != self.centres.shape[1] or not np.linalg.norm(q):
            return list(self.sizes)  # no vector is at a distance
        order, least = self._bounds(q)
        held = np.cumsum([self.sizes[int(b)] for b in order])
        if held[-1] < need:
            return list(self.sizes)
        first = int(np.searchsorted(held, need)) + 1
        # The page of the nearest balls' rows: what is farther than its last row is not in the page of all.
        near = search.top_k(self._rows(order[:first]), q, need, 0, id_, vector).select(vector).collect()
        x = unit_rows(np.array([r[0] for r in near], np.float64))
        worst = float(np.arccos(np.clip((x @ q).min() / np.linalg.norm(q), -1, 1))) + SLACK
        return order[: max(first, int(np.searchsorted(least, worst, "right")))].tolist()

    def _rows(self, balls: Sequence[int]) -> DataFrame:
        return self.vectors.filter(F.col("ball").isin([int(b) for b in balls])).drop("ball")

    def top_k(self, query: Sequence[float], k: int = 10, offset: int = 0, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """The page of `search.top_k` over all vectors."""
        read = self._wanted(np.asarray([float(x) for x in query]), k + offset, id_, vector) if k + offset else []
        self.last = Read(len(read), sum(self.sizes[b] for b in read), len(self.sizes), sum(self.sizes.values()))
        return search.top_k(self._rows(read), query, k, offset, id_, vector)
