"""Manifold projections: neighbour graphs, UMAP, PHATE and Isomap, fitted on a sample of a stated bound, all vectors placed.

A fit works on at most `most` rows (see each fit). What grows with the square of the sample is worked out by tasks: a
task has the sample as a broadcast and takes some of its rows, for neighbours and for ways along the graph. The driver
holds the graph, one row of numbers for each sample row and, for Isomap, the distances to landmarks. Every vector that is
not in the sample is placed from its nearest sample rows, by tasks that have the fit as a broadcast; a row that is equal
to one of the sample has that one's place. Fits are seeded, and which task places a vector changes nothing.

A null vector, or one with a null in it, is not in a sample and has null coordinates; a sample of fewer rows than
neighbours uses those there are; one of no rows is an error in a fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 42
#: Rows of a task's slice of the sample, and of a block of distances.
SLICE = 512


def whole(vector: str) -> Column:
    """Whether a vector is there, and each of its components is a number."""
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))


def take_sample(df: DataFrame, id_: str, vector: str, most: int, stratum: str | None = None, per_stratum: int = 100, seed: int = SEED) -> np.ndarray:
    """At most `most` whole vectors as rows, by a seeded hash of the id: per_stratum of each stratum if one is named. Of equal
    vectors one stays, as rows at no distance say nothing of the form of the rest."""
    from silvan.operators.projection import stratified_sample

    rows = df.filter(whole(vector))
    if stratum is not None:
        rows = stratified_sample(rows, stratum, id_, per_stratum, seed)
    kept = rows.select(id_, vector).orderBy(F.xxhash64(F.col(id_), F.lit(seed)), id_).limit(most).toPandas()
    if not len(kept):
        raise ValueError("no vectors")
    x = np.stack(kept.sort_values(id_, kind="stable")[vector].to_numpy()).astype(np.float64)
    return x[np.sort(np.unique(x, axis=0, return_index=True)[1])]


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows at unit length, zero rows as they are: the square of their distance is twice the cosine distance."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def nearest(x: np.ndarray, sample: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and Euclidean distances of each row's k nearest sample rows, nearest first, the lower number in ties."""
    k = min(k, len(sample))
    near = np.empty((len(x), k), np.int64)
    away = np.empty((len(x), k))
    squares = (sample**2).sum(1)
    for at in range(0, len(x), SLICE):
        part = x[at : at + SLICE]
        rough = squares - 2 * part @ sample.T
        # A few more than k by the fast formula, then exact distances of those.
        some = np.sort(np.argpartition(rough, min(k + 4, len(sample)) - 1, axis=1)[:, : k + 4], axis=1)
        d = np.sqrt(((part[:, None] - sample[some]) ** 2).sum(2))
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        near[at : at + SLICE], away[at : at + SLICE] = np.take_along_axis(some, order, 1), np.take_along_axis(d, order, 1)
    return near, away


def _by_slices(spark: SparkSession, n: int, held: object, work: Callable[[object, int, int], dict[str, np.ndarray]], width: int) -> dict[str, np.ndarray]:
    """work(held, start, end) for slices of n rows in tasks; its arrays, one row for each of the n, put together in order."""
    shared = spark.sparkContext.broadcast(held)
    slices = -(-n // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column(0).to_pylist():
                for name, rows in work(shared.value, s * width, min(n, (s + 1) * width)).items():
                    rows = np.ascontiguousarray(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([name]), pa.array([str(rows.dtype)]), pa.array([rows.shape[1]], pa.int32()), pa.array([rows.tobytes()], pa.binary())], ["s", "name", "kind", "width", "rows"])

    got = spark.range(0, slices, 1, slices).mapInArrow(run, "s long, name string, kind string, width int, rows binary").collect()
    out: dict[str, list[np.ndarray]] = {}
    for r in sorted(got, key=lambda r: r["s"]):
        out.setdefault(r["name"], []).append(np.frombuffer(bytes(r["rows"]), r["kind"]).reshape(-1, r["width"]))
    shared.unpersist()
    return {name: np.concatenate(parts) for name, parts in out.items()}


def knn(spark: SparkSession, sample: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and distances of the k nearest other rows of each row of a sample: exact, by slices in tasks."""

    def work(x: np.ndarray, start: int, end: int) -> dict[str, np.ndarray]:
        near, away = nearest(x[start:end], x, k + 1)
        own = near == np.arange(start, end)[:, None]
        own[~own.any(1), -1] = True  # equal rows of lower number are nearest: the row itself may not be among them
        return {"near": near[~own].reshape(end - start, -1), "away": away[~own].reshape(end - start, -1)}

    got = _by_slices(spark, len(sample), sample, work, SLICE)
    return got["near"], got["away"]


# ---- UMAP ----


@dataclass(frozen=True)
class Umap:
    """A fit: the sample at unit length, its places, and the neighbours that place another row."""

    sample: np.ndarray
    coords: np.ndarray
    k: int

    def place(self, x: np.ndarray) -> np.ndarray:
        """The average of the nearest sample rows' places by membership strength."""
        near, away = nearest(unit_rows(x), self.sample, self.k)
        strength = memberships(away, self.k)
        strength[away[:, 0] == 0] = np.arange(near.shape[1]) == 0
        return (self.coords[near] * (strength / strength.sum(1, keepdims=True))[:, :, None]).sum(1)


def memberships(away: np.ndarray, k: int, rounds: int = 64) -> np.ndarray:
    """Strength of each row's links to its neighbours at these distances: 1 to the nearest that isn't equal, and falling so
    that a row's strengths come to log2(k)."""
    positive = np.where(away > 0, away, np.inf)
    rho = np.where(np.isfinite(positive.min(1)), positive.min(1), 0)[:, None]
    beyond = np.maximum(away - rho, 0)
    want = np.log2(max(k, 2))
    low, high, sigma = np.zeros(len(away)), np.full(len(away), np.inf), np.ones(len(away))
    for _ in range(rounds):
        total = np.exp(-beyond / sigma[:, None]).sum(1)
        more = total < want
        low, high = np.where(more, sigma, low), np.where(more, high, sigma)
        sigma = np.where(np.isfinite(high), (low + high) / 2, sigma * 2)
    # Not less than a thousandth of the mean distance, which keeps rows among equal ones linked.
    least = 1e-3 * np.where(rho[:, 0] > 0, away.mean(1), max(float(away.mean()), 1e-12))
    return np.exp(-beyond / np.maximum(sigma, least)[:, None])


def fuzzy_union(near: np.ndarray, strength: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges i < j and weights: a + b - a * b of the strengths from either end."""
    n = len(near)
    i, j = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    low, high = np.minimum(i, j), np.maximum(i, j)
    edge, at = np.unique(low * n + high, return_inverse=True)
    unlinked = np.ones(len(edge))
    np.multiply.at(unlinked, at, 1 - strength.ravel())
    return edge // n, edge % n, 1 - unlinked


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a * d ** (2 * b)), nearest to a curve that is 1 up to min_dist and falls exponentially from there:
    least squares by Gauss and Newton's method with halved steps."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    p = np.array([0.0, 0.0])  # logarithms of a and b, which are positive
    of = lambda p: 1 / (1 + np.exp(p[0]) * d ** (2 * np.exp(p[1])))
    for _ in range(100):
        f = of(p)
        slope = -f * (1 - f)
        jac = np.stack((slope, slope * 2 * np.exp(p[1]) * np.log(d)), 1)
        step = np.linalg.lstsq(jac, want - f, rcond=None)[0]
        while ((of(p + step) - want) ** 2).sum() > ((f - want) ** 2).sum() and np.abs(step).max() > 1e-12:
            step = step / 2
        p = p + step
    return float(np.exp(p[0])), float(np.exp(p[1]))


def spectral(i: np.ndarray, j: np.ndarray, w: np.ndarray, start: np.ndarray, rounds: int = 300) -> np.ndarray:
    """The smoothest functions on the graph beside the constant, by subspace iteration from `start` (a column for each)."""
    n = len(start)
    degree = np.maximum(np.bincount(i, w, n) + np.bincount(j, w, n), 1e-12)
    scaled = w / np.sqrt(degree[i] * degree[j])
    first = np.sqrt(degree / degree.sum())[:, None]
    x = start
    for _ in range(rounds):
        x = x - first @ (first.T @ x)
        x, _ = np.linalg.qr(x)
        moved = np.stack([np.bincount(i, scaled * c[j], n) + np.bincount(j, scaled * c[i], n) for c in x.T], 1)
        x = (x + moved) / 2
    return x / np.sqrt(degree)[:, None]


def principal(x: np.ndarray, dims: int) -> np.ndarray:
    """Centred rows on their first axes, each axis' largest entry positive; columns of zeros where there are fewer."""
    c = x - x.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    vt = vt[:dims] * np.sign(vt[np.arange(len(vt[:dims])), np.abs(vt[:dims]).argmax(1)])[:, None]
    out = c @ vt.T
    return np.pad(out, ((0, 0), (0, dims - out.shape[1])))


def layout(start: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, a: float, b: float, epochs: int, negatives: int = 5, seed: int = SEED) -> np.ndarray:
    """Places by stochastic gradient descent: in each epoch the edges whose turn it is pull their ends together, and push
    either end from some rows drawn at random. An edge's turns are as many as its share of the largest weight.

    All of an epoch's moves go from the places at its start; a row's moves in an epoch are limited to those of one edge.
    """
    rng = np.random.default_rng(seed)
    y, n, dims = start.copy(), len(start), start.shape[1]
    heads, tails = np.concatenate((i, j)), np.concatenate((j, i))
    every = np.concatenate((w, w)) / w.max() if len(w) else np.zeros(0)
    due = np.zeros(len(every))
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        due += every
        now = np.flatnonzero(due >= 1)
        due[now] -= 1
        h, t = heads[now], tails[now]
        away = y[h] - y[t]
        sq = (away**2).sum(1)
        pull = np.where(sq > 0, -2 * a * b * np.maximum(sq, 1e-12) ** (b - 1) / (1 + a * sq**b), 0)
        moves = [np.clip(pull[:, None] * away, -4, 4)]
        other = rng.integers(0, n, (len(h), negatives))
        apart = y[h][:, None] - y[other]
        sq = (apart**2).sum(2)
        push = np.where((other != h[:, None]) & (sq > 0), 2 * b / ((0.001 + sq) * (1 + a * sq**b)), 0)
        moves.append(np.clip(push[:, :, None] * apart, -4, 4).sum(1))
        total = moves[0] + moves[1]
        step = np.stack([np.bincount(h, total[:, c], n) for c in range(dims)], 1)
        size = np.sqrt((step**2).sum(1, keepdims=True))
        y = y + rate * step * np.minimum(1, 4 / np.maximum(size, 1e-300))
    return y


def umap(spark: SparkSession, sample: np.ndarray, k: int = 15, dims: int = 3, min_dist: float = 0.1, epochs: int | None = None, seed: int = SEED, most: int = 10_000) -> Umap:
    """A fit of at most `most` rows by cosine distance."""
    if len(sample) > most:
        raise ValueError("the sample is too large")
    x = unit_rows(np.asarray(sample, np.float64))
    n = len(x)
    if n <= dims + 1:
        return Umap(x, principal(x, dims), min(k, n))
    near, away = knn(spark, x, min(k, n) - 1)
    away = away**2 / 2  # cosine distances
    # A row is its own nearest neighbour.
    i, j, w = fuzzy_union(near, memberships(away, min(k, n)))
    begin = principal(x, dims)
    rng = np.random.default_rng(seed)
    start = spectral(i, j, w, begin + 1e-3 * begin.std() * rng.standard_normal(begin.shape))
    start = start / np.maximum(np.abs(start).max(), 1e-300) * 10 + 1e-4 * rng.standard_normal(start.shape)
    a, b = curve(min_dist)
    return Umap(x, layout(start, i, j, w, a, b, epochs or (500 if n <= 10_000 else 200), seed=seed), min(k, n))


# ---- PHATE ----


@dataclass(frozen=True)
class Phate:
    """A fit: the sample, its places, the time of the diffusion, and what a new row's kernel needs."""

    sample: np.ndarray
    coords: np.ndarray
    t: int
    knn: int
    decay: float

    def place(self, x: np.ndarray) -> np.ndarray:
        """The average of sample rows' places by the kernel from the new row."""
        near, away = nearest(x, self.sample, self.knn)
        d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (self.sample**2).sum(1) - 2 * x @ self.sample.T))
        k = alpha_decay(d, away[:, -1:], self.decay)
        out = (k / k.sum(1, keepdims=True)) @ self.coords
        same = away[:, 0] == 0
        out[same] = self.coords[near[same, 0]]
        return out


def alpha_decay(d: np.ndarray, band: np.ndarray, decay: float, least: float = 1e-4) -> np.ndarray:
    """exp(-(d / bandwidth) ** decay), the bandwidth (a column) being a row's distance to its knn-th; below `least` it is 0."""
    with np.errstate(over="ignore"):
        k = np.exp(-((d / np.maximum(band, 1e-12)) ** decay))
    return np.where(k < least, 0, k)


def distances(x: np.ndarray) -> np.ndarray:
    sq = (x**2).sum(1)
    return np.sqrt(np.maximum(0, sq[:, None] + sq - 2 * x @ x.T))


def diffusion(d: np.ndarray, knn: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Kernel, made symmetric, of a square of distances, and each row's total; a row's steps are its kernel by its total."""
    # A row is at distance 0 to itself, so its knn-th neighbour is the one after.
    k = alpha_decay(d, np.partition(d, knn, axis=1)[:, knn : knn + 1], decay)
    k = (k + k.T) / 2
    return k, k.sum(1)


def entropy_time(values: np.ndarray, most: int = 100) -> int:
    """The number of steps at the knee of the entropy of the operator's powers: the point that two straight lines, one through
    what is before and one through what is after it, fit best."""
    p = np.abs(values)[:, None] ** np.arange(1, most + 1)
    p = p / p.sum(0)
    h = -(p * np.log(np.maximum(p, 1e-300))).sum(0)
    t = np.arange(1, most + 1)

    def off(a: int, b: int) -> float:
        x, y = t[a:b], h[a:b]
        slope = ((x - x.mean()) * (y - y.mean())).sum() / max(((x - x.mean()) ** 2).sum(), 1e-300)
        return float(((y - y.mean() - slope * (x - x.mean())) ** 2).sum())

    return int(t[min(range(1, most - 1), key=lambda k: off(0, k + 1) + off(k, most))])


def classical_mds(d: np.ndarray, dims: int) -> np.ndarray:
    k = -0.5 * d**2
    values, vectors = np.linalg.eigh(k - k.mean(0) - k.mean(1, keepdims=True) + k.mean())
    top = np.argsort(-values)[:dims]
    vectors = vectors[:, top] * np.sign(vectors[np.abs(vectors[:, top]).argmax(0), top])
    out = vectors * np.sqrt(np.maximum(values[top], 0))
    return np.pad(out, ((0, 0), (0, dims - out.shape[1])))


def metric_mds(d: np.ndarray, start: np.ndarray, rounds: int = 200, enough: float = 1e-5) -> np.ndarray:
    """Stress majorisation: each round's places are the best for a bound of the stress that touches it at the last ones. It
    ends when a round takes less than a share of `enough` off the stress."""
    y, now, ratio = start, distances(start), np.empty_like(d)
    last = float(((d - now) ** 2).sum())
    for _ in range(rounds):
        ratio.fill(0)
        np.divide(d, now, out=ratio, where=now > 1e-12)
        y = (ratio.sum(1)[:, None] * y - ratio @ y) / len(d)
        now = distances(y)
        stress = float(((d - now) ** 2).sum())
        if last - stress <= enough * last:
            break
        last = stress
    return y


def phate(sample: np.ndarray, knn: int = 5, decay: float = 40, dims: int = 3, t: int | None = None, most: int = 2_000) -> Phate:
    """A fit of at most `most` rows: the square tables of so many rows are the driver's."""
    x = np.asarray(sample, np.float64)
    n = len(x)
    if n > most:
        raise ValueError("the sample is too large")
    away = distances(x)
    np.fill_diagonal(away, 0)
    k, total = diffusion(away, min(knn, n - 1), decay)
    root = np.sqrt(total)
    values, vectors = np.linalg.eigh(k / root[:, None] / root)
    t = t or entropy_time(values)
    # The power of the steps, through their symmetric form.
    power = (vectors / root[:, None] * values**t) @ (vectors.T * root)
    potential = -np.log(np.maximum(power, 0) + 1e-7)
    d = distances(potential)
    return Phate(x, metric_mds(d, classical_mds(d, dims)), t, knn, decay)


# ---- Isomap ----


@dataclass(frozen=True)
class Isomap:
    """A fit: the sample, its distances along the neighbour graph to the landmarks, and what turns these into places."""

    sample: np.ndarray
    geodesic: np.ndarray
    mean: np.ndarray
    axes: np.ndarray
    k: int

    @property
    def coords(self) -> np.ndarray:
        return self.of_ways(self.geodesic)

    def of_ways(self, along: np.ndarray) -> np.ndarray:
        return -0.5 * (along.astype(np.float64) ** 2 - self.mean) @ self.axes

    def place(self, x: np.ndarray) -> np.ndarray:
        """Places by the shortest ways to the landmarks through a row's nearest sample rows; an equal one's ways are its own."""
        near, away = nearest(x, self.sample, self.k)
        along = np.full((len(x), self.geodesic.shape[1]), np.inf)
        for m in range(near.shape[1]):
            np.minimum(along, away[:, m : m + 1] + self.geodesic[near[:, m]], out=along)
        same = away[:, 0] == 0
        along[same] = self.geodesic[near[same, 0]]
        return self.of_ways(along)


def parts(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each row is linked to by edges, however many."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def joined(x: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges, and while parts of the graph do not meet, for each but the largest one more to its nearest row outside."""
    while True:
        label = parts(len(x), i, j)
        names, sizes = np.unique(label, return_counts=True)
        if len(names) <= 1:
            return i, j, d
        new = []
        for name in np.delete(names, sizes.argmax()):
            mine, others = np.flatnonzero(label == name), np.flatnonzero(label != name)
            at, away = nearest(x[mine], x[others], 1)
            best = int(away[:, 0].argmin())
            new.append((mine[best], others[at[best, 0]], away[best, 0]))
        a, b, c = (np.array(v) for v in zip(*new, strict=True))
        i, j, d = np.concatenate((i, a)), np.concatenate((j, b)), np.concatenate((d, c))


def ways(spark: SparkSession, n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray, sources: np.ndarray, width: int = 32) -> np.ndarray:
    """Lengths of the shortest ways from all n rows (rows) to the sources (columns) along edges: many sources, some a task.

    A task has the edges, which are as many as the sample's rows times its neighbours, and goes over them in rounds until
    nothing gets shorter; a round takes the edges in groups in which no row occurs twice.
    """
    heads, tails, length = np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((d, d))
    order = np.argsort(heads, kind="stable")
    heads, tails, length = heads[order], tails[order], length[order]
    begin = np.searchsorted(heads, np.arange(n))
    nth = np.arange(len(heads)) - begin[heads]
    groups = [np.flatnonzero(nth == s) for s in range(int(nth.max(initial=-1)) + 1)]
    edges = [(heads[g], tails[g], length[g][:, None]) for g in groups]

    def work(held, start: int, end: int) -> dict[str, np.ndarray]:
        edges, sources = held
        out = np.full((n, end - start), np.inf)
        out[sources[start:end], np.arange(end - start)] = 0
        while True:
            before = out.copy()
            for h, t, w in edges:
                out[h] = np.minimum(out[h], out[t] + w)
            if (out == before).all():
                return {"to": np.ascontiguousarray(out.T)}

    return _by_slices(spark, len(sources), (edges, sources), work, width)["to"].T


def isomap(spark: SparkSession, sample: np.ndarray, k: int = 10, dims: int = 3, landmarks: int = 500, most: int = 20_000, seed: int = SEED) -> Isomap:
    """A fit of at most `most` rows: their distances along the graph to `landmarks` rows drawn at random (to all, if there are
    no more), multidimensional scaling of the landmarks, and all others placed by their distances to them."""
    x = np.asarray(sample, np.float64)
    n = len(x)
    if n > most:
        raise ValueError("the sample is too large")
    if not n:
        raise ValueError("no vectors")
    chosen = np.sort(np.random.default_rng(seed).permutation(n)[:landmarks])
    if n == 1:
        return Isomap(x, np.zeros((1, 1)), np.zeros(1), np.zeros((1, dims)), 1)
    near, away = knn(spark, x, min(k, n - 1))
    i, j = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    along = ways(spark, n, *joined(x, i, j, away.ravel()), chosen)
    sq = along[chosen] ** 2
    mean = sq.mean(0)
    values, vectors = np.linalg.eigh(-0.5 * (sq - mean - sq.mean(1, keepdims=True) + sq.mean()))
    top = np.argsort(-values)[:dims]
    keep = values[top] > 1e-12 * max(float(values.max()), 1e-300)
    vectors = vectors[:, top] * np.sign(vectors[np.abs(vectors[:, top]).argmax(0), top])
    axes = np.where(keep, vectors / np.sqrt(np.where(keep, values[top], 1)), 0)
    return Isomap(x, along, mean, np.pad(axes, ((0, 0), (0, dims - axes.shape[1]))), min(k, n))


# ---- all vectors ----


def place(df: DataFrame, vector: str, fit: Umap | Phate | Isomap, output: str = "coords") -> DataFrame:
    """df with the fit's coordinates of each vector; null for a vector that isn't whole."""
    held = df.sparkSession.sparkContext.broadcast(fit)

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fit = held.value
        for v in batches:
            out = np.full(len(v), None, object)
            here = np.array([i for i, x in enumerate(v) if x is not None and not any(c is None or c != c for c in x)], np.int64)
            for at in range(0, len(here), SLICE):
                some = here[at : at + SLICE]
                for i, row in zip(some, fit.place(np.stack([np.asarray(v.iloc[i], np.float64) for i in some])), strict=True):
                    out[i] = row
            yield pd.Series(out)

    return df.withColumn(output, of(F.col(vector)))


def trustworthiness(x: np.ndarray, y: np.ndarray, k: int) -> float:
    """1 less a penalty for each of a row's k neighbours in y that isn't one in x, by its rank there; 1 is best."""
    n = len(x)
    rank = np.empty((n, n), np.int64)
    dx, dy = distances(x), distances(y)
    np.fill_diagonal(dx, -1)
    np.fill_diagonal(dy, -1)
    np.put_along_axis(rank, np.argsort(dx, axis=1, kind="stable"), np.arange(n)[None].repeat(n, 0), 1)
    near = np.argsort(dy, axis=1, kind="stable")[:, 1 : k + 1]
    late = np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum()
    return 1 - 2 * float(late) / (n * k * (2 * n - 3 * k - 1))
