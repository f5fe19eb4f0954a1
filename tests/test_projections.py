"""Voronoi cells, neighbour graphs, UMAP, PHATE and Isomap against plain NumPy."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvan.operators import cells, manifold

# ---- cells ----


def plain_cells(rows, pad=0.04):
    """Every point of the group cuts every cell."""
    xy = np.array([r[2:] for r in rows], float)
    (x0, y0), (x1, y1) = xy.min(0), xy.max(0)
    px, py = (x1 - x0) * pad, (y1 - y0) * pad
    box = [(x0 - px, y0 - py), (x1 + px, y0 - py), (x1 + px, y1 + py), (x0 - px, y1 + py)]
    out = {}
    for i, g, *p in rows:
        mine = [np.array(r[2:]) for r in rows if r[1] == g]
        polygon = box
        for q in sorted(mine, key=lambda q: ((q - p) ** 2).sum()):
            if (q != p).any() and len(polygon) >= 3:
                polygon = cells.clip(polygon, np.array(p), q)
        if len(mine) > 1 and len(polygon) >= 3:
            out[i] = polygon
    return out, (x1 - x0 + 2 * px) * (y1 - y0 + 2 * py)


def area(polygon):
    x, y = np.array(polygon).T
    return abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2


@pytest.mark.parametrize("most", [24, 1024])
def test_cells_against_all_points(spark, most):
    rng = np.random.default_rng(most)
    # A wide cloud, a third of all points in a tiny place, a row of points, one place twice, a group of one.
    xy = np.vstack((rng.normal(size=(120, 2)) * 10, 5 + rng.random((70, 2)) * 1e-3, np.column_stack((np.arange(20.0), np.full(20, -31.0)))))
    rows = [(k, k % 2 if k < 120 else 0, float(x), float(y)) for k, (x, y) in enumerate(xy)] + [(900, 0, *map(float, xy[0])), (901, 7, 0.0, 0.0)]
    df = spark.createDataFrame([*rows, (902, 0, None, 1.0), (903, 0, float("nan"), 1.0)], "id long, g int, x double, y double").repartition(3)
    found = cells.voronoi(df, "g", "id", most=most)
    got = {r["id"]: (r["cell"], r["a"]) for r in found.withColumn("a", cells.area(F.col("cell"))).collect()}
    want, box = plain_cells(rows)
    assert got.keys() == want.keys() and 901 not in got and got[900][0] == got[0][0]
    for i, (polygon, a) in got.items():
        assert a == pytest.approx(area(want[i]), rel=1e-6, abs=1e-12)
        assert np.allclose(np.sort(np.array(polygon), 0).min(0), np.array(want[i]).min(0), atol=1e-6) and np.allclose(np.array(polygon).max(0), np.array(want[i]).max(0), atol=1e-6)
    for g in (0, 1):
        assert sum(got[r[0]][1] for r in rows if r[1] == g and r[0] != 900) == pytest.approx(box)


def test_cells_of_a_lattice_of_nulls_and_of_nothing(spark):
    p = spark.createDataFrame([(1, None, 0.0, 0.0), (2, None, 1.0, 0.0), (3, None, 0.0, 1.0), (4, None, 1.0, 1.0)], "id long, g int, x double, y double")
    assert sorted((r["id"], len(r["cell"])) for r in cells.voronoi(p, "g", "id").collect()) == [(k, 4) for k in (1, 2, 3, 4)]
    assert cells.voronoi(p.limit(0), "g", "id").count() == 0 == cells.voronoi(p.filter("id = 1"), "g", "id").count()


# ---- neighbours ----


def roll(n, seed=1):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.random(n)) * 3 * np.pi + 1.5
    return np.stack((t * np.cos(t), rng.random(n) * 10, t * np.sin(t)), 1), t


def test_neighbours_are_exact(spark):
    x = np.random.default_rng(2).normal(size=(1300, 20))
    x[7] = x[900]
    near, away = manifold.knn(spark, x, 6)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert np.allclose(away, np.sort(d, 1)[:, :6]) and near[7, 0] == 900 and near[900, 0] == 7
    assert manifold.knn(spark, x[:3], 10)[0].shape == (3, 2)


# ---- UMAP ----


def test_memberships_and_union():
    away = np.sort(np.random.default_rng(3).random((50, 9)), 1)
    away[0, :3] = 0
    s = manifold.memberships(away, 10)
    assert np.allclose(s[1:].sum(1), np.log2(10)) and (s[1:, 0] == 1).all() and (np.diff(s, axis=1) <= 0).all() and (s[0, :4] == 1).all()
    near = np.stack([np.random.default_rng(k).permutation(np.delete(np.arange(50), k))[:9] for k in range(50)])
    dense = np.zeros((50, 50))
    dense[np.repeat(np.arange(50), 9), near.ravel()] = s.ravel()
    i, j, w = manifold.fuzzy_union(near, s)
    got = np.zeros((50, 50))
    got[i, j] = got[j, i] = w
    assert np.allclose(got, dense + dense.T - dense * dense.T) and (i < j).all()


def test_curve_is_the_least_squares_one():
    d = np.linspace(0, 3, 300)[1:]
    want = np.where(d < 0.1, 1, np.exp(-(d - 0.1)))
    a, b = manifold.curve(0.1)
    off = lambda a, b: ((1 / (1 + a * d ** (2 * b)) - want) ** 2).sum()
    assert all(off(a, b) <= off(a + da, b + db) for da in (-1e-3, 0, 1e-3) for db in (-1e-3, 0, 1e-3)) and (round(a, 2), round(b, 2)) == (1.58, 0.9)


def test_spectral_start_is_the_graphs_smoothest(spark):
    x, _ = roll(200)
    near, away = manifold.knn(spark, x, 8)
    i, j, w = manifold.fuzzy_union(near, manifold.memberships(away, 9))
    m = np.zeros((200, 200))
    m[i, j] = m[j, i] = w
    root = np.sqrt(m.sum(1))
    values, vectors = np.linalg.eigh(m / root / root[:, None])
    got = manifold.spectral(i, j, w, manifold.principal(x, 2), rounds=4_000) * root[:, None]
    got /= np.linalg.norm(got, axis=0)
    assert np.linalg.norm(vectors[:, -3:].T @ got, axis=0) == pytest.approx(1, abs=1e-3) and values[-1] == pytest.approx(1)


def test_umap_keeps_neighbours_and_repeats(spark):
    x, t = roll(600)
    fit, again = (manifold.umap(spark, x, epochs=200) for _ in range(2))
    assert (fit.coords == again.coords).all() and fit.coords.shape == (600, 3)
    assert manifold.trustworthiness(manifold.unit_rows(x), fit.coords, 10) > 0.95
    rng = np.random.default_rng(4)
    clusters = np.vstack([rng.normal(size=(80, 16)) * 0.1 + 3 * np.eye(16)[k] for k in range(4)])
    y = manifold.umap(spark, clusters, epochs=200).coords
    d = manifold.distances(y)
    np.fill_diagonal(d, np.inf)
    assert (d.argmin(1) // 80 == np.arange(320) // 80).all()
    assert manifold.umap(spark, x[:3]).coords.shape == (3, 3)
    with pytest.raises(ValueError, match="too large"):
        manifold.umap(spark, x, most=599)


def test_all_vectors_are_placed_whatever_their_tasks(spark):
    x, _ = roll(400)
    fit = manifold.umap(spark, x[::2], epochs=50)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [1.0, None, 2.0]), (902, x[0].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    one, many = ({r["id"]: r["coords"] for r in manifold.place(df.repartition(n), "v", fit).collect()} for n in (1, 7))
    assert one == many and one[900] is None and one[901] is None and one[902] == one[0]
    assert np.allclose([one[k] for k in range(0, 400, 2)], fit.coords)
    # A row between two neighbours of the sample is near them.
    gap = np.linalg.norm(np.array([one[k] for k in range(1, 399, 2)]) - (fit.coords[:-1] + fit.coords[1:])[: 199] / 2, axis=1)
    assert np.median(gap) < np.median(manifold.distances(fit.coords)) / 3
    with pytest.raises(ValueError, match="no vectors"):
        manifold.take_sample(df.filter("v is null"), "id", "v", 5)
    assert manifold.take_sample(df, "id", "v", 1000).shape == (400, 3) and manifold.take_sample(df, "id", "v", 5).shape == (5, 3)


# ---- PHATE ----


def test_diffusion_and_its_powers():
    x, _ = roll(150)
    d = manifold.distances(x)
    np.fill_diagonal(d, 0)
    k, total = manifold.diffusion(d, 5, 40)
    plain = np.zeros((150, 150))
    for a in range(150):
        band = sorted(d[a])[5]
        for b in range(150):
            plain[a, b] = np.exp(-((d[a, b] / band) ** 40)) if d[a, b] < 3 * band else 0
    plain[plain < 1e-4] = 0
    plain = (plain + plain.T) / 2
    assert np.allclose(k, plain) and np.allclose(total, plain.sum(1))
    fit = manifold.phate(x, t=7)
    power = np.linalg.matrix_power(plain / plain.sum(1, keepdims=True), 7)
    potential = -np.log(power + 1e-7)
    away = np.sqrt(((potential[:, None] - potential) ** 2).sum(2))
    # The places are a minimum of the stress: moving any of them makes it no smaller.
    stress = lambda y: ((away - manifold.distances(y)) ** 2).sum()
    assert stress(fit.coords) < stress(manifold.classical_mds(away, 3)) and fit.t == 7
    rng = np.random.default_rng(1)
    assert all(stress(fit.coords + 1e-2 * away.mean() * rng.normal(size=fit.coords.shape)) > stress(fit.coords) for _ in range(5))


def test_time_is_at_the_entropys_knee():
    values = np.array([1.0] * 3 + [0.5] * 200)
    h = []
    for t in range(1, 101):
        p = values**t / (values**t).sum()
        h.append(-(p * np.log(np.maximum(p, 1e-300))).sum())

    def off(ts):
        y = [h[t - 1] for t in ts]
        c = np.polyfit(ts, y, 1) if len(ts) > 1 else [0, y[0]]
        return ((np.polyval(c, ts) - y) ** 2).sum()

    want = min(range(2, 100), key=lambda t: off(range(1, t + 1)) + off(range(t, 101)))
    assert manifold.entropy_time(values) == want


def test_scaling_finds_known_places():
    y = np.random.default_rng(6).normal(size=(60, 3))
    d = manifold.distances(y)
    start = y + 0.3 * np.random.default_rng(7).normal(size=y.shape)
    assert np.allclose(manifold.distances(manifold.metric_mds(d, start, rounds=2000, enough=1e-12)), d, atol=1e-2)
    assert np.allclose(manifold.distances(manifold.classical_mds(d, 3)), d, atol=1e-6)


def test_phate_keeps_neighbours_and_places_new_rows(spark):
    x, t = roll(400)
    fit = manifold.phate(x[::2])
    assert manifold.trustworthiness(x[::2], fit.coords, 8) > 0.95 and 1 <= fit.t <= 100
    assert np.allclose(fit.place(x[::2]), fit.coords)
    d = manifold.distances(np.vstack((fit.place(x[1::2]), fit.coords)))[:200, 200:]
    assert np.median(np.abs(t[::2][d.argmin(1)] - t[1::2])) < 0.2
    assert manifold.phate(x[:1]).coords.shape == (1, 3) and manifold.phate(x[:2]).coords.shape == (2, 3)


# ---- Isomap ----


def test_ways_against_dijkstra(spark):
    x, _ = roll(5_000)
    near, away = manifold.knn(spark, x, 6)
    i, j = np.repeat(np.arange(5_000), 6), near.ravel()
    sources = np.array([0, 17, 2_500, 4_999])
    got = manifold.ways(spark, 5_000, i, j, away.ravel(), sources, width=2)
    links = [[] for _ in range(5_000)]
    for a, b, d in zip(i.tolist(), j.tolist(), away.ravel().tolist()):
        links[a].append((b, d))
        links[b].append((a, d))
    for at, source in enumerate(sources.tolist()):
        best = [np.inf] * 5_000
        best[source], heap = 0.0, [(0.0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d == best[a]:
                for b, w in links[a]:
                    if d + w < best[b]:
                        best[b] = d + w
                        heapq.heappush(heap, (d + w, b))
        assert np.allclose(got[:, at], best)


def test_isomap_unrolls(spark):
    x, t = roll(900)
    fit = manifold.isomap(spark, x[::3], 8, 2, landmarks=120)
    assert abs(np.corrcoef(fit.coords[:, 0], t[::3])[0, 1]) > 0.97
    assert np.allclose(fit.place(x[::3]), fit.coords)
    new = fit.place(x[1::3])
    assert abs(np.corrcoef(new[:, 0], t[1::3])[0, 1]) > 0.97
    # With all rows as landmarks the places are those of plain scaling.
    every = manifold.isomap(spark, x[:150], 8, 2)
    plain = manifold.classical_mds((every.geodesic + every.geodesic.T) / 2, 2)
    assert np.allclose(manifold.distances(every.coords), manifold.distances(plain), atol=1e-6)


def test_isomap_joins_parts_and_takes_few_rows(spark):
    x, _ = roll(120)
    far = np.vstack((x, x + [500, 0, 0], [[0, 9_000, 0]]))
    fit = manifold.isomap(spark, far, 6, 2)
    assert np.isfinite(fit.geodesic).all()
    assert fit.geodesic[:120, 120:240].min() == pytest.approx(np.sqrt(((x[:, None] - x - [500, 0, 0]) ** 2).sum(2)).min())
    assert (manifold.isomap(spark, x[:1]).coords == 0).all() and manifold.isomap(spark, x[:2]).coords.shape == (2, 3)
    with pytest.raises(ValueError, match="no vectors"):
        manifold.isomap(spark, x[:0])
    with pytest.raises(ValueError, match="too large"):
        manifold.isomap(spark, x, most=5)
