"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are scaled to unit length and rotated to the principal axes of a bounded sample (at most `SAMPLE` vectors; the
rotation decides how much is pruned, never what is found). A tree of splits along the leading axes cuts the space into
tiles, as many as there are blocks of `BLOCK_BYTES`, at least `LEAST_TILES` and at most `MAX_TILES` (the driver holds their
pairs); two tiles whose boxes are farther apart than the threshold allows never meet. Larger tiles are dealt into blocks,
and each pair of blocks is one task of bounded size. There, the leading axes' products come first; what the other axes can
add is at most the product of the two suffix norms, so a pair stops as soon as its cosine cannot reach the threshold. What
is left is computed in double precision on the vectors as given.

A vector is shipped once for each block that its own may meet. Where boxes keep nothing apart, that is the number of all
blocks, which stays at `LEAST_TILES` until blocks are full and then grows with the input, as the comparisons do.

Equal vectors form a class of which one takes part, with its number of copies. A task gives each vector's number of
links and a spanning forest of its links, never the links themselves, so dense groups make no more rows than vectors.

Edge cases: a vector that is null, empty or zero, or holds a null or non-finite component, links with nothing, and so does
a row whose id is null (op10 keeps it); vectors of different lengths do not link, and more than `MAX_DIMS` different
lengths are an error; a cosine of exactly the threshold, as doubles give it, links; rows of one id are vectors of their own, with links
and components of their own; long vectors make blocks of fewer rows; repeated rows count as vectors; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvan.llm.common import materialise, quoted, scratch, table
from silvan.llm.components import connected_components

SAMPLE = 4_096
LEAST_TILES, MAX_TILES = 8, 1_024
#: A block's vectors in double precision, and its rows at least where vectors are long.
BLOCK_BYTES, LEAST_ROWS = 1 << 24, 4_096
#: Different lengths of vectors, each of which is a pass of its own.
MAX_DIMS = 64
#: Leading axes that the tiles' boxes have.
BOX_AXES = 16
#: Share of the sample's pairs that may be left after the first comparison; it takes as many leading axes as that needs.
LEFT = 0.01
#: Rows of the left block compared at once, and pairs completed at once.
STRIP, PAIRS = 512, 1 << 16


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length, scaled first so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Columns are the axes of the sample's second moments, largest first: what matters is the size of products, not of differences."""
    values, vectors = np.linalg.eigh(sample.T @ sample)
    return vectors[:, np.argsort(-values)]


def _suffix(x: np.ndarray, k: int) -> np.ndarray:
    return np.sqrt((x[:, k:] ** 2).sum(axis=1))


def leading(rotated: np.ndarray, threshold: float) -> tuple[int, int]:
    """Leading axes of the first and of the second comparison, from pairs of the sample's rows: steps of 8 until few are left."""
    a, b, d = rotated[0:1024:2], rotated[1:1024:2], rotated.shape[1]
    for k in range(8, d, 8):
        left = a[:, :k] @ b[:, :k].T + np.outer(_suffix(a, k), _suffix(b, k)) >= threshold
        if not left.size or left.mean() <= LEFT:
            return k, min(d, 2 * k)
    return d, d


def block_rows(dim: int) -> int:
    return max(LEAST_ROWS, BLOCK_BYTES // (8 * dim))


class Tiles:
    """Boxes of the leading axes from median splits of the sample along its widest axis."""

    def __init__(self, sample: np.ndarray, n: int):
        self.axes = min(BOX_AXES, sample.shape[1])
        self.splits: list[tuple[int, float, int, int]] = []  # axis, value, child below, child from it; a child < 0 is tile -1 - child
        self.low, self.high = [], []
        self.root = self._grow(sample[:, : self.axes], n, np.full(self.axes, -1.0), np.full(self.axes, 1.0))

    def _grow(self, x: np.ndarray, n: int, low: np.ndarray, high: np.ndarray) -> int:
        axis = int(np.ptp(x, axis=0).argmax()) if len(x) > 1 else 0
        value = float(np.median(x[:, axis])) if len(x) else 0.0
        below = x[:, axis] < value if len(x) else np.zeros(0, bool)
        if n < 2 or len(x) < 16 or not below.any():
            self.low.append(low)
            self.high.append(high)
            return -len(self.low)
        at = len(self.splits)
        self.splits.append((axis, value, 0, 0))
        cut = lambda box, v: np.where(np.arange(self.axes) == axis, v, box)
        a = self._grow(x[below], n // 2, low, cut(high, value))
        b = self._grow(x[~below], n - n // 2, cut(low, value), high)
        self.splits[at] = (axis, value, a, b)
        return at

    def of(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int64), [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                axis, value, a, b = self.splits[node]
                below = x[rows, axis] < value
                todo += [(a, rows[below]), (b, rows[~below])]
        return out

    def pairs(self, threshold: float) -> list[tuple[int, int]]:
        """Tiles that can hold two unit vectors with that cosine: their distance is at most sqrt(2 - 2 * threshold)."""
        low, high = np.array(self.low), np.array(self.high)
        out = []
        for i in range(len(low)):
            gap = np.maximum(0, np.maximum(low[i:] - high[i], low[i] - high[i:]))
            out += [(i, i + int(j)) for j in np.flatnonzero((gap * gap).sum(axis=1) <= 2 - 2 * threshold + 1e-9)]
        return out


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of each i and j in place; a tree's label is its smallest node."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def linked(raw_a: np.ndarray, raw_b: np.ndarray, axes: np.ndarray, threshold: float, same: bool, leads: tuple[int, int]):
    """Yields arrays (i, j) of rows with cosine >= threshold; within one block (same) only i < j."""
    ua, ub = unit(raw_a), unit(raw_b)
    a, b = ua @ axes, ub @ axes
    k, k2 = leads
    # One product gives what the leading axes have and what the others can add.
    lead_a = np.column_stack((a[:, :k], _suffix(a, k))).astype(np.float32)
    lead_b = np.column_stack((b[:, :k], _suffix(b, k))).astype(np.float32)
    rest_a, rest_b = _suffix(a, k2), _suffix(b, k2)
    for at in range(0, len(a), STRIP):
        bound = lead_a[at : at + STRIP] @ lead_b.T
        i, j = np.nonzero(bound >= threshold - 1e-5)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), PAIRS):
            p, q = i[s : s + PAIRS], j[s : s + PAIRS]
            dot = np.einsum("ij,ij->i", a[p, :k2], b[q, :k2])
            keep = dot + rest_a[p] * rest_b[q] >= threshold - 1e-9
            p, q = p[keep], q[keep]
            if len(p):
                keep = np.einsum("ij,ij->i", ua[p], ub[q]) >= threshold - 1e-9
                p, q = p[keep], q[keep]
                keep = _cosine(raw_a[p], raw_b[q]) >= threshold
                yield p[keep], q[keep]


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300), y / np.abs(y).max(axis=1, keepdims=True, initial=1e-300)
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def _compare(classes: DataFrame, tiles: Tiles, axes: np.ndarray, threshold: float, width: int, leads: tuple[int, int], rows: int) -> DataFrame:
    """id, links, root for each class and pair of blocks in which it has links. classes: id, copies, tile, vec (binary)."""
    spark = classes.sparkSession
    blocks = {r["tile"]: -(-r["count"] // rows) for r in classes.groupBy("tile").count().collect()}
    met = [(i, j, blocks[i], blocks[j]) for i, j in tiles.pairs(threshold) if i in blocks and j in blocks]
    columns = zip(*met, strict=True) if met else ((), (), (), ())
    met_table = spark.createDataFrame(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("i", "j", "ni", "nj"), columns, strict=True)}))
    met_table = F.broadcast(met_table)  # at most MAX_TILES * (MAX_TILES + 1) / 2 rows
    held = classes.withColumn("hash", F.xxhash64("id"))
    payload = ("id", "copies", "vec")
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    left = held.join(met_table, F.col("tile") == F.col("i")).withColumn("bi", F.pmod("hash", F.col("ni")))
    left = left.select("i", "j", "bi", F.explode(up_to(F.col("nj"))).alias("bj"), F.lit(0).alias("side"), *payload).filter("i < j or bi <= bj")
    right = held.join(met_table, F.col("tile") == F.col("j")).withColumn("bj", F.pmod("hash", F.col("nj")))
    right = right.select("i", "j", F.explode(up_to(F.col("ni"))).alias("bi"), "bj", F.lit(1).alias("side"), *payload).filter("i < j or bi < bj")
    dtype = "<f4" if width == 4 else "<f8"

    def compare(part: pa.Table) -> pa.Table:
        side = part["side"].to_numpy()
        ids, copies = part["id"].to_numpy(), part["copies"].to_numpy()
        x = np.frombuffer(b"".join(part["vec"].to_pylist()), dtype).reshape(len(ids), -1).astype(np.float64)
        order = np.argsort(ids, kind="stable")  # so that the smallest node has the smallest number
        side, ids, copies, x = side[order], ids[order], copies[order], x[order]
        la, lb = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(lb) and part["i"][0] == part["j"][0] and part["bi"][0] == part["bj"][0]
        lb = la if same else lb
        label, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        if len(la) and len(lb):
            for p, q in linked(x[la], x[lb], axes, threshold, same, leads):
                p, q = la[p], lb[q]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                unite(label, p, q)
        hit = links > 0
        return pa.table({"id": pa.array(ids[hit]), "links": pa.array(links[hit]), "root": pa.array(ids[label[hit]])})

    return left.unionByName(right).groupBy("i", "j", "bi", "bj").applyInArrow(compare, "id long, links long, root long")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: the id, n_links, component_id (the smallest id that its links reach)."""
    with scratch(vectors.sparkSession) as keep:
        return keep(_near(vectors, threshold, id_col, vec_col), "near-vectors")


def _near(vectors: DataFrame, threshold: float, id_col: str, vec_col: str) -> DataFrame:
    width = 4 if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else 8
    dtype = "<f4" if width == 4 else "<f8"
    v = F.col("v")
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))
    usable = F.col("id").isNotNull() & v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vec_col)).alias("v"))
    rows = rows.select("id", F.when(F.coalesce(usable, F.lit(False)), v if width == 4 else v.cast("array<double>")).alias("v"))
    alone = rows.filter("v is null").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    rows = rows.filter("v is not null").withColumns({"k1": F.xxhash64(F.lit(1), "v"), "k2": F.xxhash64(F.lit(2), "v")})
    classes = rows.groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
    # Different vectors may have one id, so a class is known by a number of its own until the end.
    classes = materialise(classes.withColumns({"dim": F.size("v"), "id": F.monotonically_increasing_id()}), "vector-classes")
    dims = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().limit(MAX_DIMS + 1).collect()}
    if len(dims) > MAX_DIMS:
        raise ValueError(f"vectors of more than {MAX_DIMS} lengths")
    found = None
    for dim, n in sorted(dims.items()):
        own = classes.filter(F.col("dim") == dim)
        spread = 1 << 30
        sampled = own.filter(F.pmod(F.xxhash64("k1", F.lit(9)), F.lit(spread)) < min(spread, SAMPLE * spread // n + 1)).select("v").limit(2 * SAMPLE).collect()
        sample = unit(np.array([r["v"] for r in sampled] or [[1.0] * dim], np.float64))
        axes = principal_axes(sample)
        tiles = Tiles(sample @ axes, min(MAX_TILES, max(LEAST_TILES, -(-n // block_rows(dim)))))

        def place(batches, axes=axes, tiles=tiles, dim=dim):
            for batch in batches:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                if len(x):
                    tile = tiles.of(unit(x.astype(np.float64)) @ axes)
                    raw = [r.astype(dtype).tobytes() for r in x]
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copies"), pa.array(tile), pa.array(raw, pa.binary())], ["id", "copies", "tile", "vec"])

        placed = materialise(own.select("id", "copies", "v").mapInArrow(place, "id long, copies long, tile long, vec binary"), "tiles")
        part = _compare(placed, tiles, axes, threshold, width, leading(sample @ axes, threshold), block_rows(dim))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return alone
    found = materialise(found, "vector-links")
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected_components(found, "id", "root").withColumnRenamed("component", "root")
    owner = classes.select("k1", "k2", "id", "least", "copies").join(sums, "id", "left").join(roots, "id", "left")
    owner = owner.select("k1", "k2", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("root"))
    components = owner.groupBy("root").agg(F.min("least").alias("component_id"))
    owner = owner.join(components, "root").select("k1", "k2", "n_links", "component_id")
    out = rows.select("id", "k1", "k2").join(owner, ["k1", "k2"])
    return out.select(F.col("id").alias(id_col), "n_links", "component_id").unionByName(alone)


def op10_embedding_dedup(spark, sf_dir):
    found = near_vectors(table(spark, sf_dir, "embeddings"), 0.9)
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


QUERIES = {"op10_embedding_dedup": op10_embedding_dedup}

SQL = {
    "op10_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(vec_id, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.y FROM r JOIN l ON l.x = r.seen),
m AS (SELECT vec_id, min(seen) AS component_id FROM r GROUP BY vec_id)
SELECT v.vec_id, CAST((SELECT count(*) FROM l WHERE l.x = v.vec_id) AS BIGINT) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN m ON m.vec_id = v.vec_id
"""
}
