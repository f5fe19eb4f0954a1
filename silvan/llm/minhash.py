"""MinHash near-dedup with sequential Bayesian verification.

A document's set is its distinct shingles of `words` words. Documents with equal sets form a class, and from then on only
one document stands for it. A class's signature is `bands` * `rows` minima; classes with an equal band meet in a bucket.
A pair of a bucket is verified in turn: its signatures are compared batch by batch and it is pruned as soon as the
posterior probability of a similarity of `threshold` falls below `miss`; the survivors are verified on their full sets.

No bucket is paired off in full. Its smallest member is its head, and only member and head are compared:
- a member that is similar to the head is held by it and leaves the bucket;
- all others stay and meet the next head, for `HEAD_ROUNDS` rounds; the few then left are compared to each other;
- by the triangle inequality of the Jaccard distance, only a member whose similarity to the head is 2 * threshold - 1 or
  more can be similar to one that the head holds, and only if their distances to the head differ by no more than
  1 - threshold. Such a member, unless it is in the head's component by then, is compared to those.
These last comparisons run in blocks of bounded size, first on signatures and sizes alone: a pair of blocks names those of
its members that have a pair left. Only these get their full sets, in the same pairs of blocks, and are verified there,
likeliest first; a pair that is of one component by then is passed over, and only verified links leave a block. So all
links between different components are found, and links within a component only as far as the component needs them; what
is shipped is signatures, sets of survivors and links, never pairs. `HEAD_ROUNDS` and the block sizes say how the work is
dealt, not what is found.

Edge cases: a document with fewer words than a shingle has its whole sequence as its only shingle; without words, or with
a null text, its set is empty and it is linked with nothing; repeated rows have equal sets; a class has a number of its
own, so rows with the same doc_id or none are judged by their texts; doc_id only says which row of a group is chosen: the
one with the smallest, null last, and of several texts with that doc_id the one whose hash is smallest; a group without
any doc_id has a null component_id, and kept still says which of its rows stays; very long texts are read whole, and their
sets only make blocks smaller; a similarity of exactly the threshold links; an empty table gives no rows; other columns,
whatever their names, are ignored by `near_duplicates` and kept by `drop_near_duplicates`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvan.llm.common import columns_of, materialise, scratch, table
from silvan.llm.components import connected_components

BANDS, ROWS, BATCH = 32, 5, 32
SEED = 7
MISS = 1e-6
HEAD_ROUNDS = 4
#: Rows and numbers in sets of a block on either side, about.
LEFT_ROWS, RIGHT_ROWS, LEFT_SETS, RIGHT_SETS = 256, 4_096, 1 << 20, 1 << 22
#: Hashes of words that a worker keeps: some 12 MB. It only saves work; any number gives the same sets.
WORDS_HELD = 1 << 16
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class _WordHashes(dict):
    """64-bit hash of each word met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


_hashes = _WordHashes()


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes split at space and tab to return
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(h))
    n = len(h) - width + 1
    mixed = np.full(n, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class Minima:
    """Minima of n linear hashes of the shingles, 32 bits each."""

    def __init__(self, n: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, np.uint32)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 2048):
            out = np.minimum(out, (np.multiply.outer(self.a, x[at : at + 2048]) + self.b[:, None]).min(axis=1))
        return out


@dataclass(frozen=True)
class Bounds:
    """least: for each batch, the equal signature bytes below which P(similarity >= threshold) < miss.

    The posterior has a uniform prior; a byte is equal with probability c = s + (1 - s) / 256 for a similarity s.
    """

    least: tuple[int, ...]
    batch: int

    @staticmethod
    def of(threshold: float, n: int, batch: int = BATCH, miss: float = MISS) -> Bounds:
        c = np.linspace(1 / 256, 1, 20_001)[:-1] + 0.5 * (255 / 256) / 20_000
        high = c >= threshold + (1 - threshold) / 256

        def above(m: int, n: int) -> float:
            logs = m * np.log(c) + (n - m) * np.log(1 - c)
            w = np.exp(logs - logs.max())
            return float(w[high].sum() / w.sum())

        return Bounds(tuple(next((m for m in range(k + 1) if above(m, k) >= miss), k + 1) for k in range(batch, n + 1, batch)), batch)

    def survives(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of two signature arrays that no batch prunes, and their equal bytes."""
        alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
        for k, least in enumerate(self.least):
            cut = slice(k * self.batch, (k + 1) * self.batch)
            matches = matches + (a[alive, cut] == b[alive, cut]).sum(axis=1, dtype=np.int32)
            keep = matches >= least
            alive, matches = alive[keep], matches[keep]
        return alive, matches


def _hashed(docs: DataFrame) -> DataFrame:
    """docs with h, a hash of doc_id and text: both together tell a row from all but its exact copies."""
    return docs.withColumn("__h", F.xxhash64("doc_id", "text"))


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, h (of _hashed), n (size of the set), fp (its fingerprint), keys (one hash for each band), sig (a byte for each minimum)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima, place = Minima(bands * rows), np.arange(1, bands + 1, dtype=np.uint64)
        for batch in batches:
            n, fp, keys, sig = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, words)
                n.append(len(s))
                fp.append(fingerprint(s))
                if not len(s):
                    keys.append(None)
                    sig.append(None)
                    continue
                m = minima(s)
                key = place.copy()
                for k in range(rows):
                    key = (key ^ m.reshape(bands, rows)[:, k]) * np.uint64(0xD6E8FEB86659FD93)
                    key ^= key >> np.uint64(32)
                keys.append(key.view(np.int64))
                sig.append((m & np.uint32(0xFF)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("__h"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                ["doc_id", "h", "n", "fp", "keys", "sig"],
            )

    return _hashed(docs.select("doc_id", "text")).mapInArrow(sign, f"doc_id {kind}, h long, n long, fp binary, keys array<bigint>, sig binary")


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, n)


def _prune(pairs: DataFrame, classes: DataFrame, bounds: Bounds, n: int) -> DataFrame:
    """Those pairs (x, y) whose signatures survive."""
    sigs = classes.select(F.col("rep").alias("x"), F.col("sig").alias("sx"))
    both = pairs.join(sigs, "x").join(sigs.toDF("y", "sy"), "y")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive, _ = bounds.survives(_matrix(batch.column("sx"), n), _matrix(batch.column("sy"), n))
            yield batch.select(["x", "y"]).take(pa.array(alive))

    kind = pairs.schema["x"].dataType.simpleString()
    return both.select("x", "y", "sx", "sy").mapInArrow(judge, f"x {kind}, y {kind}")


def _exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (x, y) with the sizes of the intersection and the union of their full sets."""
    both = pairs.join(sets.toDF("x", "a"), "x").join(sets.toDF("y", "b"), "y")
    both = both.select("x", "y", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), (F.size("a") + F.size("b")).cast("long").alias("both"))
    return both.select("x", "y", "shared", (F.col("both") - F.col("shared")).alias("whole"))


def shared_size(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two arrays of distinct numbers."""
    both = np.sort(np.concatenate((a, b)))
    return int((both[1:] == both[:-1]).sum())


def _compare_blocks(left: DataFrame, right: DataFrame, sets: DataFrame, bounds: Bounds, n: int, percent: int, slack: float, same: bool) -> DataFrame:
    """Verified links (x, y) of left and right within each g between different components, whose d differ by slack at most.

    Both are tables (g, id, sig, n, d, c), n the size of the set, c the component so far; sets: rep, set. Both sides of a g
    are cut into blocks by hash, and a block meets every block of the other side, so a task's rows are bounded for any size
    of g. same: both are one table.
    """

    def sizes(df: DataFrame, rows: int, numbers: int, name: str) -> DataFrame:
        return df.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum("n") / numbers)).cast("long").alias(name))

    counts = sizes(left, LEFT_ROWS, LEFT_SETS, "nl").join(sizes(right, RIGHT_ROWS, RIGHT_SETS, "nr"), "g")
    place = lambda count: F.pmod(F.xxhash64("id", F.lit(SEED)), F.col(count))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    key, payload = ("g", "lb", "rb"), ("id", "sig", "n", "d", "c")
    apart = lambda df, more: df.select(*(F.col(c).alias(f"{c}_") for c in (*key, *payload, *more)))  # noqa: E731, columns of its own: both may come from one table
    left = left.join(counts, "g").select("g", place("nl").alias("lb"), each("nr").alias("rb"), *payload)
    right = right.join(counts, "g").select("g", each("nl").alias("lb"), place("nr").alias("rb"), *payload)
    kinds = {c: left.schema[c].dataType.simpleString() for c in ("g", "id")}

    def candidates(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """Each row of a with the rows of b that it may be linked with, likeliest first."""
        ids, far, owner, size = b["id_"].to_numpy(), b["d_"].to_numpy(), b["c_"].to_numpy(), b["n_"].to_numpy()
        other = np.frombuffer(b"".join(b["sig_"]), np.uint8).reshape(-1, n)
        for row, (x, sig, mine, d, c) in enumerate(zip(a["id"], a["sig"], a["n"], a["d"], a["c"], strict=True)):
            near = 100 * np.minimum(size, mine) >= percent * np.maximum(size, mine)
            rows = np.flatnonzero(near & (np.abs(far - d) <= slack) & (owner != c) & ((ids < x) if same else (ids != x)))
            alive, matches = bounds.survives(np.broadcast_to(np.frombuffer(sig, np.uint8), (len(rows), n)), other[rows])
            if len(alive):
                yield row, rows[alive[np.argsort(-matches, kind="stable")]]

    def survivors(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        mine, others = [], np.zeros(len(b), bool)
        if len(a) and len(b):
            for row, rows in candidates(a, b):
                mine.append(row)
                others[rows] = True
        kept = [(side, *k, i) for side, df, rows, names in ((0, a, mine, (*key, "id")), (1, b, np.flatnonzero(others), tuple(f"{c}_" for c in (*key, "id")))) for *k, i in df.iloc[rows][list(names)].itertuples(index=False)]
        return pd.DataFrame(kept, columns=["side", *key, "id"])

    def verify(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(b):
            ids, owner, sets, joined = b["id_"].to_numpy(), b["c_"].to_numpy(), b["set_"].to_numpy(), {}

            def root(c):
                while c in joined:
                    c = joined[c]
                return c

            held = list(zip(a["id"], a["set"], a["c"], strict=True))
            for row, rows in candidates(a, b):
                x, mine, c = held[row]
                for k in rows:
                    if root(c) == root(owner[k]):
                        continue
                    shared = shared_size(mine, sets[k])
                    if 100 * shared >= percent * (len(mine) + len(sets[k]) - shared):
                        out.append((x, ids[k]))
                        joined[root(c)] = root(owner[k])
        return pd.DataFrame(out, columns=["x", "y"])

    both = left.groupBy(*key).cogroup(apart(right, ()).groupBy(*(f"{c}_" for c in key)))
    found = materialise(both.applyInPandas(survivors, f"side int, g {kinds['g']}, lb long, rb long, id {kinds['id']}"), "survivors")
    held = sets.withColumnRenamed("rep", "id")
    side = lambda df, which: df.join(found.filter(F.col("side") == which).drop("side"), [*key, "id"], "left_semi").join(held, "id")
    last = apart(side(right, 1), ("set",))
    return side(left, 0).groupBy(*key).cogroup(last.groupBy(*(f"{c}_" for c in key))).applyInPandas(verify, f"x {kinds['id']}, y {kinds['id']}")


def _several(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """members (key, x) of buckets with members of more than one component."""
    if found is None:
        ends = members.groupBy("key").agg(F.min("x").alias("y"), F.max("x").alias("z"))
    else:
        owned = members.join(found.withColumnRenamed("id", "x"), "x", "left").withColumn("c", F.coalesce("component", "x"))
        ends = owned.groupBy("key").agg(F.min("c").alias("y"), F.max("c").alias("z"))
    return members.join(ends.filter("y != z").select("key"), "key")


def full_sets(docs: DataFrame, ids: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """rep, set of each class in ids (rep): its chosen row is read again, so only what was a candidate holds a set."""
    chosen = classes.select("rep", "fp", F.col("h").alias("__h")).join(ids, "rep", "left_semi")
    texts = _hashed(docs.select("doc_id", "text")).join(chosen, "__h")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, last = [], [], None
            for rep, text, fp in zip(batch.column("rep").to_pylist(), batch.column("text").to_pylist(), batch.column("fp").to_pylist(), strict=True):
                if rep == last:  # exact copies of a row come one after the other
                    continue
                s = shingle_set(text, words)
                if fingerprint(s) == fp:  # another row may have the same hash
                    ids.append(rep)
                    held.append(s.view(np.int64))
                    last = rep
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.list_(pa.int64()))], ["rep", "set"])

    return texts.select("rep", "text", "fp").mapInArrow(sets, "rep long, set array<bigint>")


def find_links(docs: DataFrame, classes: DataFrame, words: int, percent: int, n: int, miss: float, rounds: int = HEAD_ROUNDS) -> DataFrame:
    """Verified links (x, y) between class representatives, enough of them to join all that is similar."""
    t = percent / 100
    at, near_at = Bounds.of(t, n, BATCH, miss), Bounds.of(max(0.0, 2 * t - 1), n, BATCH, miss)
    similar, near_similar = F.expr(f"100 * shared >= {percent} * whole"), F.expr(f"100 * shared >= {2 * percent - 100} * whole")
    active = materialise(_several(classes.select(F.col("rep").alias("x"), F.explode("keys").alias("key")), None), "buckets")
    sets = full_sets(docs, active.select(F.col("x").alias("rep")).distinct(), classes, words)
    sets = materialise(sets.dropDuplicates(["rep"]), "sets")
    judged = []
    for nth in range(rounds):
        heads = active.groupBy("key").agg(F.min("x").alias("y"))
        met = active.join(heads, "key").filter("x != y")
        exact = materialise(_exact(_prune(met.select("x", "y").distinct(), classes, near_at, n), sets), f"judged-{nth}")
        judged.append(exact)
        left = met.join(exact.filter(similar).select("x", "y"), ["x", "y"], "left_anti").select("x", "key")
        active = materialise(_several(left, None), f"active-{nth}")
        if active.isEmpty():
            break
    judged_all = _union(judged).distinct()
    links = [judged_all.filter(similar).select("x", "y")]
    found = materialise(connected_components(links[0], "x", "y"), "found").withColumnRenamed("component", "c")
    payload = classes.select(F.col("rep").alias("id"), "sig", "n")

    def with_payload(df: DataFrame) -> DataFrame:
        return df.join(payload, "id").join(found, "id", "left").select("g", "id", "sig", "n", "d", F.coalesce("c", "id").alias("c"))

    if not active.isEmpty():
        rest = _several(active, found.withColumnRenamed("c", "component"))
        rest = with_payload(rest.select(F.col("key").alias("g"), F.col("x").alias("id"), F.lit(0.0).alias("d")))
        links.append(materialise(_compare_blocks(rest, rest, sets, at, n, percent, 1.0, True), "rest"))
        found = materialise(connected_components(_union(links), "x", "y"), "found").withColumnRenamed("component", "c")
    distance = (1 - F.col("shared") / F.col("whole")).alias("d")
    near = judged_all.filter(near_similar & ~similar).select(F.col("x").alias("id"), F.col("y").alias("g"), distance)
    near = near.join(found, "id", "left").join(found.toDF("g", "head"), "g", "left")
    near = materialise(near.filter(F.coalesce("c", "id") != F.coalesce("head", "g")).select("g", "id", "d"), "near")
    if not near.isEmpty():
        held = judged_all.filter(similar).select(F.col("y").alias("g"), F.col("x").alias("id"), distance)
        held = held.join(near.select("g").distinct(), "g", "left_semi")
        # Equal distances must not differ by a rounding error.
        links.append(materialise(_compare_blocks(with_payload(near), with_payload(held), sets, at, n, percent, 1 - t + 1e-9, False), "held"))
    return _union(links)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _grouped(docs: DataFrame, percent: int, words: int, bands: int, rows: int, miss: float) -> DataFrame:
    """One row per document: doc_id, h (of _hashed), n_shingles, component_id, and of its group's chosen row: like (it or an exact copy of it), kept (it)."""
    docs = docs.select("doc_id", "text")
    signed = materialise(signatures(docs, words, bands, rows).withColumn("row", F.monotonically_increasing_id()), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h", "row")).alias("least")
    classes = signed.filter("n > 0").groupBy("fp").agg(least, F.first("keys").alias("keys"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    # Numbers of classes in the order of their chosen rows: the smallest of a component is that of the component's.
    classes = classes.orderBy("least").select(F.monotonically_increasing_id().alias("rep"), "fp", "least.doc_id", "least.h", "least.row", "keys", "sig", "n")
    classes = materialise(classes, "classes")
    links = find_links(docs, classes, words, percent, bands * rows, miss)
    found = connected_components(links, "x", "y").withColumnRenamed("id", "rep")
    first = F.struct("doc_id", "h", "row").alias("first")
    found = found.join(classes.select(F.col("rep").alias("component"), first), "component").select("rep", F.col("first").alias("above"))
    owner = classes.select("fp", "rep", first).join(found, "rep", "left").select("fp", F.coalesce("above", "first").alias("first"))
    own = signed.filter("n > 0").select("doc_id", "h", "n", "row", "fp").join(owner, "fp")
    like = (F.col("h") == F.col("first.h")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    own = own.select("doc_id", "h", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), like.alias("like"), (F.col("row") == F.col("first.row")).alias("kept"))
    # Empty sets, which may be many, meet nobody.
    none = signed.filter("n = 0").select("doc_id", "h", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("like"), F.lit(True).alias("kept"))
    return own.unionByName(none)


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, bands: int = BANDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id of its group), kept (one row of each group). percent: the least similarity."""
    with scratch(docs.sparkSession) as keep:
        return keep(_grouped(docs, percent, words, bands, rows, miss).select("doc_id", "n_shingles", "component_id", "kept"), "groups")


def drop_near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """docs, all columns, with one document of each group: the one with the smallest doc_id, null last.

    Of exact copies of that one, the one with the smallest other columns stays; a document without words stays as it is.
    """
    row = F.struct(*columns_of(docs)).alias("row")
    rows = docs.select(row, F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("h"))
    with scratch(docs.sparkSession) as keep:
        found = keep(_grouped(docs, percent, words, BANDS, ROWS, MISS).filter("not kept").select(F.col("doc_id").alias("gone"), F.col("h").alias("g"), "like"), "duplicates")
    key = (F.col("h") == F.col("g")) & F.col("id").eqNullSafe(F.col("gone"))
    out = rows.join(found.filter("not like").select("gone", "g").distinct(), key, "left_anti")
    copied = found.filter("like").select("gone", "g").distinct()
    if copied.isEmpty():
        return out.select("row.*")
    by = F.struct(*(F.col("row")[f.name] for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())))
    once = out.join(copied, key, "left_semi").groupBy("h", "id").agg(F.min_by("row", by).alias("row"))
    return out.join(copied, key, "left_anti").select("row.*").unionByName(once.select("row.*"))


def op3_minhash_dedup(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op3_minhash_dedup": op3_minhash_dedup}

SQL = {
    "op3_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], chr(31)) AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.seen)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(seen) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""
}
