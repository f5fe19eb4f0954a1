import heapq
import itertools
import random
import re
import sys
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import EDGES

from silvan.llm import components, embed_dedup, minhash, mixing, sharding


def groups_of(ids, pairs):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_components(spark, kind):
    rng = random.Random(1)
    pairs = {"chain": [(i, i + 1) for i in range(40)], "star": [(99, i) for i in range(30)], "random": [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)]}[kind]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = groups_of({i for p in pairs for i in p}, pairs)
    assert got == {i: c for i, c in want.items() if i != c}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def sets_of(rows):
    return {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows if (w := (t or "").lower().split())}


def brute(rows, percent):
    s = sets_of(rows)
    pairs = [(a, b) for a, b in itertools.combinations(s, 2) if 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    return groups_of({i for i, _ in rows}, pairs)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates_against_brute_force(docs):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(5000)}" for _ in range(120)] for _ in range(4)]
    # Copies around a base that are close to it but not to each other, so the group hangs on one member and on chains.
    rows = [(100 + k, edited(rng, base[0], rng.randint(0, 3))) for k in range(60)] + [(50, " ".join(base[0]))]
    rows += [(200 + k, edited(rng, base[1], k % 6)) for k in range(30)]
    chain = list(base[2])
    for k in range(12):
        chain = edited(rng, chain, 1).split()
        rows.append((300 + k, " ".join(chain)))
    rows += [(400 + k, " ".join(base[3][:40] + [f"u{k}_{j}" for j in range(80)])) for k in range(20)]
    rows += [(1, None), (2, ""), (3, " "), (4, "a b"), (5, "A b"), (6, "b a"), (7, "word " * 20_000)]
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in minhash.near_duplicates(docs(rows), percent=85).collect()}
    want, s = brute(rows, 85), sets_of(rows)
    assert got == {i: (want[i], len(s.get(i, ()))) for i, _ in rows}


def test_near_duplicates_edges(docs):
    got = minhash.near_duplicates(docs(EDGES)).collect()
    assert len(got) == len(EDGES) and all(r["component_id"] == r["doc_id"] for r in got)
    assert minhash.near_duplicates(docs([])).count() == 0
    assert sorted((r["doc_id"] or 0) for r in minhash.drop_near_duplicates(docs([*EDGES, (9, "A  b c")])).collect()) == [0, 1, 2, 3, 4, 5, 6]


def test_rows_that_share_a_doc_id_or_have_none(docs):
    rng = random.Random(12)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(100))
    a, b, c, d, e, f = (text() for _ in range(6))
    near = edited(rng, f.split(), 1)
    # 7: a copy of 3 beside a text of its own; 8: two texts, of which one has a near copy; exact copies with and without ids.
    rows = [(3, a), (7, a), (7, b), (8, c), (8, f), (9, near), (10, d), (10, d), (None, e), (None, e), (None, e), (None, a), (None, f"{e} more words at the end of it"), (None, None), (None, None)]
    got = Counter((r["doc_id"], r["text"]) for r in minhash.drop_near_duplicates(docs(rows)).collect())
    nameless = [k for k in got if k[0] is None and k[1]]
    assert len(nameless) == 1 and nameless[0][1].startswith(e) and got.pop(nameless[0]) == 1
    assert got == Counter([(3, a), (7, b), (8, c), (8, f), (10, d), (None, None), (None, None)])
    found = [(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(rows)).collect()]
    want = [(3, 3, True), (7, 3, False), (7, 7, True), (8, 8, True), (8, 8, True), (9, 8, False), (10, 10, True), (10, 10, False), (None, 3, False)]
    assert Counter(found) == Counter(want + [(None, None, True)] * 3 + [(None, None, False)] * 3)


def test_sets_do_not_depend_on_the_words_held(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(60)) for _ in range(20)]
    want = [minhash.shingle_set(t) for t in texts]
    monkeypatch.setattr(minhash, "WORDS_HELD", 3)
    minhash._hashes.clear()
    assert all(np.array_equal(minhash.shingle_set(t), s) for t, s in zip(texts, want, strict=True))
    assert len(minhash._hashes) <= 3


def test_bounds_keep_what_is_similar():
    b, rng = minhash.Bounds.of(0.85, 160), np.random.default_rng(1)
    x = rng.integers(0, 256, (4000, 160)).astype(np.uint8)
    same = rng.random((4000, 160)) < 0.85
    y = np.where(same, x, rng.integers(0, 256, (4000, 160))).astype(np.uint8)
    assert len(b.survives(x, y)[0]) >= 3999
    assert len(b.survives(x, rng.integers(0, 256, (4000, 160)).astype(np.uint8))[0]) == 0


def test_block_comparison_finds_links_between_components(spark, monkeypatch):
    rng = np.random.default_rng(2)
    m, n, rows = minhash.Minima(160), 160, []
    base = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = {}
    for i in range(40):
        s = np.unique(np.concatenate((base[i % 3 :: 1][:190], rng.integers(0, 1 << 62, i % 25).astype(np.uint64))))
        rows.append((0, i, (m(s) & np.uint32(255)).astype(np.uint8).tobytes(), len(s), 0.0, i))
        sets[i] = s.view(np.int64).tolist()
    df = spark.createDataFrame(rows, "g int, id long, sig binary, n long, d double, c long")
    full = spark.createDataFrame(list(sets.items()), "rep long, set array<bigint>")
    for size in (16, 256):  # several blocks, and one
        monkeypatch.setattr(minhash, "LEFT_ROWS", size)
        monkeypatch.setattr(minhash, "RIGHT_ROWS", size)
        got = [tuple(r) for r in minhash._compare_blocks(df, df, full, minhash.Bounds.of(0.85, n), n, 85, 1.0, True).collect()]
        exact = {i: set(s) for i, s in sets.items()}
        pairs = [(a, b) for a, b in itertools.combinations(exact, 2) if 100 * len(exact[a] & exact[b]) >= 85 * len(exact[a] | exact[b])]
        assert groups_of(exact, got) == groups_of(exact, pairs) and set(got) <= {(b, a) for a, b in pairs}


def test_left_over_members_are_compared_on_full_sets(docs, monkeypatch):
    """Without rounds every bucket's members go through the blocks: the same links."""
    rng = random.Random(21)
    base = [[f"w{rng.randrange(5000)}" for _ in range(100)] for _ in range(3)]
    rows = [(k, edited(rng, base[k % 3], rng.randint(0, 4))) for k in range(90)]
    want, _ = brute(rows, 85), monkeypatch.setattr(minhash, "LEFT_ROWS", 8)
    monkeypatch.setattr(minhash, "RIGHT_ROWS", 16)
    monkeypatch.setattr(minhash.find_links, "__defaults__", (1,))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(rows), percent=85).collect()}
    assert got == want


def test_apportionment():
    rng = random.Random(3)
    for _ in range(60):
        votes = [rng.choice([0, rng.randint(1, 500)]) for _ in range(rng.randint(1, 7))]
        caps = [rng.randint(0, 40) for _ in votes]
        seats = rng.randint(0, 90)
        plain, left = [0] * len(votes), seats
        heap = [(-Fraction(v), i) for i, v in enumerate(votes) if v and caps[i]]
        heapq.heapify(heap)
        while left and heap:
            _, i = heapq.heappop(heap)
            plain[i] += 1
            left -= 1
            if plain[i] < caps[i]:
                heapq.heappush(heap, (-Fraction(votes[i], 2 * plain[i] + 1), i))
        assert mixing.sainte_lague(seats, votes, caps) == plain
    assert mixing.sainte_lague(10, [53, 24, 23]) == [6, 2, 2]


def test_targets():
    assert mixing.targets([100, 100], [1, 1]) == [150, 150]
    assert mixing.targets([10, 100], [5, 1]) == [20, pytest.approx(145)]
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0, 0]


def test_mix(docs):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(rng.randint(0, 60))), rng.choice(["a", "b", "b", "b", "ç", None])) for i in range(400)] + EDGES
    df = docs(rows)
    got = mixing.mix_sources(df).collect()
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        x = by[r["source"]]
        x[0], x[1], x[2] = x[0] + r["size"], x[1] + r["taken"], r["target"]
        assert r["source_size"] == sum(len((t[1] or "").split()) for t in rows if (t[2] if len(t) > 2 else "s") == r["source"])
    names = sorted((k for k in by if k is not None), key=lambda k: k.encode()) + [None] * (None in by)
    aims = mixing.targets([by[k][0] for k in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    assert all(by[k][2] == pytest.approx(a) and abs(by[k][1] - a) <= 3 for k, a in zip(names, aims, strict=True))
    again = sorted(map(tuple, mixing.mix_sources(df.repartition(7)).drop("check").collect()), key=repr)
    assert again == sorted(map(tuple, mixing.mix_sources(df).drop("check").collect()), key=repr)
    mixed = Counter()
    for r in mixing.mixed_documents(df).collect():
        mixed[r["doc_id"]] += len((r["text"] or "").split())
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in mixed.items() if v} == {k: v for k, v in want.items() if v}
    assert mixing.mix_sources(docs([])).count() == 0


def test_mix_of_short_sources_beside_millions_of_words(docs):
    rows = [(i, "w " * 300_000, "z") for i in range(10)] + [(10, "one", "a"), (11, "one two three", "b"), (12, None, "c")]
    rows += [(100 + i, "word" if i % 2 else "a b c", "m") for i in range(1200)]
    taken, target = Counter(), {}
    for r in mixing.mix_sources(docs(rows)).collect():
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert (target["a"], target["b"], target["c"], target["m"]) == (2, 6, 0, 4800)
    assert all(abs(taken[k] - v) <= 1 for k, v in target.items()) and taken["a"] == 2


def test_mixed_texts_keep_their_white_space(docs):
    rng = random.Random(13)
    gap = lambda: rng.choice([" ", "\n", "\n\n\t", "  ", "\r\n", "\x0b"])
    rows = [(i, gap() + "".join(f"w{i}_{k}é{gap()}" for k in range(rng.randint(1, 40))), rng.choice("aaaaabcccc")) for i in range(100, 400)] + EDGES[:3]
    texts, takes, got = {r[0]: r[1] for r in rows}, {}, defaultdict(list)
    for r in mixing.mix_sources(docs(rows)).collect():
        takes[r["doc_id"]] = r
    for r in mixing.mixed_documents(docs(rows)).collect():
        got[r["doc_id"]].append(r["text"])
    cut = 0
    for i, r in takes.items():
        ends = [m.span() for m in re.finditer(r"[^ \t-\r]+", texts[i] or "")]
        want = [texts[i]] * r["turns"] if r["size"] else [x for x in got[i] if not (x or "").strip()]
        for first, n in ((r["first"], r["run"]), (0, r["again"])):
            if n:
                want.append(texts[i] if n == r["size"] else texts[i][ends[first][0] : ends[first + n - 1][1]])
                cut += n < r["size"]
        assert sorted(got[i], key=repr) == sorted(want, key=repr)
    assert cut and any(not r["turns"] and r["run"] == r["size"] > 1 for r in takes.values())


def test_sharding(docs):
    assert sharding.lpt([(7, "a"), (6, "b"), (5, "c"), (4, "d"), (3, "e")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 0}
    rng = random.Random(5)
    rows = [(i, rng.choice(["same text", "x" * rng.randint(0, 400)])) for i in range(600)] + EDGES[:7]
    got = sharding.shard_documents(docs(rows), 8).collect()
    whole = sharding.shard_documents(docs(EDGES), 2).collect()
    assert Counter((r["doc_id"], r["size"]) for r in whole) == Counter((r[0], len((r[1] or "").encode()) + 1) for r in EDGES)
    assert {r["shard"] for r in whole if r["size"] > 1000} != {r["shard"] for r in whole if r["size"] <= 1000}
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    text = dict(rows[:600])
    home = defaultdict(set)
    for r in got:
        if r["doc_id"] in text and r["doc_id"] > 6:
            home[text[r["doc_id"]]].add(r["shard"])
    assert all(len(v) == 1 for v in home.values())
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert max(load.values()) < 1.1 * min(load.values())
    assert sharding.shard_documents(docs([])).count() == 0


def test_written_shards_hold_whole_groups(spark, docs, tmp_path):
    rng = random.Random(20)
    rows = [(i, rng.choice(["same text", "x" * rng.randint(0, 400), None])) for i in range(300)]
    df = docs(rows).withColumn("a.b", F.lit(1))
    sharding.write_shards(df, str(tmp_path / "s"), 4, 2)
    plan = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df, 4).collect()}
    back = spark.read.parquet(*(str(tmp_path / "s" / f"shard={k}") for k in range(4)))
    assert back.columns == [c for c in df.columns if c != "shard"] and sorted(tuple(r) for r in back.select("doc_id", F.coalesce("text", F.lit("-"))).collect()) == sorted((i, "-" if t is None else t) for i, t in rows)
    for k in range(4):
        assert {plan[r["doc_id"]] for r in spark.read.parquet(str(tmp_path / "s" / f"shard={k}")).select("doc_id").collect()} <= {k}


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(8, 12))
    x = (centre[rng.integers(0, 8, 300)] + rng.normal(size=(300, 12)) * 0.45).astype(np.float32)
    x[100:140] = x[0]
    rows = [(i, r.tolist(), 0, 0) for i, r in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 12, [nan] * 12, [inf] + [1.0] * 11, [None] + [1.0] * 11, [1.0, 2.0], [2.0, 4.0], [1e-38] * 12]
    rows += [(1000 + k, v, 0, 0) for k, v in enumerate(odd)] + [(None, x[0].tolist(), 0, 0), (5, x[5].tolist(), 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, links int")
    got = embed_dedup.near_vectors(df).collect()
    y = x.astype(np.float64)
    c = (y @ y.T) / np.outer(np.linalg.norm(y, axis=1), np.linalg.norm(y, axis=1)) >= 0.9
    np.fill_diagonal(c, False)
    want = groups_of(range(300), [(a, b) for a, b in zip(*np.nonzero(c), strict=True) if a < b])
    near_ones = {i for i in range(300) if y[i] @ np.ones(12) / (np.linalg.norm(y[i]) * 12**0.5) >= 0.9}
    assert not near_ones and len(got) == len(rows)
    links = {r["vec_id"]: r["n_links"] for r in got if r["vec_id"] is not None}
    repeated = {i for i in range(300) if c[5, i]} | {5}
    assert all(links[i] == c[i].sum() + (i in repeated) for i in range(300))
    assert all(r["component_id"] == want[r["vec_id"]] for r in got if r["vec_id"] is not None and r["vec_id"] < 300)
    assert [links[1000 + k] for k in range(9)] == [0, 0, 0, 0, 0, 0, 1, 1, 0]
    # Rows of one id are vectors of their own: (1, x) has one neighbour, and so has (1, y).
    x, y = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1]
    same = spark.createDataFrame([(1, x), (1, y), (2, [1.0, 0.0, 0.12]), (3, [0.0, 1.0, 0.12]), (1, x), (9, [0.0, 0.0, -1.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in embed_dedup.near_vectors(same).collect()) == [(1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (9, 0, 9)]
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_cosines_at_the_threshold_and_full_blocks(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "block_rows", lambda dim: 16)
    monkeypatch.setattr(embed_dedup, "LEAST_TILES", 2)
    monkeypatch.setattr(embed_dedup, "MAX_TILES", 4)
    rng = np.random.default_rng(19)
    # (3, 4) and (4, 3) have a cosine of 24/25; a hundredth less or more on the threshold decides.
    rows = [(1, [3.0, 4.0]), (2, [4.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = float(embed_dedup._cosine(np.array([[3.0, 4.0]]), np.array([[4.0, 3.0]]))[0])
    links = lambda t: [r["n_links"] for r in embed_dedup.near_vectors(df, t).orderBy("vec_id").collect()]
    assert links(exact) == [1, 1] and links(np.nextafter(exact, 1)) == [0, 0] and links(exact - 0.01) == [1, 1]
    # Tiles larger than a block: every pair of blocks is met once.
    x = rng.normal(size=(6, 5))[rng.integers(0, 6, 150)] + rng.normal(size=(150, 5)) * 0.2
    df = spark.createDataFrame([(i, r.tolist(), "x") for i, r in enumerate(x)], "vec_id long, embedding array<double>, `a.b` string")
    c = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.9
    np.fill_diagonal(c, False)
    want = groups_of(range(150), [(a, b) for a, b in zip(*np.nonzero(c), strict=True) if a < b])
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_vectors(df).collect()} == {i: (int(c[i].sum()), want[i]) for i in range(150)}
    many = spark.createDataFrame([(k, [1.0] * (k + 1)) for k in range(70)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="lengths"):
        embed_dedup.near_vectors(many)


def test_tiles_leave_no_pair_out():
    rng = np.random.default_rng(8)
    x = embed_dedup.unit(rng.normal(size=(2000, 4)))
    tiles = embed_dedup.Tiles(x, 100)
    met, at = set(tiles.pairs(0.9)), tiles.of(x)
    a, b = np.nonzero(x @ x.T >= 0.9)
    assert all((min(p, q), max(p, q)) in met for p, q in zip(at[a], at[b], strict=True)) and len(met) < 100 * 101 / 2


def test_unite_and_linked_dense():
    rng = np.random.default_rng(9)
    x = np.ones((700, 6)) + rng.normal(size=(700, 6)) * 0.01
    label = np.arange(700)
    n = 0
    for i, j in embed_dedup.linked(x, x, embed_dedup.principal_axes(embed_dedup.unit(x)), 0.9, True, (2, 4)):
        n += len(i)
        embed_dedup.unite(label, i, j)
    assert n == 700 * 699 // 2 and not label.any()


def test_pipeline_against_plain_python(spark, docs, tmp_path):
    import corpus_pipeline

    rng = random.Random(10)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    first = prose(90)
    rows = [(1, first, "a"), (2, first, "b"), (3, first.replace(" ", "  "), "b"), (4, prose(70) + " mail joe@x.org now", "a"), (5, "short", "a"), (6, None, "a"), (7, prose(60), "c"), (8, prose(55).upper(), "c")]
    df, names = docs(rows), []
    columns = df.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        names.append(name)
        out = stage(spark, df, str(tmp_path))
        assert k == 4 or out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        df = spark.read.parquet(str(tmp_path / str(k)))
        ids = {r["doc_id"] for r in df.collect()}
        if k == 0:
            assert ids == {1, 2, 3, 4, 7}
        if k == 1:
            assert ids == {1, 4, 7}
        if k == 2:
            assert "[EMAIL]" in df.filter("doc_id = 4").first()["text"]
    assert names == ["quality rules", "MinHash near-dedup", "PII", "mixing", "packing"] and df.agg(F.sum("length")).first()[0] > 0
    assert "corpus_pipeline" in sys.modules


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(18)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    odd = ["__text", "__email", "__b_ip", "__key", "__nth", "__texts", "__take", "__rejected_by", "pii", "rejected_by", "row", "key", "take", "takes", "h", "g", "like", "gone", "a.b", "c`d", "text.x", "id", "size", "m"]
    twice = prose(80)
    rows = [(1, twice, "en", "a", 1), (2, twice, "en", "b", 2), (2, twice, "en", "b", 2), (3, prose(90) + " x@y.org", None, None, None), (None, prose(70), "en", "a", 3), (4, None, "en", "a", 0), (5, " ", "en", "a", 1), (6, prose(9000), "en", "b", 9)]
    full = [(*r, *(f"{c}{r[0]}" for c in odd)) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in odd)
    df = spark.createDataFrame(full, schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns
        out.write.parquet(str(tmp_path / f"odd{k}"))
        df = spark.read.parquet(str(tmp_path / f"odd{k}"))
        assert all(r[c] == f"{c}{r['doc_id']}" for r in df.collect() for c in odd)
        if k == 1:
            assert sorted((r["doc_id"] or 0) for r in df.collect()) == [0, 1, 3, 6]
    assert corpus_pipeline.STAGES[4][1](spark, df, str(tmp_path)).count() > 0


def test_pipeline_of_an_empty_table(spark, docs, tmp_path):
    import corpus_pipeline

    docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns
