"""Indexes give the rows of the searches without them, from a part of the files."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silvan.operators import balls, intervals, search, sequences, trigrams


def files_of(df):
    return {f.split("/")[-2] for f in df.inputFiles()}


# ---- places ----


def test_numbers_across_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randrange(10**6), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long, nth_ int").repartition(5)
    got = sequences.numbered_across(df, ["k"], ["v", "nth_"]).collect()
    want, seen = {}, defaultdict(int)
    for k, v, n in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        seen[k] += 1
        want[n] = seen[k]
    assert {r["nth_"]: r["nth"] for r in got} == want and len(got) == 3000
    every = sequences.numbered_across(df, [], ["v", "nth_"]).orderBy("v", "nth_").collect()
    assert [r["nth"] for r in every] == list(range(1, 3001))
    assert sequences.numbered_across(df.limit(0), ["k"], ["v"]).count() == 0


def random_tree(rng, n):
    rows = [(k, None if k < 3 else rng.randrange(k), 0) for k in range(n)]
    return rows + [(1000, 5000, 0), (1001, 1000, 0), (2000, 2001, 0), (2001, 2000, 0)]  # a missing parent, and a cycle


def test_intervals_against_a_walk(spark, tmp_path):
    rows = random_tree(random.Random(3), 120)
    below = defaultdict(list)
    for k, up, _ in rows:
        below[up].append(k)
    order, leave = [], {}

    def walk(k):
        order.append(k)
        for c in sorted(below[k]):
            walk(c)
        leave[k] = len(order)

    for root in sorted(below[None]):
        walk(root)
    tree = spark.createDataFrame([(k, up, 0 if not below[k] else 1) for k, up, _ in rows], "unit_id long, parent_id long, height int")
    intervals.write(intervals.with_intervals(tree), str(tmp_path / "i"))
    table = intervals.read(spark, str(tmp_path / "i"))
    got = {r["unit_id"]: (r["enter"], r["leave"]) for r in table.collect()}
    assert got == {k: (n, leave[k]) for n, k in enumerate(order, 1)}
    up = {k: u for k, u, _ in rows}
    for node in (0, 7, 50, 119):
        chain, at = [], node
        while at is not None:
            chain.insert(0, at)
            at = up[at]
        assert [tuple(r) for r in intervals.ancestors(table, node).orderBy("place").select("unit_id", "place").collect()] == [(k, n) for n, k in enumerate(chain)]
        inside = order[order.index(node) : leave[node]]
        part = intervals.subtree(table, node)
        assert sorted(r["unit_id"] for r in part.collect()) == sorted(inside)
        assert [r["unit_id"] for r in intervals.leaves(table, node, 5, 1).collect()] == sorted(k for k in inside if not below[k])[1:6]
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "GreaterThanOrEqual(enter" in plan and "Exchange" not in plan
    for missing in (1000, 2000, 77_777):
        assert intervals.subtree(table, missing).count() == intervals.ancestors(table, missing).count() == 0


# ---- grams ----


@pytest.fixture(scope="module")
def units(spark, tmp_path_factory):
    rng = random.Random(5)
    words = ["licensed", "LICENCE", "x", "café", "CAFÉ au", "100%", "a_b_c", "lice", "sed", "ab", "wör\nlds", "𝒳𝒴𝒵 math", ""]
    rows = [(k, k % 3, k % 2, k % 4, rng.choice([None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))]), rng.choice([None, "Label 17", "lab"]), f"/p/{k}") for k in range(150)]
    df = spark.createDataFrame(rows, "unit_id long, corpus_id long, height int, depth int, text string, label string, path string")
    corpora = spark.createDataFrame([(0, "Licensing"), (1, "b"), (2, None)], "corpus_id long, name string")
    path = str(tmp_path_factory.mktemp("grams") / "i")
    trigrams.write_index(df, path, ("text", "label", "path"))
    return df, corpora, path


@pytest.mark.parametrize("query", ["licen_ed", "LICENSED", "lice%sed", "café", "100%", "a_b_c", "ab", "", "%", "_", "l_b%1", "label 17", "𝒳𝒴𝒵", "r\nl", "nothing at all", "licensing", "\\%", "/p/1", "sed sed"])
def test_keyword_search_through_the_index(units, query):
    df, corpora, path = units
    rows = lambda page: [tuple(r) for r in page.select("unit_id", "corpus", "score").collect()]
    for page in ({"limit": 200}, {"corpus_ids": [0, 1], "height": (0, 0), "limit": 7, "offset": 3}):
        assert rows(trigrams.keyword(df, corpora, path, query, **page)) == rows(search.keyword(df, corpora, query, **page))
    plain = [r["unit_id"] for r in search.autocomplete(df, query, 1).collect()]
    assert [r["unit_id"] for r in trigrams.autocomplete(df, path, query, 1).collect()] == plain


def test_only_the_querys_postings_are_read(spark, units):
    _, _, path = units
    assert trigrams.candidates(spark, path, "ab") is None and trigrams.candidates(spark, path, "a\\bcd") is None
    plan = trigrams.candidates(spark, path, "licensed")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(gram" in plan and len(trigrams.query_grams("licensed")) == 6
    got = {r["gram"] for r in spark.createDataFrame([("aBcdé𝒳x",), ("ab",), (None,)], "t string").select(F.explode(trigrams.grams(F.col("t"))).alias("gram")).collect()}
    assert got == {"abc", "bcd", "cdé", "dé𝒳", "é𝒳x"}


def test_lists_of_ids_against_the_grams_of_each_text(spark, tmp_path, monkeypatch):
    """Few rows for many ids; the ids of each gram as they are, whether a stretch is one, many or has too many characters."""
    rng = random.Random(9)
    letters = ["a", "b", " ", "é", "€", "𝒳", "\n", "\0"]
    wide = lambda: "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(60))
    rows = [(k, rng.choice([None, "", "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))), "the same line"]), wide() if k % 9 == 0 else "ab") for k in range(3000)]
    want = {(t[i : i + 3], k) for k, *both in rows for t in both if t for i in range(len(t) - 2)}
    trigrams.write_index(spark.createDataFrame(rows, "unit_id long, text string, label string").coalesce(3), str(tmp_path / "i"), ("text", "label"))
    lists = spark.read.parquet(str(tmp_path / "i" / "postings")).select("gram", "n", "ids").collect()
    got = [(r["gram"], i) for r in lists for i in r["ids"]]
    assert len(got) == len(set(got)) and set(got) == want and all(r["n"] == len(r["ids"]) for r in lists)
    common = [r["n"] for r in lists if r["gram"] == "ame"]
    assert sum(common) > 500 and len(common) <= 3
    assert {r["gram"]: r["n"] for r in spark.read.parquet(str(tmp_path / "i" / "counts")).collect()}["ame"] == sum(common)
    # Here, not in a task: short stretches, and one whose 180,000 characters leave no bits for its rows.
    lines = ["".join(map(chr, range(at, at + 20))) for at in range(0x10000, 0x10000 + 180_000, 20)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] or "" for r in rows]), pa.array([r[2] for r in rows])], ["id", "a", "b"])
    many = pa.RecordBatch.from_arrays([pa.array(range(9_000)), pa.array(lines)], ["id", "a"])
    monkeypatch.setattr(trigrams, "STRETCH", 500)
    cuts = list(trigrams._stretches(iter([batch])))
    assert len(cuts) > 50 and sum(c.num_rows for c in cuts) == 3000
    for parts, found in ((cuts, want), ([many, many.slice(10, 1), many.slice(0, 0)], {(t[i : i + 3], k) for k, t in enumerate(lines) for i in range(18)})):
        assert {(g, i) for c in parts for x in trigrams._lists(c) for g, ids in zip(x.column("gram").to_pylist(), x.column("ids").to_pylist(), strict=True) for i in ids} == found


# ---- balls ----


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    x = np.vstack([c + 0.05 * rng.normal(size=(40, 8)) for c in rng.normal(size=(12, 8))])
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 8, 1), (902, [1.0, 2.0], 1), (903, [float("nan")] * 8, 1), (904, x[5].tolist(), 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    path = str(tmp_path_factory.mktemp("balls") / "i")
    balls.write_index(df, path, n_balls=12, files=2)
    return df, x, balls.Balls(spark, path)


@pytest.mark.parametrize("k, offset", [(1, 0), (10, 0), (10, 35), (60, 0), (500, 0), (5, 478), (0, 0)])
def test_pages_through_the_balls(vectors, k, offset):
    df, x, index = vectors
    for q in (x[0], x[100] * 3, -x[3], np.ones(8), np.zeros(8), np.ones(3)):
        got, want = ([tuple(r) for r in page.collect()] for page in (index.top_k(q, k, offset), search.top_k(df, q, k, offset)))
        assert [(r[0], r[2:]) for r in got] == [(r[0], r[2:]) for r in want]


def test_few_balls_are_read(vectors):
    _, x, index = vectors
    index.top_k(x[200], 10).collect()
    assert index.last.balls <= 3 and index.last.rows < index.last.all_rows / 3 and index.last.all_balls == 13 and index.last.all_rows == 485


def test_balls_of_no_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<double>")
    balls.write_index(df, str(tmp_path / "b"))
    assert [r["vec_id"] for r in balls.Balls(spark, str(tmp_path / "b")).top_k([1.0], 5).collect()] == [1, 2]
