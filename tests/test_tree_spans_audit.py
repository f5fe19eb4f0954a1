import numpy as np
import pytest
from pyspark.sql import functions as F

from silvan.operators import audit, projection, search, spans, tree
from silvan.plans import catalog

FOREST = [(1, None), (2, 1), (3, 1), (4, 3)]


def test_height_is_the_shortest_way_to_a_leaf(spark):
    t = spark.createDataFrame(FOREST, "id long, parent_id long")
    assert dict(tree.heights(t).collect()) == {1: 1, 2: 0, 3: 1, 4: 0}


def test_parent_takes_children_of_earlier_waves(spark):
    t = spark.createDataFrame(FOREST, "id long, parent_id long")
    placed = spark.createDataFrame([(2, [0.0, 0.0]), (4, [2.0, 2.0])], "id long, coords array<double>")
    assert {r["id"]: r["coords"] for r in projection.parent_means(t, placed, 2).collect()}[1] == [0.0, 0.0]


def test_parents_brought_along_give_the_same_means(spark):
    t = spark.createDataFrame([*FOREST, (5, 3), (6, None), (7, 4)], "id long, parent_id long")
    placed = spark.createDataFrame([(2, 1, [0.0]), (5, 3, [3.0]), (7, 4, [1.0]), (3, 1, [9.0]), (6, None, [5.0])], "id long, parent_id long, coords array<double>")
    with_parents, without = ({r["id"]: r["coords"] for r in projection.parent_means(t, p, 1).collect()} for p in (placed, placed.drop("parent_id")))
    assert with_parents == without == {2: [0.0], 5: [3.0], 7: [1.0], 3: [9.0], 6: [5.0], 4: [1.0], 1: [4.5]}


def test_a_task_holds_one_join_not_one_for_each_table(spark):
    """The leaves are found in the tree, not in each of the five tables that it is made of."""
    plan = catalog.parent_mean(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[-1]
    assert sum(initial.count(f"{kind}Join") for kind in ("SortMerge", "ShuffledHash", "BroadcastHash")) == 1


def test_cycle_is_an_error(spark):
    with pytest.raises(ValueError):
        tree.closure(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent_id long"))


def test_golden_segmentation(spark):
    long = " ".join(f"w{i}" + ("." if i in (7, 14, 16) else "") for i in range(1, 21))
    rows = [(1, None, i + 1, t) for i, t in enumerate(["a b c", "d e f g", "h i j", "k l m n o p q r s t u v", long, "z", " ", None])]
    got = spans.build(spark.createDataFrame(rows, "version_id long, parent_id long, unit_id long, text string"), 10, 2, 16).orderBy("span_no", "unit_order").collect()
    assert [(r["span_no"], r["unit_id"], r["n_words"], r["lo"], r["hi"]) for r in got] == [
        (0, 1, 10, None, None), (0, 2, 10, None, None), (0, 3, 10, None, None), (1, 4, 12, None, None), (2, 5, 7, 0, 7), (3, 5, 9, 5, 14), (4, 5, 8, 12, 20), (5, 6, 1, None, None),
    ]
    assert [round(r["weight"], 6) for r in got[:3]] == [0.263158, 0.368421, 0.263158]


def test_windows_cover_all_words(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join("w" + ("." if x else "") for x in rng.random(n) < 0.1) for n in (1, 17, 60, 333)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.split("t", " ").alias("w"))
    for r in df.select("w", spans.windows(F.col("w"), 12, 3).alias("s")).collect():
        assert {i for s in r["s"] for i in range(s["lo"], s["hi"])} == set(range(len(r["w"])))
        assert all(s["hi"] - s["lo"] <= 12 for s in r["s"]) and all(a["lo"] < b["lo"] for a, b in zip(r["s"], r["s"][1:], strict=False))


def test_percentile_rule(spark):
    for n, value in ((20, 20), (19, 19), (100, 96)):
        df = spark.range(1, n + 1).withColumn("k", F.lit(1))
        assert audit.picked(df, ["k"], "id", p95=0.95).first()["p95"] == value


def test_coverage_adds_up(spark):
    rows = [(1, 1, 0, 2, "ab c"), (1, 1, 0, 2, " "), (1, 1, None, 0, None)]
    got = audit.coverage_by_level(spark.createDataFrame(rows, "corpus_id int, version_id int, height int, depth int, text string")).collect()
    assert len(got) == 2 and all(r["total"] == r["nonempty"] + r["empty"] for r in got)


def test_id_filter_has_three_states(spark):
    df = spark.range(3)
    assert [search.keep_ids(df, "id", x).count() for x in (None, [], [1])] == [3, 0, 1]


def test_comparison_keeps_order_and_repeats(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "unit_id long, vector array<double>")
    assert [tuple(r) for r in search.compare(1, [2, 1, 2, 9], v).collect()] == [(0, 2, 0.0), (1, 1, 1.0), (2, 2, 0.0)]
    with pytest.raises(LookupError):
        search.compare(9, [1], v)


def test_pca_matches_numpy(spark):
    x = np.random.default_rng(1).normal(size=(200, 6)) * [5, 3, 1, 1, 0.5, 0.1]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    _, _, shares = projection.explained_variance(df, "v", 0.9)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(shares, (values / values.sum())[: len(shares)]) and shares.sum() >= 0.9 > shares[:-1].sum()
    assert len(projection.pca(df, "v", 0.9).first()["coords"]) == len(shares)


def test_empty_bounds(spark):
    none = spark.createDataFrame([], "x double, y double")
    assert tuple(projection.bounds(none).first()) == (-1, 1, -1, 1)


def test_units_of_documents_without_lang_or_source(spark, tmp_path):
    from silvan.plans import catalog
    from silvan.plans import domain as D

    rows = [(1, "a\nb", "en", "s"), (2, "c", None, "s"), (3, "d\ne", "en", None), (4, "f", None, None), (5, "g", None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    units = D.units(spark, str(tmp_path)).collect()
    assert len(units) == len({u["unit_id"] for u in units}) == 4 + 5 + 7
    assert sorted(u["text"] for u in units if u["text"]) == list("abcdefg")
    assert all(u["path"] and u["label"] for u in units)
    roots = {u["unit_id"]: (u["corpus_id"], u["label"]) for u in units if u["depth"] == 0}
    assert roots == {1: (1, "s"), 2: (1, D.NAMELESS), 3: (2, "s"), 4: (2, D.NAMELESS)}
    assert {u["unit_id"] - D.DOC: u["version_id"] for u in units if u["depth"] == 1} == {1: 1, 2: 3, 3: 2, 4: 4, 5: 3}
    assert catalog.QUERIES["coverage_by_version"](spark, str(tmp_path)).count() == 4


def test_trees_without_levels_and_with_cycles(spark):
    t = spark.createDataFrame([(1, None, 0, 0), (2, 1, 1, 0)], "unit_id long, parent_id long, height int, depth int")
    assert tree.first_level_below(t.limit(0)).count() == tree.first_level_below(t).count() == 0
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(100)], "unit_id long, parent_id long")
    assert [r["id"] for r in tree.ancestors(chain, 99).orderBy("place").collect()] == list(range(100))
    assert tree.ancestors(chain, 500).count() == 0
    ring = spark.createDataFrame([(1, 2), (2, 1), (3, None), (4, 3)], "id long, parent_id long")
    assert [r["id"] for r in tree.ancestors(ring, 1, "id").orderBy("place").collect()] == [2, 1]
    found = tree.heights(ring)
    assert dict(found.collect()) == {3: 1, 4: 0} and sorted(r["id"] for r in tree.without_height(ring, found).collect()) == [1, 2]
    assert {r["id"]: r["path"] for r in tree.paths(ring.withColumn("label", F.lit(None).cast("string")), "label", "id").collect()} == {3: "/3", 4: "/3/4"}
    with pytest.raises(ValueError):
        tree.descendants(ring, 1, "id")


def test_packing_and_windows_of_many(spark):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 30, 1000).tolist()
    got = spark.createDataFrame([(sizes,)], "s array<int>").select(spans.pack(F.col("s"), 40, 25)).first()[0]
    want, group, total, closed = [], -1, 0, False
    for n in sizes:
        if group < 0 or n > 25 or closed or total + n > 40:
            group, total = group + 1, 0
        total, closed = total + n, n > 25
        want.append(group)
    assert got == want
    words = ["w" + ("." if x else "") for x in rng.random(5000) < 0.05]
    got = spark.createDataFrame([(words,)], "w array<string>").select(spans.windows(F.col("w"), 50, 10)).first()[0]
    lo, want = 0, []
    while lo < len(words):
        raw = min(lo + 50, len(words))
        ends = [e for e in range(lo + 25, raw + 1) if words[e - 1].endswith(".")]
        hi = raw if raw == len(words) or not ends else ends[-1]
        want.append((lo, hi))
        if hi >= len(words):
            break
        lo = max(lo + 1, hi - 10)
    assert [(w["lo"], w["hi"]) for w in got] == want


def test_nearest_vectors_with_ties_and_zeros(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100, [0.0, 0.0]), (101, None), (102, [0.0, 1.0]), (103, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = search.top_k(df, [2.0, 0.0], 50).collect()
    assert [r["vec_id"] for r in got] == [*range(40), 102, 100, 101, 103] and [r["score"] for r in got[39:]] == [1.0, 0.0, None, None, None]
    assert [r["vec_id"] for r in search.top_k(df, [2.0, 0.0], 3, 2).collect()] == [2, 3, 4]


def test_moments_over_many_partitions(spark):
    x = np.random.default_rng(4).normal(size=(300, 5))
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "v array<double>").repartition(130)
    n, mean, cov = projection.moments(df, "v")
    assert n == 300 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))


def test_contours_close(spark):
    xy = np.random.default_rng(6).normal(size=(300, 2))
    points = spark.createDataFrame([(1, float(a), float(b)) for a, b in xy], "g int, x double, y double")
    segments = projection.contour_segments(projection.density(points, "g"), "g").filter("level = 0.48").collect()
    ends = [(round(r[f"x{k}"], 6), round(r[f"y{k}"], 6)) for r in segments for k in (0, 1)]
    # The padded box is not reached at this level, so every end is met by another one.
    assert segments and all(ends.count(e) == 2 for e in ends)
