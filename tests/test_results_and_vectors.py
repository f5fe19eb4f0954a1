import itertools
import json

import pytest
from pyspark.sql import functions as F

from silvan.operators import embedding, mapview, results, sequences, span_store, spans
from silvan.functions import text as T


@pytest.mark.parametrize("most, budget", [(1, 3), (2, 5), (3, 8), (9, 4)])
def test_batches_against_all_cuts(most, budget):
    for costs in itertools.product((0, 1, 4, 6), repeat=4):
        got = list(embedding.batches(costs, most, budget))
        assert [a for a, _ in got] + [4] == [0] + [b for _, b in got]
        for a, b in got:
            # No longer one would do, and it is one item or paid for.
            fits = [e for e in range(a + 1, 5) if e - a <= most and (e == a + 1 or sum(costs[a:e]) <= budget)]
            assert b == max(fits)
    assert list(embedding.batches([], 3, 8)) == []


def test_encoding_in_halves():
    sizes, lost, limiter = [], [], embedding.Limiter(patience=2)

    def encode(texts):
        sizes.append(len(texts))
        if len(texts) > 2 or "bad" in texts:
            raise embedding.TooMuch
        return [[float(len(t))] for t in texts]

    items = [(i, "x" * (20 - i), 20 - i) for i in range(12)] + [(99, "bad", 100)]
    got = {i: v[0] for ids, vectors in embedding.encode_all(encode, items, 8, limiter, lost) for i, v in zip(ids, vectors)}
    assert got == {i: float(20 - i) for i in range(12)} and lost == [99] and max(sizes) == 8
    assert list(embedding.encode_all(encode, [], 8)) == []


def test_limiter_recovers():
    limiter = embedding.Limiter(patience=3)
    for ok in (False, False, True, True, False, True, True, True):
        limiter.record(ok)
    assert (limiter.halvings, limiter.share(64), limiter.share(1)) == (2, 16, 1)
    for _ in range(20):
        limiter.record(True)
    assert limiter.share(64) == 64


def test_embedding_of_a_queue(spark):
    queue = embedding.items(spark.createDataFrame([(i, f"word {'x ' * i}") for i in range(30)], "unit_id long, text string"), "unit_id").repartition(3)
    make = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]
    got = {r["id"]: r["vector"] for r in embedding.embed(queue, make, 4, 8).collect()}
    want = {r["id"]: [float(len(r["text"])), 1.0] for r in queue.collect()}
    assert got == want and len(want) == 30


def test_roll_up_of_units_above(spark):
    rows = [(1, None, 2, None), (2, 1, 1, None), (3, 1, 1, None), (4, 2, 0, "abc"), (5, 3, 0, "a"), (6, 1, 0, "no"), (7, None, 2, None)]
    units = spark.createDataFrame(rows, "unit_id long, parent_id long, height int, text string")
    vectors = spark.createDataFrame([(2, [1.0, 0.0]), (3, [0.0, 1.0])], "unit_id long, vector array<double>")
    got = {r["unit_id"]: r["vector"] for r in embedding.roll_up(units, vectors).collect()}
    assert list(got) == [1] and got[1] == pytest.approx([3 / 10**0.5, 1 / 10**0.5])
    assert embedding.at_height(units, 0).count() == 3 and embedding.at_height(units).count() == 2


def test_span_store(spark, tmp_path):
    leaves = spark.createDataFrame([(1, None, i, t) for i, t in enumerate(["a b c", "d e", "w1 w2 w3 w4. w5 w6 w7 w8 w9"], 1)], "version_id long, parent_id long, unit_id long, text string")
    built = spans.build(leaves, 5, 1, 6)
    more = leaves.select("unit_id", F.col("text").alias("unit_text"), F.concat(F.lit("L"), "unit_id").alias("label"), F.concat(F.lit("/L"), "unit_id").alias("path"), F.lit(3).cast("long").alias("corpus_id"))
    made, bridge = span_store.drafts(built.join(more, "unit_id"), 9)
    rows = sorted(made.collect(), key=lambda r: (r["start_unit_id"], r["start_char"]))
    assert [(r["text"], r["start_char"], r["end_char"], r["label"], r["path"]) for r in rows[:2]] == [("a b c d e", 0, 3, "L1 - L2", "/L1"), ("w1 w2 w3 w4.", 0, 12, "L3", "/L3")]
    assert "w1 w2 w3 w4. w5 w6 w7 w8 w9"[rows[2]["start_char"] : rows[2]["end_char"]] == rows[2]["text"] and json.loads(rows[0]["metadata"]) == {"segmentation": "aggregate-small-units", "units": 2}
    folder = str(tmp_path / "s")
    span_store.insert(folder, 9, made, bridge)
    n = made.count()
    vectors = made.select("profile_id", "span_id", F.array(F.lit(1.0)).alias("vector"))
    span_store.add_vectors(folder, 9, vectors)
    before = {t: span_store.read(spark, folder, t) for t in span_store.TABLES}
    with pytest.raises(ValueError, match="already"):
        span_store.insert(folder, 9, made, bridge)
    span_store.insert(folder, 9, made.filter("start_unit_id = 3"), bridge.filter("unit_id = 3"), replace=True, corpora=[3])
    assert span_store.read(spark, folder, "spans").count() == n - 1 and span_store.read(spark, folder, "bridge").filter("unit_id = 1").count() == 0
    assert span_store.report(span_store.read(spark, folder, "spans")).first()["spans"] == n - 1
    for gone in ("span_vectors", "none"):
        with pytest.raises(LookupError):
            span_store.read(spark, folder, gone)
    # A reader that has begun goes on with what it has, until old folders are taken away.
    assert [before[t].count() for t in ("spans", "span_vectors")] == [n, n]
    # Another profile, one corpus of two taken away, and a change that is broken off.
    both = made.withColumn("profile_id", F.lit(8)).withColumn("corpus_id", F.when(F.col("start_unit_id") == 3, 4).otherwise(F.col("corpus_id")).cast("long"))
    span_store.insert(folder, 8, both, bridge.withColumn("profile_id", F.lit(8)))
    span_store.delete(spark, folder, 8, corpora=[4])
    left = span_store.read(spark, folder, "spans").filter("profile_id = 8")
    assert {r["corpus_id"] for r in left.collect()} == {3} and span_store.read(spark, folder, "bridge").filter("profile_id = 8").join(left, "span_id", "left_anti").count() == 0
    state = (tmp_path / "s" / "current.json").read_text()
    with pytest.raises(Exception, match="too bad"):
        span_store.insert(folder, 7, made, bridge.withColumn("unit_id", F.raise_error(F.lit("too bad")).cast("long")))
    assert (tmp_path / "s" / "current.json").read_text() == state and span_store.read(spark, folder, "spans").filter("profile_id = 7").count() == 0
    named = {p.name for p in (tmp_path / "s" / "data").iterdir()}
    assert set(span_store.clean(spark, folder)) < named and span_store.read(spark, folder, "spans").count() == n - 1 + left.count() and span_store.clean(spark, folder) == []
    span_store.delete(spark, folder, 8)
    span_store.delete(spark, folder, 9)
    assert span_store.read(spark, folder, "spans", made.schema).count() == 0
    there = spark.createDataFrame([(1, "m", "unit")], "method_id int, model string, label string")
    want = spark.createDataFrame([("m", "unit"), ("m", "span")], "model string, label string")
    assert sorted(tuple(r) for r in span_store.get_or_create(there, want, ["model", "label"], "method_id").collect()) == [(1, "m", "unit"), (2, "m", "span")]
    assert sorted(tuple(r) for r in span_store.upsert(there, spark.createDataFrame([(5, "m", "unit")], there.schema), "label").collect()) == [(5, "m", "unit")]
    assert span_store.metadata(b=1, a="é") == '{"a": "é", "b": 1}'


def test_result_defaults(spark):
    one = spark.range(1)
    text = lambda *v: results.first_filled(*(F.lit(x).cast("string") for x in v))
    assert one.select(text("", "u"), text(None, "u"), text("s", "u"), text("", "")).first()[:] == ("u", "u", "s", "")
    assert results.chosen_ids([], [1, 2]) is None and results.chosen_ids([2, 1], [1, 2]) is None and results.chosen_ids([2], [1, 2]) == [2]
    ids = lambda *v: results.reading_unit(*(F.lit(x).cast("long") for x in v[:2]), F.array(*(F.lit(x).cast("long") for x in v[2])), F.lit(v[3]).cast("long"))
    assert one.select(ids(None, None, [7, 8], 9), ids(None, None, [], 9), ids(1, 2, [], 9)).first()[:] == (7, 9, 1)
    df = spark.createDataFrame([(i, i % 2, f"n{i}") for i in range(5)], "id long, t long, name string")
    assert [(r["id"], r["more"]) for r in results.page(df, ["id"], 2, 2).collect()] == [(2, True), (3, True)] and [r["more"] for r in results.page(df, ["id"], 2, 4).collect()] == [False]
    assert results.resolve(df, "name", ["n3", "n1"], "id") == [3, 1] and [r["id"] for r in results.recent(df, "t", "id", 3).collect()] == [3, 1, 4]
    with pytest.raises(LookupError, match="zz"):
        results.resolve(df, "name", ["n1", "zz"], "id")
    found = results.by_corpus(spark.createDataFrame([("B", 0, 5), ("A", 1, 6), ("B", 2, 7)], "corpus string, place int, unit_id long"), "place")
    assert [tuple(r) for r in found.orderBy("place").collect()] == [("B", 0, [5, 7]), ("A", 1, [6])] and results.by_corpus(df.select(F.col("name").alias("corpus"), F.col("id").alias("unit_id"), "t"), "t", query="a").count() == 0


def test_semantic_search_falls_back_to_units(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    asked = []
    encode = lambda t: asked.append(t) or [0.0, 2.0]
    assert [tuple(r) for r in results.semantic_search(encode, "q", v.limit(0), v, 1).collect()] == [("unit", 2, 1.0)] and asked == ["search_query: q"]
    assert results.semantic_search(encode, "q", v, v.limit(0), 1).first()["kind"] == "span"


def test_map_tables(spark):
    points = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 0.0), (1, 1, 1, 5.0, 5.0, 5.0), (2, 0, 1, 1.0, 2.0, 2.0)], "unit_id long, layer int, corpus_id long, x double, y double, z double")
    placed = mapview.positions(points)
    assert {r["unit_id"]: r["x"] for r in placed.collect()} == {1: 5.0, 2: 1.0}
    found = spark.createDataFrame([(7, 9, 2, [1]), (8, 9, 9, [9, 1]), (6, 9, 9, [])], "span_id long, primary_unit_id long, start_unit_id long, support_unit_ids array<bigint>")
    own = spark.createDataFrame([(7, 3.0, 3.0, 3.0)], "span_id long, x double, y double, z double")
    assert {r["span_id"]: r["x"] for r in mapview.result_positions(found, own, placed).collect()} == {7: 3.0, 8: 5.0, 6: None}
    lines = mapview.constellation(placed.withColumn("place", F.col("unit_id")), "place").collect()
    assert [(r["x0"], r["x1"]) for r in lines] == [(5.0, 1.0)] and mapview.constellation(placed.limit(0).withColumn("place", F.col("unit_id")), "place").count() == 0
    flags = mapview.visibility(spark.range(4).withColumnRenamed("id", "version_id"), spark.createDataFrame([(1, False), (99, False)], "version_id long, visible boolean"))
    assert {r[0]: r[1] for r in flags.collect()} == {0: True, 1: False, 2: True, 3: True}
    group = F.col("version_id") <= 1
    assert {r[0]: r[1] for r in mapview.toggled(flags, group).collect()} == dict.fromkeys(range(4), True)
    alone = mapview.solo(flags, group)
    assert {r[0]: r[1] for r in alone.collect()} == {0: True, 1: True, 2: False, 3: False} and all(r[1] for r in mapview.solo(alone, group).collect())
    axes = mapview.chosen_axes(spark.createDataFrame([([1.0, 2.0],)], "coords array<double>"), 1, 0, 5).first()
    assert (axes["x"], axes["y"], axes["z"]) == (2.0, 1.0, 0.0)
    box = spark.createDataFrame([(0.0, 4.0, 0.0, 2.0)], "x_min double, x_max double, y_min double, y_max double")
    assert mapview.first_view(box, 80 / 7 * 4).first()[:] == pytest.approx((2.0, 1.0, 3.0)) and mapview.point_radius(box).first()[0] == 4 / 250
    assert mapview.rgb(0, 100, 50) == (255, 0, 0) and mapview.rgb(120, 100, 25) == (0, 128, 0) and mapview.rgb(0, 0, 100) == (255, 255, 255)
    c = spark.range(1).select(*(mapview.variant(F.lit(n), "corpus", F.lit(10), F.lit(50), F.lit(50)).alias(f"c{k}") for k, n in enumerate(("Quran", " quran ", "Gita")))).first()
    assert c["c0"] == c["c1"] != c["c2"] and 28 <= c["c0"]["s"] <= 90
    named = mapview.translations(spark.createDataFrame([(1, 1, "a"), (2, 1, " "), (3, 1, "c"), (4, 2, "d")], "version_id long, corpus_id long, translation string"), spark.createDataFrame([(1,), (2,), (4,)], "version_id long"))
    assert {r[0]: r[1] for r in named.collect()} == {1: 1, 2: 1}


def test_levels(spark):
    corpora = spark.createDataFrame([(1,), (2,), (3,)], "corpus_id long")
    levels = spark.createDataFrame([(1, 0, "Verse"), (1, 2, "Books"), (2, 0, "Tale")], "corpus_id long, height int, name string")
    assert {r[0]: r[1] for r in results.level_names(corpora, levels, 0, 5).collect()} == {1: "Verse – Books", 2: "Tale", 3: "passage"}
    assert {r[0]: r[1] for r in results.level_names(corpora, levels, 1, 1).collect()}[1] == "Verse" and results.top_height(levels).first()[0] == 2 and results.top_height(levels.limit(0)).first()[0] == 0
    units = spark.createDataFrame([(5, 1, 1), (6, 1, 3), (7, 1, 2), (8, 1, 0)], "unit_id long, corpus_id long, height int")
    assert {r[0]: r[1] for r in results.child_titles(units, levels).collect()} == {5: "Verses", 6: "Books", 7: "Levels"}


def test_sequences_and_times(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "h"), (3, "c", None)], "n long, t string, head string").withColumn("k", F.lit(0))
    assert [r["f"] for r in sequences.filled(df, ["k"], "n", F.col("head"), "f").orderBy("n").collect()] == [None, "h", "h"]
    assert [r["session"] for r in sequences.sessions(df, ["k"], "n", F.col("t") == "b").orderBy("n").collect()] == [0, 0, 1]
    assert sequences.ordered_text(df, ["k"], "n", "t", "-").first()["text"] == "a-b-c"
    t = spark.sql("select timestamp '2026-04-13 21:37:15' as t").select(T.run_id(F.col("t")), T.iso_time(F.col("t"))).first()
    assert t[:] == ("2026-04-13_213715", "2026-04-13T21:37:15") and spark.range(1).select(T.span_path(F.array(F.lit("/a"), F.lit("/b")))).first()[0] == "/a"
    spans_ = spark.createDataFrame([("one " * 300,), ("",), ("é b",)], "t string").select(T.word_spans(F.col("t")).alias("s")).collect()
    assert [(x["start"], x["end"]) for x in spans_[0]["s"]] == [(4 * i, 4 * i + 3) for i in range(300)] and spans_[1]["s"] == [] and [(x["start"], x["end"]) for x in spans_[2]["s"]] == [(0, 1), (2, 3)]
