"""The forest of a taxonomy, colours, point styles, passages, and queries that SQL can't check."""

import json
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from silvan.operators import mapview, projection, search, taxonomy
from silvan.plans import catalog
from silvan.session import read_table
from silvan.sources import documents

SF = "/root/testdata/sf0.001"


def test_forest_with_orphans_and_corpora(spark):
    rows = [(1, "b", None, 0), (2, "A", None, 0), (3, "z", 2, 1), (4, "Y", 2, 1), (5, "deep", 3, 2), (6, "lost", 99, 1), (7, "under lost", 6, 2), (8, "ring", 9, 0), (9, "ring", 8, 0)]
    t = spark.createDataFrame(rows, "id long, name string, parent_id long, level int")
    links = spark.createDataFrame([(11, 3, "Zeta"), (12, 3, "Alpha"), (13, 77, "none"), (14, 6, None)], "corpus_id long, taxonomy_id long, corpus string")
    found = taxonomy.forest(t, links)
    assert [(r["nth"], r["name"], r["depth"], r["top"]) for r in found.orderBy("nth").collect()] == [
        (1, "A", 0, 2), (2, "Y", 1, 2), (3, "z", 1, 2), (4, "deep", 2, 2), (5, "b", 0, 1), (6, "lost", 0, 6), (7, "under lost", 1, 6)
    ]
    node = lambda id_, name, level, corpora=(), children=(): {"id": id_, "name": name, "level": level, "corpora": list(corpora), "children": list(children)}
    held = [{"corpus_id": 12, "corpus": "Alpha"}, {"corpus_id": 11, "corpus": "Zeta"}]
    assert json.loads(taxonomy.forest_json(found)) == [
        node(2, "A", 0, children=[node(4, "Y", 1), node(3, "z", 1, held, [node(5, "deep", 2)])]), node(1, "b", 0),
        node(6, "lost", 1, [{"corpus_id": 14, "corpus": None}], [node(7, "under lost", 2)]),
    ]
    assert taxonomy.forest_json(taxonomy.forest(t.limit(0))) == "[]" and taxonomy.forest(t).filter("size(corpora) > 0").count() == 0


def test_colours_of_nodes_and_corpora(spark):
    t = spark.createDataFrame([(1, "Abrahamic", None, 0), (2, " christianity", 1, 1), (3, "Unheard of", None, 0), (4, "Zen", 3, 1)], "id long, name string, parent_id long, level int")
    got = {r["id"]: tuple(r["colour"]) for r in mapview.node_colours(t).collect()}
    assert got[1] == (214, 55, 46) and got[2] == (229, 52, 50) and got[4] == (180, 38, 37)
    h = 0
    for c in "unheard of":
        h = (h * 31 + ord(c)) & 0xFFFF
    assert got[3] == ((h % 25 - 12) % 360, max(24, min(86, (h >> 5) % 11 - 5)), max(28, min(68, 43 + (h >> 9) % 15 - 7)))
    corpora = spark.createDataFrame([(1, "Old Testament "), (2, "Gospel"), (3, "alone"), (4, " "), (5, None)], "corpus_id long, name string")
    links = spark.createDataFrame([(1, 2), (2, 1), (2, 4), (2, 2), (4, 2), (5, 3)], "corpus_id long, taxonomy_id long")
    found = {r["corpus_id"]: tuple(r["colour"]) for r in mapview.corpus_colours(corpora, links, t).collect()}
    assert found[1] == (207, 50, 45) and found[3] == (0, 0, 43) and found[4] == (229, 52, 50) and found[5] == got[3]
    # Of two nodes of one level the one with the smaller id.
    base = got[2]
    assert abs((found[2][0] - base[0] + 180) % 360 - 180) <= 5 and abs(found[2][1] - base[1]) <= 6 and abs(found[2][2] - base[2]) <= 10


def test_styles_of_points(spark):
    points = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, None, None), (5, 1, 2)], "unit_id long, corpus_id long, version_id long")
    colours = spark.createDataFrame([(1, [1, 2, 3], [4, 5, 6])], "corpus_id long, fill array<int>, line array<int>")
    visible = spark.createDataFrame([(1, True), (2, False)], "version_id long, visible boolean")
    selected = spark.createDataFrame([(3,), (3,), (5,)], "unit_id long")
    got = {r["unit_id"]: (r["fill"], r["line"]) for r in mapview.point_styles(points, colours, visible, selected, 220).collect()}
    assert got == {
        1: ([1, 2, 3, 220], [4, 5, 6, 240]), 2: ([1, 2, 3, 0], [4, 5, 6, 0]), 3: ([201, 169, 110, 235], [255, 243, 209, 255]),
        4: ([110, 110, 110, 220], [190, 190, 190, 240]), 5: ([201, 169, 110, 0], [255, 243, 209, 0]),
    }


def test_passage_of_a_unit_without_spans(spark):
    spans = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    bridge = spark.createDataFrame([(1, 10, 1.0), (2, 11, 1.0), (9, 12, 1.0)], "span_id long, unit_id long, weight double")
    own = spark.createDataFrame([(10, [0.0, 1.0]), (12, [1.0, 0.0]), (13, [0.0, 2.0])], "unit_id long, vector array<double>")
    page = lambda unit: [r["vec_id"] for r in search.passage(unit, spans, bridge, own).collect()]
    assert page(10) == [3, 2] and page(13) == [2, 3, 1] and page(12) == [1, 3, 2]  # 12's span has no vector
    with pytest.raises(LookupError):
        page(11_000)


def test_stratified_sample_by_plain_hashes(spark):
    docs = [(r["source"], r["doc_id"]) for r in read_table(spark, SF, "documents").select("source", "doc_id").collect()]

    def rank(doc_id):
        """Spark's 64-bit hash of a long, then of the seed as an int."""
        first = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
        return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<i", 42), first)))[0]

    by = {}
    for source, doc_id in docs:
        by.setdefault(source, []).append(doc_id)
    want = {(s, i) for s, ids in by.items() for i in sorted(ids, key=lambda i: (rank(i), i))[:12]}
    assert {tuple(r) for r in catalog.stratified_sample(spark, SF).collect()} == want


def test_shares_of_variance_by_numpy(spark):
    x = np.array([r["embedding"] for r in read_table(spark, SF, "embeddings").collect()], np.float64)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    got = catalog.pca_variance(spark, SF).orderBy("component").collect()
    assert [r["share"] for r in got] == pytest.approx((values / values.sum())[: len(got)], abs=2e-6) and len(got) == 50 or got[-1]["cumulative"] >= 0.95


def test_variance_of_no_vectors(spark):
    none = spark.createDataFrame([(None,), (None,)], "v array<double>")
    with pytest.raises(ValueError, match="no vectors"):
        projection.moments(none, "v")
    assert [r["coords"] for r in projection.pca(none, "v").collect()] == [None, None] == [r["coords"] for r in projection.pca(none.union(none).limit(2), "v").collect()]


def test_blocks_of_pages_by_their_tags(spark):
    """Opening tags counted in the raw pages; blocks without a text are none."""
    pages = [r["html"] or "" for r in read_table(spark, SF, "pages").collect()]
    got = {r["tag"]: r["n"] for r in catalog.page_blocks(spark, SF).collect()}
    for tag, n in got.items():
        opened = sum(len(re.findall(rf"<{tag}[\s>]", p, re.I)) for p in pages)
        blank = sum(len(re.findall(rf"<{tag}(?:\s[^>]*)?>(?:\s|<[^>]*>)*</{tag}>", p, re.I)) for p in pages)
        assert opened - blank <= n <= opened, (tag, n, opened, blank)


def test_blocks_are_handed_on_a_few_pages_at_a_time(monkeypatch):
    """However many pages a batch has, what is held of their blocks is bounded; a page's blocks stay whole and in order."""
    monkeypatch.setattr(documents, "BATCH_BLOCKS", 10)
    monkeypatch.setattr(documents, "BATCH_CHARS", 1000)
    pages = ["".join(f"<p id=b{j}>text {k} {j}</p>" for j in range(k % 4)) for k in range(200)] + [None, "<p>" + "x" * 5000 + "</p>", "<li>last"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(pages)], ["page", "html"])
    names = ["page", "n", "tag", "element_id", "text", "lines", "classes", "within"]
    made = list(documents._block_batches(batch, names, None))
    assert len(made) > 20 and max(x.num_rows for x in made) <= 13
    got = [(r["page"], r["n"], r["tag"], r["element_id"], r["text"]) for x in made for r in x.to_pylist()]
    assert got == [(k, n, b["tag"], b["id"], b["text"]) for k, p in enumerate(pages) for n, b in enumerate(documents.html_blocks(p or ""))]


def test_projections_place_all_vectors(spark):
    for name in ("umap", "phate", "isomap"):
        rows = catalog.QUERIES[name](spark, SF).collect()
        assert len(rows) == read_table(spark, SF, "embeddings").count() and all(len(r["coords"]) == 3 for r in rows)
        assert [tuple(r) for r in sorted(rows)] == [tuple(r) for r in sorted(catalog.QUERIES[name](spark, SF).collect())]
