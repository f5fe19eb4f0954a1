import json
import sqlite3
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvan.functions import text as T
from silvan.operators import ingest
from silvan.plans import jobs
from silvan.sources import documents, projection_file, tabular


def test_csv_units(spark, tmp_path):
    (tmp_path / "q.csv").write_text('ch,name,v,t\n1,"A ""x""",1,one\n1,"A ""x""",2," "\n2,B,1,"two\nlines"\n')
    rows = tabular.read_csv(spark, str(tmp_path / "q.csv"), ["ch", "name", "v", "t"]).withColumn("n", F.monotonically_increasing_id())
    got = tabular.leveled(rows, [("ch", "name"), ("v", None)], "t", "n").collect()
    assert {(r["key"], r["parent_key"], r["depth"], r["label"], r["text"]) for r in got} == {
        ("1", None, 0, 'A "x"', None), ("2", None, 0, "B", None), ("1/1", "1", 1, "1", "one"), ("2/1", "2", 1, "1", "two lines"),
    }


def test_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "b.db") as con:
        con.execute("create table v(id int, t text)")
        con.executemany("insert into v values (?, ?)", [(1, "a"), (2, None)])
    got = tabular.read_sqlite(spark, str(tmp_path / "b.db"), "select id, t from v order by id", "id long, t string").collect()
    assert [tuple(r) for r in got] == [(1, "a"), (2, None)]


def test_json_and_catalog(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"chapter": 1, "verse": 2, "translation": "x"}, {"chapter": 1}]))
    assert tabular.read_json_array(spark, str(tmp_path / "r.json"), "chapter int, verse int, translation string").count() == 1
    entries = [{"corpus": " A b ", "translation": "C", "url": "http://u"}]
    (tmp_path / "s.json").write_text(json.dumps(entries))
    assert tabular.source_catalog(spark, str(tmp_path / "s.json")).first()["source_key"] == "a-b-c"
    (tmp_path / "d.json").write_text(json.dumps(entries * 2))
    with pytest.raises(ValueError):
        tabular.source_catalog(spark, str(tmp_path / "d.json"))


def test_headings_and_items(spark, tmp_path):
    text = "x\n*** START OF THIS\nBOOK I\n1. first\nmore\n2. second\nBOOK II\nI. third\nNOTES\n9. no\n*** END OF THIS\n7. tail\n"
    (tmp_path / "g.txt").write_text(text)
    cut = documents.sections(documents.lines(documents.read_texts(spark, str(tmp_path / "g.txt"))), [r"^BOOK ([IVX]+)$"], stop="^NOTES")
    got = {(r["h0"], r["number"], r["text"]) for r in documents.numbered_items(cut, ["h0"]).collect()}
    assert got == {("I", 1, "first more"), ("I", 2, "second"), ("II", 1, "third")}


def test_html_and_epub(spark, tmp_path):
    page = "<html><title>V</title><h2 id=y1>Head</h2><p>A long enough paragraph.<p>short</p><p>Footnote 1</p><p>Another long paragraph here.</p>"
    blocks = documents.parse_html(spark.createDataFrame([(1, page), (2, None)], "id long, html string"), "id")
    assert [(r["heading"], r["text"]) for r in documents.page_paragraphs(blocks, "id").collect()] == [("Head", "A long enough paragraph.")]
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        for name in ("text/dn10.html", "text/dn2.html", "text/cover.html"):
            z.writestr(name, f"<p>{name}</p>")
    items = documents.read_epub(spark, str(tmp_path / "b.epub"), prefix="dn").orderBy(T.natural_key(F.col("item"))).collect()
    assert [r["item"] for r in items] == ["text/dn2.html", "text/dn10.html"]


def test_sources_conflict(spark):
    there = spark.createDataFrame([(1, "k", "http://a")], "id long, source_key string, url string")
    want = spark.createDataFrame([("k", "http://a"), ("n", "http://b"), ("m", "http://a")], "source_key string, url string")
    assert {r["source_key"]: r["source_id"] for r in ingest.resolve_sources(want, there).collect()} == {"k": 1, "n": None, "m": 1}
    with pytest.raises(Exception, match="another url"):
        ingest.resolve_sources(spark.createDataFrame([("k", "http://c")], "source_key string, url string"), there).collect()


def test_stream_takes_in_once(spark, tmp_path):
    from silvan.streaming.ingest import take_in

    schema = "corpus string, translation string, key string"
    args = (str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), schema)
    spark.createDataFrame([("a", "t", "1"), ("a", "t", "2")], schema).write.parquet(args[0])
    assert take_in(spark, *args) == 1 and take_in(spark, *args) == 0
    spark.createDataFrame([("a", "t", "1"), ("b", "t", "1")], schema).write.mode("append").parquet(args[0])
    take_in(spark, *args)
    assert sorted(tuple(r)[:3] for r in spark.read.parquet(args[1]).collect()) == [("a", "t", "1"), ("a", "t", "2"), ("b", "t", "1")]


def test_steps():
    done = []
    steps = [jobs.Step(n, lambda n=n: done.append(n)) for n in "abcd"]
    jobs.run(jobs.select(steps, first="b", last="d", skip=["c"]))
    assert done == ["b", "d"] and [s.name for s in jobs.select(steps, only=["c"])] == ["c"]
    assert jobs.run(steps, dry=True) == dict.fromkeys("abcd") and done == ["b", "d"]
    with pytest.raises(KeyError):
        jobs.select(steps, only=["z"])


def test_projection_run(spark, tmp_path):
    rows = [(i, 1, i % 2, 1, [float(i), 0.5]) for i in range(5)]
    points = spark.createDataFrame(rows, "unit_id long, corpus_id long, version_id long, depth int, coords array<float>")
    spans = spark.createDataFrame([(9, 1, 0, 1, 2, 1, 7, [0.5, 1.5]), (8, 1, 1, 3, 3, 3, 4, [2.5, 3.5])], "span_id long, corpus_id long, version_id long, start_unit_id long, end_unit_id long, primary_unit_id long, token_count long, coords array<float>")
    labels = spark.createDataFrame([(1, "one"), (2, None)], "unit_id long, label string")
    base = str(tmp_path / "p")
    projection_file.write_run(points, labels, base, "umap", "r1", "2026-01-01", {"label": "window-50", "target_tokens": 50}, spans)
    made = projection_file.write_run(points, labels, base, "umap", "r2", "2026-01-02", {"label": "window-50"}, seed=42)
    assert (made["corpus_version_counts"], made["max_depth"], made["n_components"], made["seed"]) == ({"0": 3, "1": 2}, 1, 2, 42)
    got, none, manifest = projection_file.read_run(spark, base, "umap", "window-50")
    assert manifest["run_id"] == "r2" and none is None and sorted((r["unit_id"], r["coords"]) for r in got.collect()) == [(i, [float(i), 0.5, 0.0]) for i in range(5)]
    _, held, _ = projection_file.read_run(spark, base, "umap", "window-50", "r1")
    assert sorted(tuple(r) for r in held.select(*spans.columns).collect()) == sorted(tuple(r) for r in spans.collect())
    assert json.loads((tmp_path / "p/umap/window-50/r1/unit_labels.json").read_text()) == {"1": "one"}
    with pytest.raises(FileNotFoundError):
        projection_file.read_run(spark, base, "umap", "window-100")
    with pytest.raises(ValueError, match="32 bits"):
        projection_file.encode([1 << 31], [[0.0]], [1], [1])
    # Runs that lie directly under the method, and older ones under their id.
    projection_file.write_run(points, labels, base, "pca", "r3", "2026-01-03")
    assert projection_file.latest_id(spark, base, "pca", "window-50") == "r3" and projection_file.find_run(spark, base, "pca", "r3", "window-50")[1]["run_id"] == "r3"


def test_reports(spark, tmp_path):
    from silvan.sources import reports

    df = spark.createDataFrame([("a", 0.123456, 3), ("b", 1.0, 9)], "label string, x double, n long").withColumn("bin", F.lit(0))
    made = reports.write(str(tmp_path), "r", "now", {"t": df}, {"h": df}, "A & b")
    page = (tmp_path / "r/report.html").read_text()
    assert made["rows"] == {"t": 2} and "A &amp; b" in page and page.count("<rect") == 2
    reports.write_csv(df, str(tmp_path / "c"), ["n", "x", "other"], ["n"])
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()] == [("3", "0.1235", None), ("9", "1.0", None)]


def test_whole_ingest(spark):
    from silvan.sources.corpora import UNIT

    unit = lambda c, t, *r: (c, t, *r)
    rows = [
        unit("A", "t1", "b", None, 0, "B", None, None, None, None, 1), unit("A", "t1", "b/1", "b", 1, "1", "one", "eins", "x", None, 2), unit("A", "t1", "b/2", "gone", 1, "", "two", None, None, None, 3),
        unit("C", "t2", "b", None, 0, None, "leaf", None, None, None, 1), unit("A", "old", "k", None, 0, "K", "no", None, None, None, 1),
    ]
    units = spark.createDataFrame(rows, "corpus string, translation string, key string, parent_key string, depth int, label string, text string, uncleaned_text string, author string, metadata string, position long")
    assert units.columns[2:] == list(UNIT)
    tables = ingest.empty_tables(spark)
    tables["corpus"] = spark.createDataFrame([(4, "A", None)], ingest.TABLES["corpus"])
    tables["version"] = spark.createDataFrame([(7, 4, None, "old", None, "en", None)], ingest.TABLES["version"])
    tables["unit"] = spark.createDataFrame([(50, 7, 4, None, 0, 0, "K", None, "no", None, "/K", None)], ingest.TABLES["unit"])
    tables["level"] = spark.createDataFrame([(4, 0, "Verse")], ingest.TABLES["level"])
    tables["source"] = spark.createDataFrame([(1, "k", "http://a")], ingest.TABLES["source"])
    tax = spark.createDataFrame([(1, "T"), (2, "U")], "id long, name string")
    wanted = [
        ingest.Version("A", "t1", levels=("Book", "Verse"), taxonomy=("T", "Nowhere"), source_key="k", url="http://a", path="/in"),
        ingest.Version("C", "t2", levels=("Tale",), taxonomy=("U",), source_key="n", url="http://n"), ingest.Version("A", "old"),
    ]
    new = ingest.ingest(units, wanted, tables, tax)
    assert [tuple(r) for r in new["corpus"].collect()] == [(5, "C", None)]
    assert sorted((r["version_id"], r["corpus_id"], r["source_id"], r["translation"], r["metadata"]) for r in new["version"].collect()) == [(8, 4, 1, "t1", '{"ingest_input_path": "/in"}'), (9, 5, 2, "t2", None)]
    assert sorted(tuple(r) for r in new["level"].collect()) == [(4, 1, "Book"), (5, 0, "Tale")]
    assert [tuple(r) for r in new["source"].collect()] == [(2, "n", "http://n")] and sorted(tuple(r) for r in new["link"].collect()) == [(4, 1), (5, 2)]
    assert [r[0] for r in new["missing"].collect()] == ["Nowhere"]
    got = sorted((r["unit_id"], r["version_id"], r["parent_id"], r["height"], r["path"]) for r in new["unit"].collect())
    assert got == [(51, 8, None, 1, "/B"), (52, 8, 51, 0, "/B/1"), (53, 8, None, 0, "/53"), (54, 9, None, 0, "/54")]
    both = {k: tables[k].unionByName(new[k].select(tables[k].columns)) for k in tables}
    assert all(df.count() == 0 for df in ingest.ingest(units, wanted, both, tax).values())


def test_sources_of_all_versions(spark):
    versions = spark.createDataFrame([(1, "A", "x"), (2, "B", "y")], "version_id long, corpus string, translation string")
    catalog = spark.createDataFrame([("A", "x", "k", "http://a"), ("B", "y", "n", "http://b"), ("Z", "z", "z", "http://z")], "corpus string, translation string, source_key string, url string")
    there = spark.createDataFrame([(5, "k", "http://a")], "id long, source_key string, url string")
    got, sources = ingest.normalise_sources(versions, catalog, there)
    assert {r["version_id"]: r["source_id"] for r in got.collect()} == {1: 5, 2: 6} and sources.count() == 2
    assert {r["version_id"]: r["source"] for r in ingest.denormalise_sources(got, sources).collect()} == {1: "http://a", 2: "http://b"}
    with pytest.raises(LookupError, match="B / y"):
        ingest.normalise_sources(versions, catalog.limit(1), there)


def test_stream_reads_a_version_with_its_batch_only(spark, tmp_path):
    from silvan.streaming.ingest import take_in

    schema = "corpus string, translation string, key string"
    args = (str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), schema)
    for k in ("1", "2"):
        spark.createDataFrame([("a", "t", k)], schema).coalesce(1).write.mode("append").parquet(args[0])
    assert take_in(spark, *args, max_files=1) == 2
    got = [tuple(r) for r in spark.read.parquet(args[1]).collect()]
    assert len(got) == 1 and got[0][3] == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "_SUCCESS").write_text("")
    (tmp_path / "bad" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):  # not taken for a folder that nothing was written to
        take_in(spark, args[0], str(tmp_path / "bad"), str(tmp_path / "cp2"), schema)


def test_products():
    assert [s.name for s in jobs.product(["w50", "w100"], ["pca", "umap"], lambda p, m: lambda: None)] == ["w50/pca", "w50/umap", "w100/pca", "w100/umap"]
