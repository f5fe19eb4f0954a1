"""SQLite tables and projection runs as data sources."""

import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvan.sources import datasources, projection_file


def test_sqlite_table_in_partitions(spark, tmp_path):
    path = str(tmp_path / "a.db")
    rows = [(k, f"t{k % 7}" if k % 5 else None, k / 3, bytes([k % 256])) for k in range(1000)]
    with sqlite3.connect(path) as con:
        con.execute('create table "v w" (id integer, "te""xt" varchar(9), x double, b blob, "odd`" any)')
        con.executemany('insert into "v w" values (?, ?, ?, ?, null)', rows)
        con.execute("insert into \"v w\" values ('words', 5, 'none', 'text', x'41')")
        con.execute('delete from "v w" where id between 300 and 399')
        con.execute('create view few as select id, x from "v w" where id < 10')
    df = datasources.read_sqlite_table(spark, path, "v w", 4)
    assert df.dtypes == [("id", "bigint"), ('te"xt', "string"), ("x", "double"), ("b", "binary"), ("odd`", "string")] and df.rdd.getNumPartitions() == 4
    kept = [r for r in rows if not 300 <= r[0] < 400]
    got = sorted((tuple(r)[:4] for r in df.filter("id is not null").collect()), key=lambda r: r[0])
    assert [(a, b, c, bytes(d)) for a, b, c, d in got] == kept
    assert [tuple(r) for r in df.filter("id is null").collect()] == [(None, "5", None, bytearray(b"text"), "A")]
    text = F.col('`te"xt`')
    for cond, plain in (
        ((F.col("id") >= 950) & (F.col("id") < 990), lambda r: 950 <= r[0] < 990), (text == "t3", lambda r: r[1] == "t3"), (F.col("id").isin(1, 2, 700), lambda r: r[0] in (1, 2, 700)),
        (text.isin("t1", "t2") & (F.col("x") > 100.5), lambda r: r[1] in ("t1", "t2") and r[2] > 100.5), (text.isNotNull() & (F.col("id") <= 20), lambda r: r[1] and r[0] <= 20),
        (text.startswith("t6"), lambda r: (r[1] or "").startswith("t6")), (text == "5", lambda r: False),
    ):
        assert sorted(r["id"] for r in df.filter(cond & F.col("id").isNotNull()).collect()) == [r[0] for r in kept if plain(r)]
    assert [r["id"] for r in datasources.read_sqlite_table(spark, path, "few", 3).collect()] == list(range(10))
    with pytest.raises(Exception, match="none"):
        datasources.read_sqlite_table(spark, path, "none").count()


def test_conditions_reach_sqlite(tmp_path):
    from pyspark.sql import datasource as ds
    from pyspark.sql.types import StructType

    reader = datasources.SqliteReader("p", "t", StructType.fromDDL("a bigint, b string"), 1)
    filters = [ds.EqualTo(("a",), 3), ds.In(("b",), ("x", "y")), ds.GreaterThan(("b",), "k"), ds.EqualTo(("a",), "text"), ds.StringContains(("b",), "z")]
    assert list(reader.pushFilters(filters)) == filters and reader.where == ['"a" = ?', '"b" in (?, ?)', '"b" > ?'] and reader.values == [3, "x", "y", "k"]


@pytest.fixture()
def run(spark):
    rng = np.random.default_rng(3)
    rows = [(k, k % 4, 10 + k % 3, k % 2, rng.random(2).astype(np.float32).tolist()) for k in rng.permutation(500).tolist()]
    points = spark.createDataFrame(rows, "unit_id long, corpus_id long, version_id long, depth int, coords array<float>").repartition(5)
    spans = spark.createDataFrame([(k, 1, 10, k, k + 1, k, 7, [0.5, k / 2]) for k in range(90, 0, -1)], "span_id long, corpus_id long, version_id long, start_unit_id long, end_unit_id long, primary_unit_id long, token_count long, coords array<float>")
    labels = spark.createDataFrame([(k, f'"lé" {k}' if k % 3 else None) for k in range(200, 0, -1)], "unit_id long, label string")
    return rows, points, spans, labels


def test_run_there_and_back(spark, run, tmp_path):
    rows, points, spans, labels = run
    base = str(tmp_path)
    made = projection_file.write_run(points, labels, base, "umap", "r1", "now", None, spans, seed=1)
    assert made["corpus_version_counts"] == {"10": 167, "11": 167, "12": 166} and (made["max_depth"], made["n_components"], made["span_count"], made["seed"]) == (1, 2, 90, 1)
    folder = tmp_path / "umap" / "r1"
    assert sorted(f.name for f in folder.iterdir() if not f.name.endswith(".crc")) == ["corpus_version_10.bin", "corpus_version_11.bin", "corpus_version_12.bin", "manifest.json", "spans.bin", "unit_labels.json"]
    ids, coords, corpus, version = projection_file.decode((folder / "corpus_version_11.bin").read_bytes(), 2)
    want = sorted(r for r in rows if r[2] == 11)
    assert ids.tolist() == [r[0] for r in want] and coords.tolist() == [r[4] for r in want] and corpus.tolist() == [r[1] for r in want] and set(version.tolist()) == {11}
    assert json.loads((folder / "unit_labels.json").read_text()) == {str(k): f'"lé" {k}' for k in range(1, 201) if k % 3}
    got, held, _ = projection_file.read_run(spark, base, "umap")
    assert sorted((r["unit_id"], r["corpus_id"], r["version_id"], r["coords"]) for r in got.collect()) == sorted((r[0], r[1], r[2], [*r[4], 0.0]) for r in rows)
    assert sorted(map(tuple, held.select(*spans.columns).collect())) == sorted(map(tuple, spans.collect()))
    # Few rows a task, and of one version only its file.
    small = spark.read.format("silvan_run").option("rows", 40).load(str(folder))
    assert small.rdd.getNumPartitions() == 15 and small.count() == 500
    (folder / "corpus_version_12.bin").write_bytes(b"broken")
    assert small.filter("version_id = 11").count() == 167 and small.filter("version_id in (10, 11) and unit_id < 30").count() == 20
    with pytest.raises(Exception, match="does not fit"):
        spark.read.format("silvan_run").load(str(folder)).count()
    no_units = projection_file.write_run(points.limit(0), labels.limit(0), base, "umap", "r2", "now")
    assert no_units["corpus_version_ids"] == [] and projection_file.read_run(spark, base, "umap")[0].count() == 0
    with pytest.raises(ValueError, match="fit the count"):
        projection_file.decode(np.zeros(3, "<u4").tobytes(), 2)
    with pytest.raises(ValueError, match="needed"):
        projection_file.check_version({"bin_schema_version": 4})


def test_broken_run_leaves_the_old_pointer(spark, run, tmp_path):
    _, points, _, labels = run
    projection_file.write_run(points, labels, str(tmp_path), "pca", "good", "now")
    wide = points.withColumn("unit_id", F.when(F.col("unit_id") == 77, F.lit(1 << 40)).otherwise(F.col("unit_id")))
    with pytest.raises(Exception, match="32 bits"):
        projection_file.write_run(wide, labels, str(tmp_path), "pca", "bad", "later")
    assert projection_file.latest_id(spark, str(tmp_path), "pca") == "good" and projection_file.read_run(spark, str(tmp_path), "pca")[0].count() == 500
    assert not (tmp_path / "pca" / "bad" / "manifest.json").exists() and not list((tmp_path / "pca").glob("bad/corpus_version_*"))
