"""CSV and JSON corpora, SQLite files and the source catalogue as parsed units: key, parent_key, depth, label, text."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silvan.functions import text as T


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A header file whose fields may hold line ends and doubled quotes; only the named columns."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return df.select(*(F.trim(F.col(f"`{c}`")).alias(c) for c in columns))


def leveled(rows: DataFrame, levels: Sequence[tuple[str, str | None]], text: str, order: str) -> DataFrame:
    """Units of a table in which each row is a leaf and its first columns name the levels above it.

    levels: (key column, label column or None) from the top down, the leaf's last. A parent is made once, at its first row.
    """
    kept = rows.filter(T.blank_to_null(F.col(text)).isNotNull())
    out, above = None, []
    for depth, (key, label) in enumerate(levels):
        above.append(F.col(key).cast("string"))
        me = F.concat_ws("/", *above)
        up = F.concat_ws("/", *above[:-1]) if depth else F.lit(None).cast("string")
        leaf = depth == len(levels) - 1
        unit = kept.select(
            me.alias("key"), up.alias("parent_key"), F.lit(depth).alias("depth"), F.col(label or key).cast("string").alias("label"),
            (T.collapse_spaces(F.col(text)) if leaf else F.lit(None).cast("string")).alias("text"), F.col(order).alias("position"),
        )
        if not leaf:
            unit = unit.groupBy("key", "parent_key", "depth").agg(F.min_by("label", "position").alias("label"), F.min("text").alias("text"), F.min("position").alias("position"))
        out = unit if out is None else out.unionByName(unit)
    return out


def verse_after_point(verse: Column) -> Column:
    """'1.4 – 1.6' gives '4': what is after the last point of the first part."""
    return F.trim(F.substring_index(F.trim(F.split(verse, "–")[0]), ".", -1))


def running_number(df: DataFrame, keys: Sequence[str], order: str, name: str = "verse") -> DataFrame:
    """A counter from 1 within keys, in file order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def read_sqlite(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """A query over SQLite files (a path or glob that Spark reads), one task for each file, which has it in memory."""
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    arrow = spark.createDataFrame([], schema).limit(0).toArrow().schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with sqlite3.connect(":memory:") as con:
                    con.deserialize(content)
                    cursor = con.execute(query)
                    while rows := cursor.fetchmany(10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(scan, schema)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that are arrays of objects, with the file's name; items that lack a field of the schema are left out."""
    df = spark.read.schema(schema).json(path, multiLine=True, mode="DROPMALFORMED").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return df.dropna(subset=[c for c in df.columns if c != "file"])


def source_catalog(spark: SparkSession, path: str) -> DataFrame:
    """corpus, translation, source_key (a slug by default), url, provider, label; an error if one is missing or there twice."""
    fields = ("corpus", "translation", "source_key", "url", "provider", "label")
    df = spark.read.schema(", ".join(f"{c} string" for c in fields)).json(path, multiLine=True)
    df = df.select(*(T.blank_to_null(F.col(c)).alias(c) for c in fields))
    df = df.withColumn("source_key", F.coalesce("source_key", T.slug(F.concat_ws(" ", "corpus", "translation"))))
    if not df.filter("corpus is null or url is null").isEmpty():
        raise ValueError("a catalogue entry lacks its corpus or url")
    if not df.groupBy("corpus", "translation").count().filter("count > 1").isEmpty():
        raise ValueError("a catalogue entry occurs twice")
    return df
