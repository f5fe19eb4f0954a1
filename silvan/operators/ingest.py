"""Ingest of parsed units into the tables: natural keys, ids, parents, paths, sources; integrity queries; idempotent re-runs."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silvan.functions import text as T
from silvan.operators.tree import heights, paths
from silvan.session import cut, scratch_path

#: Bytes of text in a range of the queue, and how many of its rows are drawn to find where ranges begin.
RANGE_BYTES, SAMPLED = 1 << 26, 50


def new_versions(parsed: DataFrame, existing: DataFrame) -> DataFrame:
    """parsed units (corpus, translation, ...) whose version does not exist yet; the others are skipped whole."""
    key = ["corpus", "translation"]
    return parsed.join(existing.select(*key).distinct(), key, "left_anti")


def assign_ids(parsed: DataFrame, first_id: int, order: str = "position") -> DataFrame:
    """unit_id and parent_id for units with key and parent_key, parents by key within a version; a missing parent makes a root.

    Ids are counted within ranges of the sorted units and shifted by the ranges' counts, so no task numbers all rows. The
    ranges are written once (a checkpoint), as a second reading could cut them elsewhere.
    """
    keys = ["corpus", "translation"]
    ranged = cut(parsed.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order).withColumn("__p", F.spark_partition_id()))
    counts = ranged.groupBy("__p").count()
    start = counts.select("__p", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    nth = F.row_number().over(Window.partitionBy("__p").orderBy(*keys, order))
    df = ranged.withColumn("__n", nth).join(start, "__p").withColumn("unit_id", F.col("__s") + F.col("__n") + F.lit(first_id - 1).cast("long")).drop("__p", "__n", "__s")
    parents = df.select(*keys, F.col("key").alias("parent_key"), F.col("unit_id").alias("parent_id")).dropDuplicates([*keys, "parent_key"])
    return df.join(parents, [*keys, "parent_key"], "left")


def version_metadata(path: str | None) -> str | None:
    """A version's metadata: where it was taken in from."""
    return None if path is None else json.dumps({"ingest_input_path": path}, ensure_ascii=False)


@dataclass(frozen=True)
class Version:
    """What is to be taken in beside the units: names, levels from the top, places in the taxonomy, source and input path."""

    corpus: str
    translation: str
    translator: str | None = None
    origin: str | None = None
    language: str = "en"
    levels: tuple[str, ...] = ()
    taxonomy: tuple[str, ...] = ()
    source_key: str | None = None
    url: str | None = None
    path: str | None = None


#: The tables that an ingest adds to, and their columns.
TABLES = {
    "corpus": "corpus_id long, name string, origin string",
    "version": "version_id long, corpus_id long, source_id long, translation string, translator string, language string, metadata string",
    "level": "corpus_id long, height int, name string",
    "source": "id long, source_key string, url string",
    "link": "corpus_id long, taxonomy_id long",
    "unit": "unit_id long, version_id long, corpus_id long, parent_id long, depth int, height int, label string, author string, text string, uncleaned_text string, path string, metadata string",
}


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def ingest(units: DataFrame, wanted: list[Version], tables: dict[str, DataFrame], taxonomy: DataFrame) -> dict[str, DataFrame]:
    """The rows that taking in the versions adds to each table, and `missing`: taxonomy names that there are not.

    units: corpus, translation and the columns of sources.corpora.UNIT; taxonomy: id, name. A version (corpus and translation) that
    exists is skipped whole; a corpus is made once; its levels and links are added where they are missing. A source key with
    another url is an error, and so is a unit from which no leaf is reached. What is wanted is a list, one entry a version.
    """
    spark = units.sparkSession
    rows = [(v.corpus, v.translation, v.translator, v.origin, v.language, list(v.levels), list(v.taxonomy), v.source_key, v.url, version_metadata(v.path)) for v in wanted]
    asked = spark.createDataFrame(rows, "corpus string, translation string, translator string, origin string, language string, levels array<string>, names array<string>, source_key string, url string, metadata string")
    known = tables["version"].join(tables["corpus"].select("corpus_id", F.col("name").alias("corpus")), "corpus_id").select("corpus", "translation")
    new = new_versions(asked, known)
    next_ids = lambda table, id_: tables[table].agg(F.coalesce(F.max(id_), F.lit(0))).first()[0]
    number = lambda df, order, top, name: df.withColumn(name, F.row_number().over(Window.orderBy(*order)) + F.lit(top).cast("long"))
    names = new.groupBy(F.col("corpus").alias("name")).agg(F.min("origin").alias("origin")).join(tables["corpus"].select("name"), "name", "left_anti")
    corpora = number(names, ["name"], next_ids("corpus", "corpus_id"), "corpus_id").select("corpus_id", "name", "origin")
    every = tables["corpus"].select("corpus_id", "name").unionByName(corpora.select("corpus_id", "name"))
    found = resolve_sources(new.filter("source_key is not null").select("source_key", "url").distinct(), tables["source"])
    sources = number(found.filter("source_id is null"), ["source_key"], next_ids("source", "id"), "id").select("id", "source_key", "url")
    source_of = found.filter("source_id is not null").select("source_key", "source_id").unionByName(sources.select("source_key", F.col("id").alias("source_id")))
    named = new.join(every.withColumnRenamed("name", "corpus"), "corpus").join(source_of, "source_key", "left")
    named = cut(number(named, ["corpus", "translation"], next_ids("version", "version_id"), "version_id"))
    versions = named.select("version_id", "corpus_id", "source_id", "translation", "translator", "language", "metadata")
    level = named.select("corpus_id", F.posexplode(F.reverse("levels")).alias("height", "name")).dropDuplicates(["corpus_id", "height"])
    levels = level.join(tables["level"], ["corpus_id", "height"], "left_anti").select("corpus_id", "height", "name")
    links, missing = link_taxonomy(named.select(F.col("corpus_id").alias("corpus"), "names"), taxonomy, tables["link"].select(F.col("corpus_id").alias("corpus"), "taxonomy_id"))
    mine = units.join(named.select("corpus", "translation", "corpus_id", "version_id"), ["corpus", "translation"])
    placed = cut(assign_ids(mine, next_ids("unit", "unit_id") + 1))
    with_path = placed.join(paths(placed).withColumnRenamed("id", "unit_id"), "unit_id").join(heights(placed, "unit_id").withColumnRenamed("id", "unit_id"), "unit_id", "left")
    checked = F.when(F.col("height").isNotNull(), F.col("height")).otherwise(F.raise_error(F.concat(F.lit("no height: unit "), "unit_id")).cast("int"))
    made = with_path.select("unit_id", "version_id", "corpus_id", "parent_id", "depth", checked.alias("height"), "label", "author", "text", "uncleaned_text", "path", "metadata")
    return {"corpus": corpora, "version": versions, "level": levels, "source": sources, "link": links.select(F.col("corpus").alias("corpus_id"), "taxonomy_id"), "unit": made, "missing": missing}


def normalise_sources(versions: DataFrame, catalog: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """versions (version_id, corpus, translation, ...) with source_id, and the sources there are then. Every version must have an
    entry in the catalogue (corpus, translation, source_key, url): an error names those that have none, and nothing is changed."""
    lost = versions.join(catalog.select("corpus", "translation"), ["corpus", "translation"], "left_anti").select("corpus", "translation").limit(20).collect()
    if lost:
        raise LookupError("no source for " + ", ".join(f"{r['corpus']} / {r['translation']}" for r in lost))
    used = catalog.join(versions.select("corpus", "translation").distinct(), ["corpus", "translation"], "left_semi").select("source_key", "url").distinct()
    found = resolve_sources(used, existing)
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = found.filter("source_id is null").withColumn("id", F.row_number().over(Window.orderBy("source_key")) + F.lit(top).cast("long"))
    ids = found.filter("source_id is not null").select("source_key", "source_id").unionByName(new.select("source_key", F.col("id").alias("source_id")))
    entry = catalog.select("corpus", "translation", "source_key").join(ids, "source_key")
    out = versions.drop("source_id").join(entry.select("corpus", "translation", "source_id"), ["corpus", "translation"])
    return out.select(*versions.drop("source_id").columns, "source_id"), existing.unionByName(new.select("id", "source_key", "url"))


def denormalise_sources(versions: DataFrame, sources: DataFrame) -> DataFrame:
    """The way back: versions with the url of their source instead of its id."""
    out = versions.join(sources.select(F.col("id").alias("source_id"), F.col("url").alias("source")), "source_id", "left")
    return out.drop("source_id").select(*(c for c in versions.columns if c != "source_id"), "source")


def resolve_sources(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """wanted (source_key, url) with source_id: by key, else by url, else null (to be inserted); an error if a key has another url."""
    by_key = existing.select("source_key", F.col("id").alias("k_id"), F.col("url").alias("k_url"))
    by_url = existing.select("url", F.col("id").alias("u_id"))
    both = wanted.join(by_key, "source_key", "left").join(by_url, "url", "left")
    ok = F.assert_true(F.col("k_url").isNull() | (F.col("k_url") == F.col("url")), "a source key has another url")
    return both.withColumn("source_id", F.when(ok.isNull(), F.coalesce("k_id", "u_id"))).select("source_key", "url", "source_id")


def link_taxonomy(hints: DataFrame, taxonomy: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New links (corpus, taxonomy_id) for hints (corpus, names), and the names that the taxonomy lacks."""
    h = hints.select("corpus", F.explode("names").alias("name"))
    links = h.join(taxonomy.select("name", F.col("id").alias("taxonomy_id")), "name").select("corpus", "taxonomy_id").distinct()
    return links.join(existing, ["corpus", "taxonomy_id"], "left_anti"), h.join(taxonomy.select("name"), "name", "left_anti").select("name").distinct()


def violations(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def _size_bounds(rows: DataFrame) -> list[tuple[int, int]]:
    """(-cost, unit_id) at which ranges of RANGE_BYTES of text begin, in order, but for the first. From a sample by size, about
    SAMPLED rows a range, by a hash of the id: texts larger than a sample's step all count, with their size."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    step = max(RANGE_BYTES // SAMPLED, 1)
    if total <= RANGE_BYTES:
        return []
    drawn = F.pmod(F.xxhash64("unit_id"), F.lit(1 << 30)) * step < F.col("size") * (1 << 30)
    sample = rows.filter(drawn).select((-F.col("cost")).alias("c"), F.col("unit_id").alias("u"), F.greatest("size", F.lit(step)).alias("size"))
    bounds, held = [], 0
    for r in sample.orderBy("c", "u").collect():
        if held and held + r["size"] > RANGE_BYTES:
            bounds.append((r["c"], r["u"]))
            held = 0
        held += r["size"]
    return bounds


def longest_first(rows: DataFrame) -> DataFrame:
    """rows (unit_id, cost, size, ...) by falling cost, then id: each partition in order, and the partitions one after another.
    A partition is a range of about RANGE_BYTES. Ranges of as many rows each, which a plain sort makes, would give one task
    the longest texts and most of the bytes."""
    bounds = _size_bounds(rows)
    if not bounds:
        return rows.coalesce(1).sortWithinPartitions(F.desc("cost"), "unit_id")
    starts = F.expr(f"array({', '.join(f'struct({c}L AS c, {u}L AS u)' for c, u in bounds)})")
    key = F.struct((-F.col("cost")).cast("long").alias("c"), F.col("unit_id").cast("long").alias("u"))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    # How many ranges begin at the row or before it, by halving.
    place = F.aggregate(steps, F.lit(0), lambda at, by: F.when((at + by <= len(bounds)) & (F.get(starts, at + by - 1) <= key), at + by).otherwise(at))
    return rows.withColumn("__range", place).repartitionById(len(bounds) + 1, "__range").sortWithinPartitions(F.desc("cost"), "unit_id").drop("__range")


def embed_queue(units: DataFrame, done: DataFrame) -> DataFrame:
    """unit_id, text, cost: leaf texts and the joined leaf texts of units of height 1, without those done, longest first
    (partition by partition; a page of it has to be ordered again). The texts are written once, to the shared folder."""
    leaf = units.filter("height = 0").filter(T.blank_to_null(F.col("text")).isNotNull())
    joined = leaf.groupBy(F.col("parent_id").alias("unit_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("unit_id", "text"))), lambda s: s["text"]), " ").alias("text"))
    todo = leaf.select("unit_id", "text").unionByName(joined).join(done.select("unit_id"), "unit_id", "left_anti")
    where = scratch_path(units.sparkSession, "queue")
    todo.select("unit_id", T.with_prefix(F.col("text"), "search_document").alias("text"), T.token_estimate(T.word_count(F.col("text"))).alias("cost"), F.octet_length("text").cast("long").alias("size")).write.parquet(where)
    return longest_first(units.sparkSession.read.parquet(where)).select("unit_id", "text", "cost")
