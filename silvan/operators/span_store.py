"""Spans as tables of a folder: spans, bridge and vectors of profiles, changed as a whole.

A profile's rows of a table are Parquet folders of their own under `data`, and `current.json` names those that count. A
change writes new folders and moves that file last, in one step, for all tables together: a reader has the state before
or after it, and one that has begun reads on, as old folders stay until `clean`. A change that is broken off leaves folders
that nothing names. Changes are made by one writer at a time.

A second build of a profile is refused unless it replaces, which takes away the profile's vectors, bridge rows and spans,
or those of some corpora only.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvan.functions import text as T
from silvan.sources import files

TABLES = ("span_vectors", "bridge", "spans")


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing with the rows of new in place of those with the same key, and after the others."""
    return existing.join(new.select(key), key, "left_anti").select(*existing.columns).unionByName(new)


def get_or_create(existing: DataFrame, wanted: DataFrame, keys: Sequence[str], id_: str) -> DataFrame:
    """existing and those of wanted that it lacks by keys, which get the next ids in the order of their keys. A table of names:
    as many rows as there are methods, profiles or corpora."""
    from pyspark.sql import Window

    top = existing.agg(F.coalesce(F.max(id_), F.lit(0))).first()[0]
    new = wanted.join(existing.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))
    new = new.withColumn(id_, (F.row_number().over(Window.orderBy(*keys)) + F.lit(top)).cast(existing.schema[id_].dataType))
    return existing.unionByName(new.select(*existing.columns))


def _state(spark: SparkSession, folder: str) -> dict[str, dict[str, list[str]]]:
    """For each table the names of the folders that hold a profile's rows."""
    path = f"{folder}/current.json"
    return files.read_json(spark, path) if files.exists(spark, path) else {t: {} for t in TABLES}


def _commit(spark: SparkSession, folder: str, state: dict) -> None:
    files.write_json(spark, f"{folder}/next.json", state)
    files.replace(spark, f"{folder}/next.json", f"{folder}/current.json")


def _write(rows: DataFrame, folder: str, table: str, profile: int) -> str:
    """Rows of one profile, without its column, in a new folder; the folder's name."""
    name = f"{table}-{uuid.uuid4().hex}"
    rows.drop("profile_id").write.parquet(f"{folder}/data/{name}/profile_id={profile}")
    return name


def _rows(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (spark.read.parquet(f"{folder}/data/{n}") for n in names))


def read(spark: SparkSession, folder: str, table: str, schema: str | None = None) -> DataFrame:
    """The table as it is now; without rows, an empty one of the schema, or LookupError if none is given."""
    names = [n for of in _state(spark, folder).get(table, {}).values() for n in of]
    if names:
        return _rows(spark, folder, names)
    if schema is None:
        raise LookupError(f"{folder}: {table}")
    return spark.createDataFrame([], schema)


def metadata(**fields) -> str:
    """Fields as a JSON text with the names in order."""
    import json

    return json.dumps(fields, sort_keys=True, ensure_ascii=False)


def drafts(built: DataFrame, profile: int) -> tuple[DataFrame, DataFrame]:
    """Spans and bridge rows of what `spans.build` gives, with character offsets in the collapsed leaf texts.

    built: version_id, parent_id, span_no, kind, text, n_words, unit_id, unit_order, weight, lo, hi, at and, of the
    unit, unit_text, label, path, corpus_id. A span of several units begins at 0 and ends with its last leaf's length.
    """
    span = F.xxhash64(F.lit(profile), "version_id", "parent_id", "span_no")
    leaf = T.collapse_spaces(F.col("unit_text"))
    start = F.coalesce("at", F.lit(0))
    stop = F.when(F.col("lo").isNotNull(), start + F.length("text")).otherwise(F.length(leaf))
    df = built.withColumns({"span_id": span, "profile_id": F.lit(profile), "start": start.cast("int"), "stop": stop.cast("int")})
    bridge = df.select("profile_id", "span_id", "unit_id", "unit_order", F.col("start").alias("char_start"), F.col("stop").alias("char_end"), F.col("weight").alias("coverage_weight"))
    first, last = (lambda c: F.min_by(c, "unit_order")), (lambda c: F.max_by(c, "unit_order"))
    spans = df.groupBy("profile_id", "span_id", "version_id", "corpus_id", "kind").agg(
        F.first("text").alias("text"), F.first("n_words").alias("word_count"), F.first(F.length("text")).alias("char_count"), first("unit_id").alias("start_unit_id"), last("unit_id").alias("end_unit_id"),
        first("start").alias("start_char"), last("stop").alias("end_char"), T.span_label(first("label"), last("label")).alias("label"), first("path").alias("path"), F.count("*").alias("units"),
    )
    made = F.to_json(F.struct(F.col("kind").alias("segmentation"), "units"))
    return spans.withColumns({"token_count": F.col("word_count"), "metadata": made}).drop("units"), bridge


def insert(folder: str, profile: int, spans: DataFrame, bridge: DataFrame, replace: bool = False, corpora: Sequence[int] | None = None) -> None:
    """Adds a profile's spans and bridge (with profile_id). If it has spans (of these corpora) already: an error, or with replace
    they go in the same step, together with their bridge rows and vectors."""
    spark = spans.sparkSession
    state = _state(spark, folder)
    held = state["spans"].get(str(profile))
    if held:
        old = _rows(spark, folder, held)
        mine = old if corpora is None else old.filter(F.col("corpus_id").isin(list(corpora)))
        if not mine.limit(1).isEmpty():
            if not replace:
                raise ValueError(f"profile {profile} has spans already")
            state = _without(spark, folder, state, profile, corpora)
    for table, rows in (("spans", spans), ("bridge", bridge)):
        state[table].setdefault(str(profile), []).append(_write(rows, folder, table, profile))
    _commit(spark, folder, state)


def add_vectors(folder: str, profile: int, vectors: DataFrame) -> None:
    """Adds vectors of a profile's spans."""
    spark = vectors.sparkSession
    state = _state(spark, folder)
    state["span_vectors"].setdefault(str(profile), []).append(_write(vectors, folder, "span_vectors", profile))
    _commit(spark, folder, state)


def delete(spark: SparkSession, folder: str, profile: int, corpora: Sequence[int] | None = None) -> None:
    """Takes away a profile's vectors, bridge rows and spans, or those of some corpora, in one step."""
    _commit(spark, folder, _without(spark, folder, _state(spark, folder), profile, corpora))


def _without(spark: SparkSession, folder: str, state: dict, profile: int, corpora: Sequence[int] | None) -> dict:
    """The state with new folders of what stays of the profile; nothing is changed in the old ones."""
    key = str(profile)
    out = {table: dict(of) for table, of in state.items()}
    spans = out["spans"].get(key)
    if corpora is None or not spans:
        for table in TABLES:
            out[table].pop(key, None)
        return out
    gone = _rows(spark, folder, spans).filter(F.col("corpus_id").isin(list(corpora))).select("span_id")
    for table in TABLES:
        names = out[table].pop(key, None)
        if names:
            rest = _write(_rows(spark, folder, names).join(gone, "span_id", "left_anti"), folder, table, profile)
            if not spark.read.parquet(f"{folder}/data/{rest}").isEmpty():
                out[table][key] = [rest]
    return out


def clean(spark: SparkSession, folder: str) -> list[str]:
    """Deletes the folders that the current state doesn't name, when no reader of an older one is left; their names."""
    named = {n for of in _state(spark, folder).values() for names in of.values() for n in names}
    old = [n for n in files.listed(spark, f"{folder}/data") if n not in named]
    for n in old:
        files.delete(spark, f"{folder}/data/{n}")
    return old


def report(spans: DataFrame) -> DataFrame:
    """profile_id, spans, tokens_min, tokens_avg, tokens_max of each profile."""
    return spans.groupBy("profile_id").agg(F.count("*").alias("spans"), F.min("token_count").alias("tokens_min"), F.bround(F.avg("token_count"), 4).alias("tokens_avg"), F.max("token_count").alias("tokens_max"))
