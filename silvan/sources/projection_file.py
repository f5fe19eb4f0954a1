"""The projection's binary layout, little-endian: count, int32 ids, K float32 components, int32 corpus and version ids, and
for spans also int32 start, end and primary units and token counts.

A run is a folder base/method[/profile]/run with a file for each corpus version, one for the spans, the labels and a manifest;
latest.json beside the runs names the newest. Parquet is what this engine works on; the layout is written and read for other
programs, so ids have to fit 32 bits, which is checked, and a version, or the spans, one file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silvan.sources import files as small

#: The layout's version; older ones are refused.
SCHEMA_VERSION = 5


#: What a span's record has more than a unit's.
SPAN_FIELDS = ("start_unit_id", "end_unit_id", "primary_unit_id", "token_count")
#: The profile whose runs may lie directly under the method.
OLD_PROFILE = "window-50"


def _int32(values) -> bytes:
    v = np.asarray(values, np.int64)
    if len(v) and (v.min() < -(1 << 31) or v.max() >= 1 << 31):
        raise ValueError("an id does not fit 32 bits")
    return v.astype("<i4").tobytes()


def encode(ids, coords, corpus_ids, version_ids, *more) -> bytes:
    n = len(ids)
    coords = np.asarray(coords, "<f4").reshape(n, -1)
    parts = [np.array([n], "<u4").tobytes(), _int32(ids), *(np.ascontiguousarray(coords[:, k]).tobytes() for k in range(coords.shape[1])), *map(_int32, (corpus_ids, version_ids, *more))]
    return b"".join(parts)


def decode(raw: bytes, components: int):
    """ids, coords (n x components), corpus ids, version ids; ValueError if the length does not fit."""
    n = int(np.frombuffer(raw, "<u4", 1)[0]) if len(raw) >= 4 else -1
    if len(raw) != 4 + 4 * n * (3 + components):
        raise ValueError("the length does not fit the count")
    ids = np.frombuffer(raw, "<i4", n, 4)
    coords = np.frombuffer(raw, "<f4", n * components, 4 + 4 * n).reshape(components, n).T
    rest = np.frombuffer(raw, "<i4", 2 * n, 4 + 4 * n * (1 + components)).reshape(2, n)
    return ids, coords, rest[0], rest[1]


def check_version(manifest: dict) -> None:
    if int(manifest.get("bin_schema_version", 0)) < SCHEMA_VERSION or manifest.get("has_corpus_version_ids") is False:
        raise ValueError(f"layout version {SCHEMA_VERSION} or later is needed")


def _root(base: str, method: str, profile: str | None) -> str:
    return f"{base}/{method}" + (f"/{profile}" if profile else "")


def _write_labels(labels: DataFrame, path: str) -> None:
    """Labels by unit as one JSON object in the order of ids, which one task streams into the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = small.store(path)
        n = 0
        with files.open_output_stream(where) as f:
            f.write(b"{")
            for batch in batches:
                for unit, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    f.write((",\n" if n else "\n").encode() + json.dumps(str(unit)).encode() + b": " + json.dumps(label, ensure_ascii=False).encode())
                    n += 1
            f.write(b"\n}")
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    named = labels.filter("label is not null").select("unit_id", "label").orderBy("unit_id").coalesce(1)
    named.mapInArrow(run, "n long").collect()


def write_run(points: DataFrame, labels: DataFrame, base: str, method: str, run_id: str, created_at: str, profile: dict | None = None, spans: DataFrame | None = None, **more) -> dict:
    """Writes a run and moves the pointer to it last; the manifest. points: unit_id, corpus_id, version_id, depth, coords;
    labels: unit_id, label; profile: its fields, label among them. Rows go from tasks to files; the driver has their counts."""
    from silvan.sources import datasources as sources

    spark = points.sparkSession
    sources.register(spark)
    name = profile["label"] if profile else None
    folder = f"{_root(base, method, name)}/{run_id}"
    out = lambda df, layer: df.write.format("silvan_run").mode("append").option("layer", layer).save(folder)
    rows = points.select(*(F.col(c).cast("long").alias(c) for c in sources.UNIT_FIELDS), F.col("depth").cast("int").alias("depth"), F.col("coords").cast("array<float>").alias("coords"))
    out(rows.repartition("version_id").sortWithinPartitions("version_id", "unit_id"), "units")
    facts = small.read_json(spark, f"{folder}/units.facts.json")
    n_spans = 0
    if spans is not None:
        out(spans.select(*(F.col(c).cast("long").alias(c) for c in sources.SPAN_COLUMNS), F.col("coords").cast("array<float>").alias("coords")).repartition(1).sortWithinPartitions("span_id"), "spans")
        n_spans = small.read_json(spark, f"{folder}/spans.facts.json")["span_count"]
        small.delete(spark, f"{folder}/spans.facts.json")
    small.delete(spark, f"{folder}/units.facts.json")
    _write_labels(labels, f"{folder}/unit_labels.json")
    manifest = {
        "run_id": run_id, "created_at": created_at, "method": method, "bin_schema_version": SCHEMA_VERSION, "has_corpus_version_ids": True, "has_span_layer": spans is not None, "span_count": n_spans,
        "embedding_profile": profile, **facts, **more,
    }
    small.write_json(spark, f"{folder}/manifest.json", manifest)
    small.write_json(spark, f"{_root(base, method, name)}/latest.json", {"run_id": run_id})
    return manifest


def latest_id(spark: SparkSession, base: str, method: str, profile: str | None = None) -> str:
    """The newest run's id; for OLD_PROFILE the method's own pointer is tried next."""
    tried = [_root(base, method, profile)] + ([_root(base, method, None)] if profile == OLD_PROFILE else [])
    for folder in tried:
        if small.exists(spark, f"{folder}/latest.json"):
            return small.read_json(spark, f"{folder}/latest.json")["run_id"]
    raise FileNotFoundError(f"{tried[0]}/latest.json")


def find_run(spark: SparkSession, base: str, method: str, run_id: str, profile: str | None = None) -> tuple[str, dict]:
    """Folder and manifest of a run: base/method/profile/run, else the older base/run/method, else base/method/run."""
    for folder in (f"{_root(base, method, profile)}/{run_id}", f"{base}/{run_id}/{method}", f"{_root(base, method, None)}/{run_id}"):
        if small.exists(spark, f"{folder}/manifest.json"):
            manifest = small.read_json(spark, f"{folder}/manifest.json")
            check_version(manifest)
            return folder, manifest
    raise FileNotFoundError(f"{method}/{run_id}")


def read_run(spark: SparkSession, base: str, method: str, profile: str | None = None, run_id: str | None = None, least: int = 3) -> tuple[DataFrame, DataFrame | None, dict]:
    """Points, spans (None if the run has none) and manifest of a run, the newest by default."""
    from silvan.sources import datasources as sources

    sources.register(spark)
    folder, manifest = find_run(spark, base, method, run_id or latest_id(spark, base, method, profile), profile)
    held = lambda layer: spark.read.format("silvan_run").option("layer", layer).option("least", least if layer == "units" else 0).load(folder)
    return held("units"), held("spans") if manifest["has_span_layer"] else None, manifest


def version_of(path: Column) -> Column:
    """The corpus version that a file's name says."""
    return F.regexp_extract(path, r"corpus_version_(\d+)\.bin$", 1).cast("long")


def latest_runs(spark: SparkSession, path: str) -> DataFrame:
    """method, profile and the newest run of each, from manifests or pointer files that say when they were made."""
    p = spark.read.schema("method string, profile string, run_id string, created_at string").json(path, multiLine=True)
    return p.groupBy("method", "profile").agg(F.max_by("run_id", "created_at").alias("run_id"))
