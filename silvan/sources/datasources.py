"""Data sources for `spark.read.format` and `write.format`: tables of SQLite files, and the units and spans of projection runs.

`register(spark)` names them `silvan_sqlite` and `silvan_run`. Filters reach the sources: a SQLite table takes comparisons as
conditions of its own, a run reads only the files of the versions that are asked for. Files are opened by tasks through
pyarrow by their URI.

A run's writer has a task write the files of the versions that it holds and give on their counts; the manifest and the
pointer to the newest run are written when all tasks have ended, so a run that is broken off leaves the old pointer. A
version (or the spans) is one file whose columns lie one after another, so a task holds a version's columns: 4 bytes for
each of a unit's 3 + K numbers.
"""

from __future__ import annotations

import json
import posixpath
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from silvan.sources import projection_file as layout
from silvan.sources.files import store

#: Rows of a batch that a source gives on.
BATCH = 50_000

# ---- SQLite ----

#: Spark types of SQLite's declared types, by what they hold in capitals: its own rules of affinity, in their order.
AFFINITIES = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))
_COMPARISONS = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def _name(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


def connect(path: str) -> sqlite3.Connection:
    """A file that is here is opened in place, without locks; any other one's bytes are read into memory."""
    files, where = store(path)
    if files.type_name == "local":
        return sqlite3.connect(f"file:{quote(where)}?mode=ro&immutable=1", uri=True)
    con = sqlite3.connect(":memory:")
    with files.open_input_file(where) as f:
        con.deserialize(f.readall())
    return con


@dataclass
class Rows(ds.InputPartition):
    """Rows of a table from one rowid up to another; without bounds, all."""

    low: int | None = None
    high: int | None = None


class SqliteReader(ds.DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, partitions: int):
        self.path, self.table, self.schema, self.n = path, table, schema, partitions
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters):
        text = {f.name for f in self.schema if f.dataType.simpleString() == "string"}
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            plain = lambda v: isinstance(v, str) if column in text else isinstance(v, int | float) and not isinstance(v, bool)
            if type(f) in _COMPARISONS and column and plain(f.value):
                self.where.append(f"{_name(column)} {_COMPARISONS[type(f)]} ?")
                self.values.append(f.value)
            elif isinstance(f, ds.In) and column and all(map(plain, f.value)):
                self.where.append(f"{_name(column)} in ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif isinstance(f, ds.IsNotNull) and column:
                self.where.append(f"{_name(column)} is not null")
            else:
                yield f
                continue
            # A value of another type than its column's is compared in SQLite's way, so Spark looks once more.
            yield f

    def partitions(self):
        with connect(self.path) as con:
            try:
                low, high = con.execute(f"select min(rowid), max(rowid) from {_name(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a view, or a table without row ids
                return [Rows()]
        if low is None or self.n < 2:
            return [Rows()]
        cuts = [low + (high + 1 - low) * k // self.n for k in range(self.n + 1)]
        return [Rows(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        where, values = list(self.where), list(self.values)
        if partition.low is not None:
            where.append("rowid >= ? and rowid < ?")
            values += [partition.low, partition.high]
        sql = f"select {', '.join(_name(f.name) for f in self.schema)} from {_name(self.table)}" + (f" where {' and '.join(where)}" if where else "")
        arrow = to_arrow_schema(self.schema)
        with connect(self.path) as con:
            cursor = con.execute(sql, values)
            while rows := cursor.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(_typed(c, f.type), f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def _typed(values, kind: pa.DataType) -> list:
    """SQLite's cells have types of their own: text for a column of text; null for what a number or bytes can't be made of."""

    def one(v):
        if v is None or pa.types.is_string(kind):
            return v if v is None or isinstance(v, str) else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
        if pa.types.is_binary(kind):
            return v if isinstance(v, bytes) else str(v).encode()
        return v if isinstance(v, int | float) else None

    return [one(v) for v in values]


class SqliteSource(ds.DataSource):
    """Options: path, table, and partitions (1 by default): ranges of row ids that are read by tasks of their own."""

    @classmethod
    def name(cls) -> str:
        return "silvan_sqlite"

    def schema(self) -> str:
        with connect(self.options["path"]) as con:
            columns = con.execute(f"pragma table_info({_name(self.options['table'])})").fetchall()
        if not columns:
            raise LookupError(self.options["table"])
        of = lambda kind: next((spark for part, spark in AFFINITIES if part in kind.upper()), "string")
        return ", ".join(f"`{c[1].replace('`', '``')}` {of(c[2])}" for c in columns)

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], schema, int(self.options.get("partitions", 1)))


# ---- projection runs ----

UNIT_FIELDS = ("unit_id", "corpus_id", "version_id")
SPAN_COLUMNS = ("span_id", "corpus_id", "version_id", *layout.SPAN_FIELDS)


@dataclass
class Stretch(ds.InputPartition):
    """Some rows of one file of a run."""

    file: str
    start: int
    count: int
    rows: int


class RunReader(ds.DataSourceReader):
    def __init__(self, folder: str, spans: bool, rows: int, least: int):
        self.folder, self.spans, self.step, self.least = folder, spans, rows, least
        self.versions: set[int] | None = None

    def pushFilters(self, filters):
        for f in filters:
            if not self.spans and isinstance(f, ds.EqualTo | ds.In) and f.attribute == ("version_id",):
                mine = set(f.value) if isinstance(f, ds.In) else {f.value}
                self.versions = mine if self.versions is None else self.versions & mine
            else:
                yield f

    def _manifest(self) -> dict:
        files, where = store(self.folder)
        with files.open_input_file(posixpath.join(where, "manifest.json")) as f:
            manifest = json.loads(f.readall())
        layout.check_version(manifest)
        return manifest

    def partitions(self):
        manifest = self._manifest()
        files, where = store(self.folder)
        if self.spans:
            named = ["spans.bin"] if manifest["has_span_layer"] else []
        else:
            named = [f"corpus_version_{v}.bin" for v in manifest["corpus_version_ids"] if self.versions is None or v in self.versions]
        width = 4 * (len(SPAN_COLUMNS if self.spans else UNIT_FIELDS) + manifest["n_components"])
        out = []
        for name in named:
            path = posixpath.join(where, name)
            with files.open_input_file(path) as f:
                n, size = int.from_bytes(f.read(4), "little"), f.size()
            if size != 4 + n * width:
                raise ValueError(f"{name}: the length does not fit the count")
            out += [Stretch(name, at, min(self.step, n - at), n) for at in range(0, n, self.step)]
        return out or [Stretch("", 0, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        k = self._manifest()["n_components"]
        names = SPAN_COLUMNS if self.spans else UNIT_FIELDS
        files, where = store(self.folder)
        with files.open_input_file(posixpath.join(where, partition.file)) as f:
            # Columns lie one after another: the ids, the components, all else.
            def column(c: int, kind: str) -> np.ndarray:
                raw = f.read_at(4 * partition.count, 4 + 4 * (c * partition.rows + partition.start))
                if len(raw) != 4 * partition.count:
                    raise ValueError(f"{partition.file} has changed")
                return np.frombuffer(raw, kind)

            ints = [column(0, "<i4"), *(column(1 + k + c, "<i4") for c in range(len(names) - 1))]
            coords = np.zeros((partition.count, max(k, self.least)), np.float32)
            for c in range(k):
                coords[:, c] = column(1 + c, "<f4")
        width = coords.shape[1]
        for at in range(0, partition.count, BATCH):
            some = coords[at : at + BATCH]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(some) + 1, max(width, 1), np.int32) if width else np.zeros(len(some) + 1, np.int32)), pa.array(some.ravel()))
            yield pa.RecordBatch.from_arrays([*(pa.array(v[at : at + BATCH].astype(np.int64)) for v in ints), lists], [*names, "coords"])


@dataclass
class Written(ds.WriterCommitMessage):
    """What a task has written: rows of each version (None for spans), the greatest depth and the number of components."""

    rows: dict = field(default_factory=dict)
    depth: int = 0
    components: int = 0
    names: dict = field(default_factory=dict)


class RunWriter(ds.DataSourceArrowWriter):
    """Batches come clustered by version and sorted by id (`write_run` sees to it). A task's files have names of its attempt
    until the commit gives them theirs."""

    def __init__(self, options: dict, spans: bool):
        self.options, self.spans = dict(options), spans

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names = SPAN_COLUMNS if self.spans else UNIT_FIELDS
        out, version, held = Written(), None, []
        for batch in iterator:
            if not batch.num_rows:
                continue
            versions = np.zeros(batch.num_rows, np.int64) if self.spans else batch.column("version_id").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(versions)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and versions[a] != version:
                    self._file(out, version, held)
                    held = []
                version = int(versions[a])
                part = batch.slice(a, b - a)
                flat, n = part.column("coords").flatten().to_numpy(zero_copy_only=False).astype("<f4"), part.num_rows
                held.append([[part.column(c).to_numpy() for c in names], flat.reshape(n, -1)])
                if "depth" in batch.schema.names:
                    out.depth = max(out.depth, int(np.max(part.column("depth").to_numpy(zero_copy_only=False))))
        if held:
            self._file(out, version, held)
        return out

    def _file(self, out: Written, version: int, held: list) -> None:
        if version in out.rows:
            raise ValueError("rows are not in order of their version")
        ints = [np.concatenate([h[0][c] for h in held]) for c in range(len(held[0][0]))]
        coords = np.concatenate([h[1] for h in held])
        raw = layout.encode(ints[0], coords, *ints[1:])
        name = f"_{uuid.uuid4().hex}.part"
        files, where = store(self.options["path"])
        files.create_dir(where, recursive=True)
        with files.open_output_stream(posixpath.join(where, name)) as f:
            f.write(raw)
        out.rows[version], out.components = len(ints[0]), coords.shape[1]
        out.names[version] = name

    def commit(self, messages) -> None:
        found = [m for m in messages if m]
        files, where = store(self.options["path"])
        files.create_dir(where, recursive=True)
        rows: dict[int, int] = {}
        for m in found:
            for version, name in m.names.items():
                if version in rows:
                    raise ValueError(f"version {version} was written by two tasks")
                rows[version] = m.rows[version]
                files.move(posixpath.join(where, name), posixpath.join(where, "spans.bin" if self.spans else f"corpus_version_{version}.bin"))
        facts = {"n_components": max((m.components for m in found), default=0)}
        if self.spans:
            facts |= {"span_count": rows.get(0, 0)}
        else:
            facts |= {"max_depth": max((m.depth for m in found), default=0), "corpus_version_ids": sorted(rows), "corpus_version_counts": {str(v): rows[v] for v in sorted(rows)}}
        with files.open_output_stream(posixpath.join(where, "spans.facts.json" if self.spans else "units.facts.json")) as f:
            f.write(json.dumps(facts).encode())

    def abort(self, messages) -> None:
        files, where = store(self.options["path"])
        for m in messages:
            for name in (m.names.values() if m else ()):
                files.delete_file(posixpath.join(where, name))


class RunSource(ds.DataSource):
    """Options: path (a run's folder), layer (units or spans), rows (of a task) and least (components that are filled up to)."""

    @classmethod
    def name(cls) -> str:
        return "silvan_run"

    def _spans(self) -> bool:
        return self.options.get("layer", "units") == "spans"

    def schema(self) -> str:
        return ", ".join(f"{c} long" for c in (SPAN_COLUMNS if self._spans() else UNIT_FIELDS)) + ", coords array<float>"

    def reader(self, schema: StructType) -> RunReader:
        return RunReader(self.options["path"], self._spans(), int(self.options.get("rows", 1_000_000)), int(self.options.get("least", 0 if self._spans() else 3)))

    def writer(self, schema: StructType, overwrite: bool) -> RunWriter:
        return RunWriter(self.options, self._spans())


def register(spark: SparkSession) -> None:
    """Names the sources in the session, and has its filters pushed to sources of their kind."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (SqliteSource, RunSource):
        spark.dataSource.register(source)


def read_sqlite_table(spark: SparkSession, path: str, table: str, partitions: int = 1) -> DataFrame:
    register(spark)
    return spark.read.format("silvan_sqlite").option("table", table).option("partitions", partitions).load(path)
