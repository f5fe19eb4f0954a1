"""What the training-data operators share: the white-space rule, shared scratch tables and edge cases of inputs."""

from __future__ import annotations

import gc
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silvan.functions.arrays import scan

#: White space of every word rule here: space and the control characters tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, read from the session.

    Only in local mode, where driver and executors are one process, an unset folder falls back to one of this machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file:///tmp/checkpoints/silvan"


_open = threading.local()


def _delete(spark: SparkSession, paths: list[str], at_exit: bool = False) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        files = where.getFileSystem(conf)
        files.deleteOnExit(where) if at_exit else files.delete(where, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It goes with the innermost `scratch`, else when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/silvan/{name}-{uuid.uuid4().hex}"
    _delete(spark, [path], at_exit=True)
    scopes = getattr(_open, "scopes", [])
    if scopes:
        scopes[-1].append(path)
    return path


def release(spark: SparkSession) -> None:
    """Has the driver look for plans that are no longer held, so that their broadcasts and shuffle files go now, here and on
    executors, and not when its heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What is materialised inside is deleted at the end, but for what the function it gives has written: the results."""
    scopes = _open.__dict__.setdefault("scopes", [])
    mine: list[str] = []
    scopes.append(mine)

    def keep(df: DataFrame, name: str) -> DataFrame:
        held = scopes.pop()
        try:
            return materialise(df, name)
        finally:
            scopes.append(held)

    try:
        yield keep
    finally:
        scopes.remove(mine)
        _delete(spark, mine)
        release(spark)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: lineage is cut there, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each int of the array the combination of all before it, `zero` for the first. values should be bound by `let`."""
    return scan(values, zero, "int", lambda a, x: (combine(a, x), a))


def words_of(text: Column) -> Column:
    """The words of a text, in order: maximal runs without white space. Null: null."""
    return F.array_remove(F.split(text, SPACE), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of df whatever their names hold."""
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
