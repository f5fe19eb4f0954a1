"""Small files in any folder that Spark reaches: written and read by the driver through the session's file system."""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def store(path: str):
    """pyarrow's file system for a path or URI, and the path in it: for tasks, which have no Spark session. file:/a and file:///a
    are the same to Spark; pyarrow takes the second."""
    from pyarrow import fs

    if path.startswith("file:/"):
        path = "file:///" + path[5:].lstrip("/")
    elif "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it isn't there."""
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def replace(spark: SparkSession, path: str, target: str) -> None:
    """Moves a file over another one in one step."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    hadoop = jvm.org.apache.hadoop.fs
    how = gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = getattr(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), "OVERWRITE")
    a, b = hadoop.Path(path), hadoop.Path(target)
    hadoop.FileContext.getFileContext(a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(a).toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(a, b, how)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """Replaces the file."""
    fs, where = _at(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, value) -> None:
    write_bytes(spark, path, json.dumps(value, indent=2, ensure_ascii=False).encode())


def read_json(spark: SparkSession, path: str):
    """FileNotFoundError if there is no such file."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
