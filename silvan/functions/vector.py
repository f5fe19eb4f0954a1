"""Vectors as array columns: products, cosines, weighted averages by position."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Product over the shorter length."""
    pairs = F.zip_with(_doubles(a), _doubles(b), lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def cosine_distance(a: Column, b: Column) -> Column:
    """Null if either is zero, so that it sorts last."""
    size = norm(a) * norm(b)
    return F.when(size > 0, 1 - dot(a, b) / size)


def normalise(v: Column) -> Column:
    """At unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(_doubles(v), lambda x: x / n)).otherwise(_doubles(v))


def parse_vector(text: Column) -> Column:
    """'[1,2]' as an array of floats."""
    return F.from_json(text, "array<float>")


def cosine_to(v: Column, query: Sequence[float]) -> Column:
    """Cosine to a given vector, whose norm is worked out here and not in each row; 0 if either is zero."""
    q = F.array(*(F.lit(float(x)) for x in query))
    size = math.sqrt(sum(float(x) * float(x) for x in query))
    return F.when(norm(v) * size == 0, F.lit(0.0)).otherwise(dot(v, q) / (norm(v) * F.lit(size)))


def weighted_average(df: DataFrame, key: str, vector: str, weight: str, unit_length: bool = True) -> DataFrame:
    """key, vector: the average by weight, where a weight that is not positive counts as 1; null vectors are left out, and a
    key's vectors have one length. A task sends one sum for each key, so a key with very many rows isn't gathered anywhere."""
    w = F.when(F.col(weight) > 0, F.col(weight)).otherwise(F.lit(1.0)).cast("double")
    rows = df.filter(F.col(vector).isNotNull()).select(key, array_to_vector(_doubles(F.col(vector))).alias("v"), w.alias("w"))
    mean = rows.groupBy(key).agg(Summarizer.mean(F.col("v"), F.col("w")).alias("m")).select(key, vector_to_array("m").alias("v"))
    return mean.select(key, (normalise(F.col("v")) if unit_length else F.col("v")).alias("vector"))
