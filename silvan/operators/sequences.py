"""Running operators over ordered rows: ranks, counters, next starts, forward fills, sessions, and texts put together in order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvan.session import cut


def _ordered(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def numbered(df: DataFrame, keys: Sequence[str], order: str, name: str = "nth") -> DataFrame:
    """df with a counter from 1 within keys."""
    return df.withColumn(name, F.row_number().over(_ordered(keys, order)).cast("long"))


def numbered_across(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "nth") -> DataFrame:
    """`numbered` for keys with more rows than a task should hold, and for no keys at all.

    Rows are dealt by ranges of keys and order, counted within a range's part of a key, and shifted by the counts of the
    ranges before it. The ranges are written once (a checkpoint), as a second reading could cut them elsewhere.
    """
    ranged = cut(df.repartitionByRange(*keys, *order).withColumn("__p", F.spark_partition_id()))
    part = ["__p", *keys]
    # One row for each range and key in it, and of a key one for each of its ranges.
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    start = ranged.groupBy(*part).count().withColumn("__s", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long")))
    start = start.select("__s", *(F.col(c).alias(f"__{k}") for k, c in enumerate(part)))
    same = reduce(lambda a, b: a & b, (ranged[c].eqNullSafe(start[f"__{k}"]) for k, c in enumerate(part)))
    nth = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    return ranged.withColumn("__n", nth).join(start, same).withColumn(name, F.col("__s") + F.col("__n")).select(*df.columns, name)


def next_start(df: DataFrame, keys: Sequence[str], order: str, name: str = "block_end") -> DataFrame:
    """df with the place where the next row begins, null for the last: a block ends there."""
    return df.withColumn(name, F.lead(order).over(_ordered(keys, order)))


def filled(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str) -> DataFrame:
    """df with the latest value that is not null, the row's own included."""
    return df.withColumn(name, F.last(value, True).over(_ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def sessions(df: DataFrame, keys: Sequence[str], order: str, ends: Column, name: str = "session") -> DataFrame:
    """df with a number from 0: a session goes up to the row that ends it; what is left after the last end is one too."""
    before = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(ends.cast("long")).over(before), F.lit(0).cast("long")))


def ordered_text(df: DataFrame, keys: Sequence[Column | str], order: str, text: str = "text", separator: str = " ") -> DataFrame:
    """keys, text: the texts of each key put together in order. A key's texts are one row."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return df.groupBy(*keys).agg(F.array_join(parts, separator).alias("text"))
