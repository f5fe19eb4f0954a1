"""Interval labels of a tree: the place at which a walk from the top comes to a node and the last place below it.

With them a subtree is a range of places and a node's ancestors are the intervals around its place, so either is one
filter over one table, however deep the tree. They are made at ingest, level by level, and written in order of place, so
that a range reads the row groups it is in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silvan.operators.sequences import numbered_across
from silvan.operators.tree import walk_down


def with_intervals(tree: DataFrame, id_: str = "unit_id", parent: str = "parent_id") -> DataFrame:
    """tree with `enter` and `leave`: places from 1, roots and children in order of their ids. A node that hangs on no root (its
    parent is missing, or it is on a cycle) is left out.

    A node's way from its root orders the walk; a subtree's size is the number of ways that its node is on.
    """
    top = tree.filter(F.col(parent).isNull()).select(F.col(id_).alias("id"), F.array(id_).alias("way"))
    ways = walk_down(tree, top, id_, parent, {"way": F.concat("p_way", F.array(id_))})
    placed = numbered_across(ways, [], ["way"], "enter")
    sizes = ways.select(F.explode("way").alias("id")).groupBy("id").agg(F.count("*").alias("size"))
    labels = placed.join(sizes, "id").select(F.col("id").alias(id_), "enter", (F.col("enter") + F.col("size") - 1).alias("leave"))
    return tree.join(labels, id_)


def write(labelled: DataFrame, path: str) -> None:
    """A table in order of place."""
    labelled.repartitionByRange("enter").sortWithinPartitions("enter").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _of(labelled: DataFrame, node: int, id_: str) -> tuple[int, int]:
    """An interval; one that holds nothing if there is no such node."""
    row = labelled.filter(F.col(id_) == node).select("enter", "leave").first()
    return (row[0], row[1]) if row else (1, 0)


def subtree(labelled: DataFrame, node: int, id_: str = "unit_id") -> DataFrame:
    """The rows of node and all below it."""
    enter, leave = _of(labelled, node, id_)
    return labelled.filter(F.col("enter").between(enter, leave))


def ancestors(labelled: DataFrame, node: int, id_: str = "unit_id") -> DataFrame:
    """The rows from the root to node itself, with their place (from 0) in the chain; none if node is missing."""
    enter, leave = _of(labelled, node, id_)
    around = labelled.filter(F.col("enter") <= enter).filter((F.col("leave") >= leave) if leave else F.lit(False))
    # As many rows as the tree is deep, in one window.
    return around.withColumn("place", F.row_number().over(Window.orderBy("enter")) - 1)


def leaves(labelled: DataFrame, node: int, limit: int = 200, offset: int = 0, id_: str = "unit_id") -> DataFrame:
    """A page of the leaves of the subtree by id; at most 500."""
    return subtree(labelled, node, id_).filter("height = 0").orderBy(id_).offset(offset).limit(min(limit, 500))
