"""The unit tree: closure, paths, heights, chains, leaves. Loops go level by level, as often as the tree is deep; a step joins
only the level before it with what is still to be reached, and its lineage is cut."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvan.session import cut


def closure(tree: DataFrame, id_: str = "id", parent: str = "parent_id") -> DataFrame:
    """ancestor, descendant, distance, each node with itself at 0. A node above itself is a cycle, and an error."""
    edges = tree.select(F.col(id_).alias("child"), F.col(parent).alias("up")).filter(F.col("up").isNotNull())
    level = tree.select(F.col(id_).alias("ancestor"), F.col(id_).alias("descendant"), F.lit(0).alias("distance"))
    out, k = [], 0
    while True:
        out.append(level)
        k += 1
        level = cut(level.join(edges, F.col("ancestor") == F.col("child")).select(F.col("up").alias("ancestor"), "descendant", F.lit(k).alias("distance")))
        found = level.agg(F.count("*"), F.max((F.col("ancestor") == F.col("descendant")).cast("int"))).first()
        if found[1]:
            raise ValueError("the tree has a cycle")
        if not found[0]:
            return reduce(DataFrame.unionByName, out)


def heights(tree: DataFrame, id_: str = "id", parent: str = "parent_id") -> DataFrame:
    """id, height: the shortest distance down to a leaf. A parent is reached from its first child; later ones change nothing.
    Nodes from which no leaf is reached, which are those on a cycle, have none and are left out (`without_height`)."""
    t = tree.select(F.col(id_).alias("id"), F.col(parent).alias("up"))
    ups = t.select(F.col("up").alias("id")).filter("id is not null").distinct()
    rest = cut(t.join(ups, "id", "left_semi"))
    wave = t.join(ups, "id", "left_anti")
    out, k = [wave.select("id", F.lit(0).alias("height"))], 0
    while True:
        k += 1
        wave = cut(rest.join(wave.select(F.col("up").alias("id")).distinct(), "id", "left_semi"))
        if wave.isEmpty():
            return reduce(DataFrame.unionByName, out)
        out.append(wave.select("id", F.lit(k).alias("height")))
        rest = cut(rest.join(wave.select("id"), "id", "left_anti"))


def without_height(tree: DataFrame, found: DataFrame, id_: str = "id") -> DataFrame:
    """Ids of the tree that `heights` gave no height."""
    return tree.select(F.col(id_).alias("id")).join(found.select("id"), "id", "left_anti")


def walk_down(tree: DataFrame, level: DataFrame, id_: str, parent: str, columns: dict) -> DataFrame:
    """All rows from level (id, ...) down; columns: how each further column follows from the parent's (named p_...) and the child's.
    In a tree no node is below itself, so the loop ends; a level that comes to a root again is a cycle, and an error."""
    t = tree.withColumns({"__id": F.col(id_), "__up": F.col(parent)})
    begun = level = cut(level)
    out = [level]
    while True:
        above = level.select(*(F.col(c).alias(f"p_{c}") for c in level.columns))
        level = cut(t.join(above, F.col("__up") == F.col("p_id")).select(F.col("__id").alias("id"), *(e.alias(c) for c, e in columns.items())))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, out)
        if not level.join(begun.select("id"), "id", "left_semi").isEmpty():
            raise ValueError("the tree has a cycle")
        out.append(level)


def paths(tree: DataFrame, label: str = "label", id_: str = "unit_id", parent: str = "parent_id") -> DataFrame:
    """id, path: the labels from the root down, each after a slash."""
    name = F.coalesce(F.nullif(F.col(label), F.lit("")), F.col(id_).cast("string"))
    top = tree.filter(F.col(parent).isNull()).select(F.col(id_).alias("id"), F.concat(F.lit("/"), name).alias("path"))
    return walk_down(tree, top, id_, parent, {"path": F.concat("p_path", F.lit("/"), name)})


def descendants(tree: DataFrame, root: int, id_: str = "unit_id", parent: str = "parent_id") -> DataFrame:
    """Ids below and with root, from the top: only the subtree is walked."""
    return walk_down(tree, tree.filter(F.col(id_) == root).select(F.col(id_).alias("id")), id_, parent, {})


def leaves(tree: DataFrame, root: int, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of the leaves under root by id; at most 500."""
    below = descendants(tree, root)
    return tree.filter("height = 0").join(below.withColumnRenamed("id", "unit_id"), "unit_id", "left_semi").orderBy("unit_id").offset(offset).limit(min(limit, 500))


def ancestors(tree: DataFrame, node: int, id_: str = "unit_id", parent: str = "parent_id") -> DataFrame:
    """id, place: from the root (0) to node itself. Walks up one row at a time, stops at a missing parent and before a node that
    it has met; empty if node is missing."""
    chain, here = [], node
    while here is not None and here not in chain:
        row = tree.filter(F.col(id_) == here).select(F.col(parent)).first()
        if row is None:
            break
        chain.append(here)
        here = row[0]
    rows = [(u, k) for k, u in enumerate(reversed(chain))]
    return tree.sparkSession.createDataFrame(rows, "id long, place int").withColumn("id", F.col("id").cast(tree.schema[id_].dataType))


def roots(tree: DataFrame, version: int | None = None) -> DataFrame:
    """Units without a parent of a version (of the lowest one if none is given), by depth and id."""
    if version is None:
        version = tree.agg(F.min("version_id")).first()[0]
    return tree.filter(F.col("parent_id").isNull() & (F.col("version_id") == version)).orderBy("depth", "unit_id")


def children_preview(tree: DataFrame, parent: int, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of direct children by depth and id, each with the number of its children and the first of them."""
    page = tree.filter(F.col("parent_id") == parent).orderBy("depth", "unit_id").offset(offset)
    page = page if limit is None else page.limit(limit)
    below = tree.join(page.select(F.col("unit_id").alias("parent_id")), "parent_id", "left_semi")
    first = below.groupBy("parent_id").agg(F.count("*").alias("n_children"), F.min_by(F.struct("unit_id", "label"), "unit_id").alias("first"))
    out = page.join(first.withColumnRenamed("parent_id", "unit_id"), "unit_id", "left")
    return out.select("unit_id", "label", "depth", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("first.unit_id").alias("first_child"), F.col("first.label").alias("first_label"))


def division(tree: DataFrame, id_: str = "unit_id", parent: str = "parent_id") -> DataFrame:
    """unit_id, division: the ancestor at depth 0, the unit itself if it is there; units that hang on none are left out."""
    top = tree.filter("depth = 0").select(F.col(id_).alias("id"), F.col(id_).alias("division"))
    return walk_down(tree, top, id_, parent, {"division": F.col("p_division")}).withColumnRenamed("id", id_)


def ancestor_per_height(tree: DataFrame, id_: str = "unit_id") -> DataFrame:
    """unit_id, height, ancestor for each height from 1."""
    h = tree.select(F.col(id_).alias("ancestor"), "height").filter("height >= 1")
    return closure(tree, id_).join(h, "ancestor").select(F.col("descendant").alias(id_), "height", "ancestor")


def first_level_below(tree: DataFrame, id_: str = "unit_id") -> DataFrame:
    """unit_id (height above 1), below: its descendants of height 1 with none of height 1 or less between; no rows if no unit is above height 1."""
    h = cut(tree.filter("height >= 1").select(F.col(id_).alias("id"), F.col("parent_id").alias("up"), "height"))
    level = h.filter("height > 1").select(F.col("id").alias("top"), "id")
    out = [h.select(F.col("id").alias(id_), F.col("id").alias("below")).limit(0)]
    while True:
        level = cut(level.withColumnRenamed("id", "up").join(h, "up").select("top", "id", "height"))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, out)
        if not level.filter("top = id").isEmpty():
            raise ValueError("the tree has a cycle")
        out.append(level.filter("height = 1").select(F.col("top").alias(id_), F.col("id").alias("below")))
        level = level.filter("height > 1").select("top", "id")
