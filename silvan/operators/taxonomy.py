"""The taxonomy forest, its many-to-many links to corpora, and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silvan.operators.tree import closure, paths, walk_down


def chain_union(links: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """corpus, chain: the names of all nodes above any of its links, by level and id."""
    up = closure(taxonomy).select(F.col("descendant").alias("taxonomy_id"), F.col("ancestor").alias("id"))
    nodes = links.join(up, "taxonomy_id").select("corpus", "id").distinct().join(taxonomy, "id")
    return nodes.groupBy("corpus").agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "id", "name"))), lambda s: s["name"]).alias("chain"))


def chain_last_link(links: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """As chain_union, but only the last link, the one with the largest id, counts."""
    return chain_union(links.groupBy("corpus").agg(F.max("taxonomy_id").alias("taxonomy_id")), taxonomy)


def grouping(links: DataFrame, taxonomy: DataFrame, level: int = 0, missing: str = "Uncategorized") -> DataFrame:
    """grp, n, corpora (sorted): corpora under each node of a level; those under none are under `missing`."""
    up = closure(taxonomy).join(taxonomy.filter(F.col("level") == level).select(F.col("id").alias("ancestor"), "name"), "ancestor")
    names = links.join(up.select(F.col("descendant").alias("taxonomy_id"), "name"), "taxonomy_id", "left")
    pairs = names.select("corpus", F.coalesce("name", F.lit(missing)).alias("grp")).distinct()
    return pairs.groupBy("grp").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("corpus")), ",").alias("corpora"))


def printed(taxonomy: DataFrame, links: DataFrame) -> DataFrame:
    """path, depth, n_corpora of each node, to be read in the order of path, letters without case."""
    n = links.groupBy(F.col("taxonomy_id").alias("id")).agg(F.count("*").alias("n"))
    p = paths(taxonomy, "name", "id").join(taxonomy.select("id", "level"), "id")
    return p.join(n, "id", "left").select(F.lower("path").alias("path"), F.col("level").alias("depth"), F.coalesce("n", F.lit(0)).alias("n_corpora"))


def forest(taxonomy: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """nth, id, name, level, depth, top, parent_id, corpora of each node in reading order: roots and children by level, name
    without case and id, and after the roots' trees those of nodes whose parent is missing. corpora: (corpus_id, corpus) of
    the node's links (corpus_id, taxonomy_id, corpus) by name and id. Nodes on a cycle hang on nothing and are left out."""
    t = taxonomy.select("id", "name", "level", "parent_id")
    there = t.select(F.col("id").alias("parent_id"), F.lit(True).alias("found"))
    rank = F.struct(F.col("level"), F.lower("name").alias("name"), F.col("id"))
    tops = t.join(there, "parent_id", "left").filter("found is null")
    # A way of ranks from the top orders the walk; orphans' trees come after the others.
    own = F.struct(F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("orphan"), F.array(rank).alias("way"))
    step = F.struct(F.col("p_place.orphan").alias("orphan"), F.concat(F.col("p_place.way"), F.array(rank)).alias("way"))
    walked = walk_down(t, tops.select("id", own.alias("place")), "id", "parent_id", {"place": step})
    # A taxonomy is a small table: its nodes are numbered in one window.
    out = walked.withColumn("nth", F.row_number().over(Window.orderBy("place"))).join(t, "id")
    out = out.select("nth", "id", "name", "level", (F.size("place.way") - 1).alias("depth"), F.col("place.way")[0]["id"].alias("top"), "parent_id")
    none = F.array().cast("array<struct<corpus_id:bigint,corpus:string>>")
    if links is None:
        return out.withColumn("corpora", none)
    held = links.groupBy(F.col("taxonomy_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("corpus", "corpus_id"))).alias("c"))
    named = F.transform("c", lambda x: F.struct(x["corpus_id"].cast("long").alias("corpus_id"), x["corpus"].alias("corpus")))
    return out.join(held, "id", "left").withColumn("corpora", F.coalesce(named, none)).drop("c").select(*out.columns, "corpora")


def forest_json(rows: DataFrame) -> str:
    """The rows of `forest` as nested JSON, roots first."""
    import json

    out: list[dict] = []
    line: list[dict] = []  # the nodes from the top down to the one before
    for r in rows.orderBy("nth").toLocalIterator():
        node = {"id": r["id"], "name": r["name"], "level": r["level"], "corpora": [c.asDict() for c in r["corpora"]], "children": []}
        line = line[: r["depth"]]
        (line[-1]["children"] if line else out).append(node)
        line.append(node)
    return json.dumps(out, ensure_ascii=False)


def seed(spark, ordered: list[tuple[str, str | None]], existing: DataFrame | None = None) -> DataFrame:
    """id, name, parent, level for (name, parent) in order, parents first; names that exist stay as they are."""
    level: dict[str, int] = {}
    for name, parent in ordered:
        if parent is not None and parent not in level:
            raise ValueError(f"{parent} comes after {name}")
        level[name] = 0 if parent is None else level[parent] + 1
    df = spark.createDataFrame([(i + 1, n, p, level[n]) for i, (n, p) in enumerate(ordered)], "id long, name string, parent string, level int")
    if existing is None:
        return df
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = df.join(existing.select("name"), "name", "left_anti")
    new = new.withColumn("id", F.row_number().over(Window.orderBy("id")) + F.lit(top).cast("long"))
    return existing.unionByName(new.select(existing.columns))
