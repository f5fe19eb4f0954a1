"""Connected components of a table of links by alternating large and small stars.

Every step is a join and a pre-aggregated minimum, so a node with very many links is not gathered anywhere; each round's
links are written to the shared folder, which cuts the lineage. Rounds go on until all links form stars, whose centres
are the smallest ids: about log(n) rounds for long chains, one or two for what near-duplicate groups look like.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvan.llm.common import materialise


def _is_stars(links: DataFrame) -> bool:
    """No node above two others, and no centre above another."""
    twice = links.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    return not twice and not links.select(F.col("v").alias("u")).distinct().join(links.select("u"), "u", "left_semi").limit(1).count()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the smallest id of its component) for each id that is not itself the smallest. Null ends are ignored."""
    links = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = materialise(links, "links")
    while not _is_stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialise(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "small-star")
    return links.select(F.col("u").alias("id"), F.col("v").alias("component"))
