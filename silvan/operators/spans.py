"""Segmentation of leaves into overlapping spans of words.

Leaves of one parent are taken in order. They are gathered until the next one would go over the target; a leaf above the
maximum is cut into windows of the target's length, each moved back to a sentence end in its second half if there is
one, and overlapping the one before. Leaves are packed by their sizes alone (a parent's are one row, some bytes a leaf); only
then do the texts of one span meet, which the target bounds but for a single large leaf. A span's text is words joined by
single spaces, and its offsets are those of the collapsed leaf texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvan.functions import text as T
from silvan.functions.arrays import let, scan
from silvan.session import cut, scratch_path


def windows(words: Column, target: int, overlap: int) -> Column:
    """array<struct<lo, hi>> of word ranges [lo, hi) that cover the words.

    A window ends at most target words on; if that isn't the end, it moves back to the last sentence end from
    lo + max(1, target / 2) on. The next one begins overlap words before that end, but always later than this one.
    """
    half = max(1, target // 2)
    least = max(1, half - overlap)

    def cut(words: Column) -> Column:
        n = F.size(words)
        # Where a sentence ends: an end e closes with word e - 1, and 0 is none.
        ends = F.transform(words, lambda w, i: F.when(T.ends_sentence(w), i + 1).otherwise(0))
        rounds = F.sequence(F.lit(0), F.ceil(n / F.lit(least)).cast("int"))

        def lay(ends: Column) -> Column:
            def step(lo: Column, _: Column) -> tuple[Column, Column]:
                raw = F.least(lo + target, n)
                # Each step looks at the second half of its window, so all of them at about each word once.
                last = F.array_max(F.slice(ends, lo + half, F.lit(target - half + 1)))
                hi = F.when((raw < n) & (last > 0), last).otherwise(raw)
                window = F.when(lo < n, F.struct(lo.alias("lo"), hi.alias("hi")))
                return F.when(hi >= n, n).otherwise(F.greatest(lo + 1, hi - overlap)), window

            return F.filter(let(rounds, lambda r: scan(r, F.lit(0), "struct<lo:int,hi:int>", step)), lambda w: w.isNotNull())

        return let(ends, lay)

    return let(words, cut)


def pack(sizes: Column, target: int, most: int) -> Column:
    """Group number of each size, in order: a new group where the sum would go over target; a size above most stands alone."""
    return let(sizes, lambda v: _groups(F.transform(v, lambda s: F.struct(s.cast("long").alias("n"), F.lit(1).alias("parts"))), target, most))


def _groups(leaves: Column, target: int, most: int) -> Column:
    """For each (n, parts) the number of its group's first span: a group is as many spans as its leaf has parts."""

    def step(a: Column, x: Column) -> tuple[Column, Column]:
        alone = x["n"] > most
        new = alone | a["closed"] | (a["sum"] + x["n"] > target) | (a["next"] == 0)
        number = F.when(new, a["next"]).otherwise(a["number"])
        after = F.when(new, a["next"] + x["parts"]).otherwise(a["next"])
        return F.struct(number.alias("number"), after.alias("next"), F.when(new, x["n"]).otherwise(a["sum"] + x["n"]).alias("sum"), alone.alias("closed")), number

    start = F.struct(F.lit(0).alias("number"), F.lit(0).alias("next"), F.lit(0).cast("long").alias("sum"), F.lit(False).alias("closed"))
    return scan(leaves, start, "int", step)


def sized(leaves: DataFrame, target: int, overlap: int, most: int, keys: tuple[str, ...]) -> DataFrame:
    """keys, unit_id, text (collapsed), n (words), w (windows of a leaf above most, else null) of leaves with a word, written once."""
    spark = leaves.sparkSession
    clean = leaves.select(*keys, "unit_id", T.collapse_spaces(F.col("text")).alias("text")).filter("text != ''")
    # Between words of a collapsed text is one space.
    clean = clean.withColumn("n", F.length("text") - F.length(F.translate("text", " ", "")) + F.lit(1).cast("long"))
    clean = clean.withColumn("w", F.when(F.col("n") > most, windows(F.split("text", " "), target, overlap)))
    path = scratch_path(spark, "leaves")
    clean.write.parquet(path)
    return spark.read.schema(clean.schema).parquet(path)


def build(leaves: DataFrame, target: int, overlap: int, most: int, keys: tuple[str, ...] = ("version_id", "parent_id")) -> DataFrame:
    """One row per span and unit: keys, span_no (from 0 within the keys), kind, text, n_words, unit_id, unit_order, weight and, of
    a window of a leaf, its words from lo up to hi and the character `at` which it begins in the collapsed text.

    leaves: keys, unit_id (each one of its own), text; null or blank texts are left out. Leaves are packed and numbered by
    their sizes and numbers of windows alone. A leaf that is a span or more by itself stays where it is, and only the
    leaves of spans with several meet.
    """
    clean = sized(leaves, target, overlap, most, keys)
    one = F.struct("unit_id", "n", F.coalesce(F.size("w"), F.lit(1)).alias("parts"))
    lists = clean.select(*keys, one.alias("x")).groupBy(*keys).agg(F.sort_array(F.collect_list("x")).alias("l")).withColumn("g", _groups(F.col("l"), target, most))
    other = lambda g, i, x: F.coalesce(F.get(g, i) != x, F.lit(True))
    places = F.transform("g", lambda x, i: F.struct(F.get("l", i)["unit_id"].alias("unit_id"), x.alias("span_no"), (other(F.col("g"), i - 1, x) & other(F.col("g"), i + 1, x)).alias("alone")))
    placed = cut(lists.select(F.explode(places).alias("p")).select("p.*"))

    def of(alone: bool) -> DataFrame:
        return clean.join(placed.filter(F.col("alone") == alone).drop("alone"), "unit_id")

    none = F.lit(None).cast("int")
    out = [*keys, "span_no", "kind", "text", "n_words", "unit_id", "unit_order", "weight", "lo", "hi", "at"]

    def pieces(words: Column) -> Column:
        part = lambda lo, hi: F.array_join(F.slice(words, lo + 1, hi - lo), " ")
        # Where a window begins: what lies between the starts of windows, summed up.
        before = lambda i: F.coalesce(F.get("w", i - 1)["lo"], F.lit(0))
        steps = F.transform("w", lambda w, i: F.when(w["lo"] > before(i), F.length(part(before(i), w["lo"])) + 1).otherwise(0))
        starts = let(steps, lambda v: scan(v, F.lit(0), "int", lambda a, x: (a + x, a + x)))
        one = lambda w, at: F.struct(part(w["lo"], w["hi"]).alias("text"), (w["hi"] - w["lo"]).cast("long").alias("n_words"), w["lo"].alias("lo"), w["hi"].alias("hi"), at.alias("at"), F.lit("split-large-unit").alias("kind"))
        return let(starts, lambda v: F.transform("w", lambda w, i: one(w, F.get(v, i))))

    # The words are bound once; named inside the pieces, they would be split again for each.
    whole = F.array(F.struct("text", F.col("n").alias("n_words"), none.alias("lo"), none.alias("hi"), none.alias("at"), F.lit("single-unit").alias("kind")))
    parts = F.when(F.col("w").isNull(), whole).otherwise(let(F.split("text", " "), pieces))
    own = of(True).select(*keys, "unit_id", "span_no", F.posexplode(parts).alias("part", "p"))
    own = own.select(*keys, (F.col("span_no") + F.col("part")).alias("span_no"), "p.*", "unit_id", F.lit(0).alias("unit_order"), F.lit(1.0).alias("weight")).select(out)
    met = of(False).groupBy(*keys, "span_no").agg(F.sort_array(F.collect_list(F.struct("unit_id", "text", "n"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["text"]), " ")
    met = met.select(*keys, "span_no", F.lit("aggregate-small-units").alias("kind"), text.alias("text"), F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_words"), "l")
    met = met.select("*", F.length("text").alias("chars"), F.posexplode("l").alias("unit_order", "u"))
    met = met.select(*keys, "span_no", "kind", "text", "n_words", F.col("u.unit_id").alias("unit_id"), "unit_order", (F.length("u.text") / F.col("chars")).alias("weight"), none.alias("lo"), none.alias("hi"), none.alias("at")).select(out)
    return own.unionByName(met)
