"""Coverage and length audits. Percentiles are the sorted value at min(n - 1, int(n * p)); deviations are of the population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvan.functions import text as T


def _measured(units: DataFrame) -> DataFrame:
    clean = F.coalesce(T.collapse_spaces(F.col("text")), F.lit(""))
    full = clean != ""
    return units.withColumns({"full": full, "chars": F.when(full, F.length("text").cast("long")), "n_words": F.when(full, T.word_count(F.col("text")))})


def _coverage() -> list[Column]:
    n = F.count("*")
    full = F.sum(F.col("full").cast("long"))
    r = lambda c: F.bround(c, 4)
    return [
        n.alias("total"), full.alias("nonempty"), (n - full).alias("empty"), r(100 * full / n).alias("coverage_pct"),
        r(F.avg("chars")).alias("chars_avg"), F.min("chars").alias("chars_min"), F.max("chars").alias("chars_max"),
        r(F.avg("n_words")).alias("words_avg"), F.min("n_words").alias("words_min"), F.max("n_words").alias("words_max"),
    ]


def coverage_by_level(units: DataFrame) -> DataFrame:
    return _measured(units).groupBy("corpus_id", "version_id", "height", "depth").agg(*_coverage())


def coverage_by_version(units: DataFrame) -> DataFrame:
    groups = F.countDistinct(F.struct(F.coalesce("height", F.lit(-1)), "depth")).alias("n_groups")
    return _measured(units).groupBy("corpus_id", "version_id").agg(
        *_coverage(), F.min("height").alias("height_min"), F.max("height").alias("height_max"), F.min("depth").alias("depth_min"), F.max("depth").alias("depth_max"), groups
    )


def leaf_lengths(units: DataFrame, corpora: DataFrame) -> DataFrame:
    """One row per corpus, with nulls and 0 where it has no leaf text."""
    m = _measured(units).filter("height = 0 and full")
    stats = [F.count("*").alias("n")]
    for c in ("chars", "n_words"):
        stats += [F.bround(F.avg(c), 4).alias(f"{c}_mean"), F.bround(F.stddev_pop(c), 4).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return corpora.select("corpus_id", "name").join(m.groupBy("corpus_id").agg(*stats), "corpus_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def leaf_histogram(units: DataFrame, bins: int = 70) -> DataFrame:
    """corpus_id, bin, n, density over equal bins from the least to the greatest number of words."""
    m = _measured(units).filter("height = 0 and full").select("corpus_id", "n_words")
    ends = m.groupBy("corpus_id").agg(F.min("n_words").alias("low"), F.max("n_words").alias("high"), F.count("*").alias("all"))
    width = F.greatest((F.col("high") - F.col("low")) / F.lit(float(bins)), F.lit(1e-9))
    place = F.least(F.floor((F.col("n_words") - F.col("low")) / width), F.lit(bins - 1)).cast("long")
    counted = m.join(ends, "corpus_id").groupBy("corpus_id", place.alias("bin"), "all", width.alias("width")).agg(F.count("*").alias("n"))
    return counted.select("corpus_id", "bin", "n", F.bround(F.col("n") / (F.col("all") * F.col("width")), 6).alias("density"))


def picked(df: DataFrame, keys: list[str], value: str, **shares: float) -> DataFrame:
    """For each key the value at min(n - 1, int(n * share)) of its sorted values.

    Values are first counted, so what is sorted is distinct values and their numbers, not rows.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    upto = F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"last": upto - 1, "first": upto - F.col("c"), "n": F.sum("c").over(w)})
    at = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p)).cast("long"))
    pick = lambda p: F.max(F.when(at(p).between(F.col("first"), F.col("last")), F.col(value)))
    return ranked.groupBy(*keys).agg(*(pick(p).alias(name) for name, p in shares.items()))


def length_percentiles(units: DataFrame, limit: int = 8192) -> DataFrame:
    """Over all units of height 1: estimated tokens of their leaves' text: min, median, p95, p99, max, how many are over the limit."""
    leaf = units.filter("height = 0").select(F.col("parent_id").alias("unit_id"), T.word_count(F.col("text")).alias("w"))
    tokens = leaf.groupBy("unit_id").agg(T.token_estimate(F.sum("w")).alias("tokens"))
    over = F.sum((F.col("tokens") > limit).cast("long"))
    base = tokens.groupBy(F.lit(1).alias("k")).agg(F.count("*").alias("n"), F.min("tokens").alias("least"), F.max("tokens").alias("most"), over.alias("n_over"), F.bround(100 * over / F.count("*"), 4).alias("pct_over"))
    return base.join(picked(tokens.withColumn("k", F.lit(1)), ["k"], "tokens", median=0.5, p95=0.95, p99=0.99), "k").drop("k")


def span_audit(spans: DataFrame, bridge: DataFrame) -> DataFrame:
    """spans: span_id, profile, corpus, tokens; bridge: span_id, unit_id, start, stop. Spans without links are not seen."""
    per = bridge.groupBy("span_id").agg(F.count("*").alias("u"), F.sum(((F.col("start") != 0) & F.col("stop").isNotNull()).cast("long")).alias("overlaps"))
    s = spans.join(per, "span_id")
    keys = ["profile", "corpus"]
    units = spans.join(bridge, "span_id").groupBy(*keys).agg(F.countDistinct("unit_id").alias("n_units"))
    base = s.groupBy(*keys).agg(
        F.count("*").alias("span_count"), F.min("tokens").alias("tokens_min"), F.bround(F.avg("tokens"), 4).alias("tokens_avg"), F.max("tokens").alias("tokens_max"),
        F.bround(F.avg("u"), 4).alias("units_per_span"), F.sum("u").alias("links"), F.sum("overlaps").alias("overlapping_links"),
    )
    out = base.join(picked(s, keys, "tokens", tokens_p95=0.95), keys).join(units, keys)
    return out.withColumn("spans_per_unit", F.bround(F.col("links") / F.col("n_units"), 4)).drop("links", "n_units")


def inventory(versions: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """Versions by corpus name and id, with safe labels; ids: only these corpora."""
    v = versions if ids is None else versions.filter(F.col("corpus_id").isin(sorted(set(ids))))
    safe = lambda c, other: F.when(F.coalesce(F.trim(c), F.lit("")) == "", other).otherwise(c)
    return v.select("version_id", "corpus_id", safe(F.col("source"), F.concat(F.lit("Version "), F.col("version_id").cast("string"))).alias("translation"), safe(F.col("lang"), F.lit("Unknown")).alias("language")).orderBy("language", "version_id")
