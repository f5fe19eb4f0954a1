"""What a search shows: brief, detailed and span results, semantic search over spans or units, pages, groups and defaults."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvan.operators import search


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty; else the last one."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values[:-1]), values[-1])


def chains(links: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """corpus_id, taxonomy: the names above all links of a corpus, by level and id."""
    from silvan.operators.taxonomy import chain_union

    found = chain_union(links.withColumnRenamed("corpus_id", "corpus"), taxonomy)
    return found.select(F.col("corpus").alias("corpus_id"), F.col("chain").alias("taxonomy"))


def brief(units: DataFrame, corpora: DataFrame, versions: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """unit_id, label, path, height, depth, corpus, version and taxonomy (empty if there is none) of units.

    corpora: corpus_id, name; versions: version_id, translation; taxonomy: corpus_id, taxonomy.
    """
    named = units.join(corpora.select("corpus_id", F.col("name").alias("corpus")), "corpus_id").join(versions.select("version_id", F.col("translation").alias("version")), "version_id")
    named = named.join(taxonomy, "corpus_id", "left").withColumn("taxonomy", F.coalesce("taxonomy", F.array().cast("array<string>")))
    return named.select("unit_id", "label", "path", "height", "depth", "corpus", "version", "taxonomy")


def detail(units: DataFrame, corpora: DataFrame, versions: DataFrame, taxonomy: DataFrame, sources: DataFrame) -> DataFrame:
    """brief with text, uncleaned_text (null where units have none) and source_url (null without a source). sources: version_id, url."""
    uncleaned = F.col("uncleaned_text") if "uncleaned_text" in units.columns else F.lit(None).cast("string")
    more = units.join(sources.select("version_id", F.col("url").alias("source_url")), "version_id", "left").select("unit_id", "text", uncleaned.alias("uncleaned_text"), "source_url")
    return brief(units, corpora, versions, taxonomy).join(more, "unit_id")


def has_vectors(spans: DataFrame, method: Column | None = None) -> bool:
    """Whether there is any span vector (of the method): one row is looked for, not counted."""
    return not (spans if method is None else spans.filter(method)).limit(1).isEmpty()


def span_results(hits: DataFrame, spans: DataFrame, units: DataFrame, corpora: DataFrame, versions: DataFrame, bridge: DataFrame) -> DataFrame:
    """Hits (span_id, score) with their span, start unit, corpus, version and support units.

    spans: span_id, start_unit_id, end_unit_id, label, path. An empty label or path is the start unit's; a span without
    support units has its start unit.
    """
    held = bridge.join(hits.select("span_id"), "span_id", "left_semi")
    start = units.select(F.col("unit_id").alias("start_unit_id"), "corpus_id", "version_id", "height", F.col("label").alias("unit_label"), F.col("path").alias("unit_path"))
    star = hits.join(spans, "span_id").join(start, "start_unit_id").join(corpora.select("corpus_id", F.col("name").alias("corpus")), "corpus_id")
    star = star.join(versions.select("version_id", F.col("translation").alias("version")), "version_id").join(search.supports(held), "span_id", "left")
    return star.select(
        "span_id", first_filled(F.col("label"), F.col("unit_label")).alias("label"), first_filled(F.col("path"), F.col("unit_path")).alias("path"), "corpus", "version", "height", "score",
        F.coalesce("unit_ids", F.array("start_unit_id")).alias("support_unit_ids"), "start_unit_id", "end_unit_id", F.col("start_unit_id").alias("primary_unit_id"),
    )


def semantic_hits(query: Sequence[float], span_vectors: DataFrame, unit_vectors: DataFrame, k: int = 10, offset: int = 0) -> DataFrame:
    """kind (span or unit), id, score of the nearest: spans if any has a vector, else units. Both tables: id, vector."""
    kind, vectors = ("span", span_vectors) if has_vectors(span_vectors) else ("unit", unit_vectors)
    found = search.top_k(vectors.select("id", "vector"), query, k, offset, "id", "vector")
    return found.select(F.lit(kind).alias("kind"), "id", "score")


def semantic_search(encode: Callable[[str], Sequence[float]], text: str, span_vectors: DataFrame, unit_vectors: DataFrame, k: int = 10, offset: int = 0) -> DataFrame:
    """semantic_hits of a text; encode gives its vector on the driver and is handed the prefix for queries."""
    return semantic_hits(encode(f"search_query: {text}"), span_vectors, unit_vectors, k, offset)


def page(df: DataFrame, order: Sequence[Column | str], size: int, offset: int = 0) -> DataFrame:
    """A page with `more`: whether it is full, and so another one may follow."""
    rows = df.orderBy(*order).offset(offset).limit(size)
    return rows.withColumn("more", F.count("*").over(Window.partitionBy()) == size)


def by_corpus(results: DataFrame, order: str, least_query: int = 2, query: str | None = None) -> DataFrame:
    """corpus, place, units: a page of results under their corpora, these in the order of their first result; a query shorter
    than least_query characters gives nothing."""
    if query is not None and len(query.strip()) < least_query:
        results = results.limit(0)
    grouped = results.groupBy("corpus").agg(F.min(order).alias("first"), F.transform(F.sort_array(F.collect_list(F.struct(order, "unit_id"))), lambda x: x["unit_id"]).alias("units"))
    return grouped.select("corpus", (F.row_number().over(Window.orderBy("first")) - 1).alias("place"), "units")


def recent(df: DataFrame, time: str, id_: str, keep: int = 20) -> DataFrame:
    """The newest rows first, a bounded history."""
    return df.orderBy(F.col(time).desc(), F.col(id_).desc()).limit(keep)


def reading_unit(primary: Column, start: Column, supports: Column, id_: Column) -> Column:
    """The unit at which a result is read."""
    return F.coalesce(primary, start, F.try_element_at(supports, F.lit(1)), id_)


def chosen_ids(chosen: Sequence[int], all_ids: Sequence[int]) -> list[int] | None:
    """None, that is no filter, if none or all are chosen."""
    picked = set(chosen)
    return None if not picked or picked >= set(all_ids) else sorted(picked)


def labels(units: DataFrame, projected: DataFrame, compared: DataFrame | None = None) -> DataFrame:
    """unit_id, label: a comparison's, else the unit's own, else the projection's. All three: unit_id, label."""
    first = units.select("unit_id", F.col("label").alias("own")).join(projected.select("unit_id", F.col("label").alias("drawn")), "unit_id", "full")
    if compared is None:
        return first.select("unit_id", F.coalesce("own", "drawn").alias("label"))
    said = compared.select("unit_id", F.col("label").alias("said"))
    return first.join(said, "unit_id", "full").select("unit_id", F.coalesce("said", "own", "drawn").alias("label"))


def level_names(corpora: DataFrame, levels: DataFrame, low: int, high: int, missing: str = "passage") -> DataFrame:
    """corpus_id, level_name: what a range of heights is called in each corpus: heights above its highest level are that one's,
    others the nearest level at or below them; one name, or two joined by a dash."""
    ordered = levels.groupBy("corpus_id").agg(F.sort_array(F.collect_list(F.struct("height", "name"))).alias("l"))

    def nearest(height: int) -> Column:
        wanted = F.least(F.lit(height), F.element_at("l", -1)["height"])
        below = F.filter("l", lambda x: x["height"] <= wanted)
        return F.coalesce(F.try_element_at(below, F.lit(-1)), F.element_at("l", 1))["name"]

    both = F.when(nearest(low) == nearest(high), nearest(low)).otherwise(F.concat_ws(" – ", nearest(low), nearest(high)))
    named = ordered.select("corpus_id", both.alias("level_name"))
    return corpora.select("corpus_id").join(named, "corpus_id", "left").select("corpus_id", F.coalesce("level_name", F.lit(missing)).alias("level_name"))


def child_titles(units: DataFrame, levels: DataFrame, missing: str = "Level") -> DataFrame:
    """unit_id, title of what is below each unit that isn't a leaf: the level's name in the plural."""
    below = levels.select("corpus_id", (F.col("height") + 1).alias("height"), "name")
    df = units.filter("height > 0").join(below, ["corpus_id", "height"], "left").withColumn("name", F.coalesce("name", F.lit(missing)))
    return df.select("unit_id", F.when(F.col("name").endswith("s"), F.col("name")).otherwise(F.concat("name", F.lit("s"))).alias("title"))


def top_height(levels: DataFrame) -> DataFrame:
    """max_height over all corpora's levels, 0 without any."""
    return levels.agg(F.greatest(F.lit(0), F.coalesce(F.max("height"), F.lit(0))).alias("max_height"))


def corpus_info(corpora: DataFrame, versions: DataFrame, levels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """corpus_id, name, versions (by id), levels (by height) and taxonomy, as arrays that may be empty."""
    nest = lambda df, c, *fields: df.groupBy("corpus_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(c))
    out = corpora.select("corpus_id", "name").join(nest(versions, "versions", "version_id", "translation"), "corpus_id", "left").join(nest(levels, "levels", "height", F.col("name").alias("level")), "corpus_id", "left").join(taxonomy, "corpus_id", "left")
    return out.withColumn("taxonomy", F.coalesce("taxonomy", F.array().cast("array<string>")))


def resolve(df: DataFrame, column: str, names: Sequence[str], id_: str) -> list:
    """Ids of rows by exact names, in the order asked for; LookupError names those that are missing."""
    found = {r[column]: r[id_] for r in df.filter(F.col(column).isin(list(names))).select(column, id_).limit(len(set(names)) + 1).collect()}
    missing = [n for n in names if n not in found]
    if missing:
        raise LookupError(", ".join(missing))
    return [found[n] for n in names]


def listing(df: DataFrame, order: str, *columns: str) -> DataFrame:
    """The columns of a small table in its order: methods, or profiles by their target."""
    return df.select(*columns).orderBy(order)
