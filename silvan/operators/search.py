"""Vector, keyword and passage search, comparison, defaults and result filters.

Id filters have three states: None leaves all, a list keeps its members, an empty list keeps nothing. Ranges count only
with both bounds. Orders always end with the id, so pages are stable.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from silvan.functions import vector as V


def keep_ids(df: DataFrame, column: str, ids: Sequence | None) -> DataFrame:
    if ids is None:
        return df
    return df.filter(F.col(column).isin(list(ids)) if ids else F.lit(False))


def keep_range(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    return df if low is None or high is None else df.filter(F.col(column).between(low, high))


def vector_of(df: DataFrame, id_: str, value: int, vector: str = "embedding") -> list[float]:
    """The one row's vector as doubles; LookupError if there is none."""
    row = df.filter(F.col(id_) == value).select(F.col(vector).cast("array<double>")).first()
    if row is None or row[0] is None:
        raise LookupError(f"no vector for {value}")
    return list(row[0])


def top_k(df: DataFrame, query: Sequence[float], k: int = 10, offset: int = 0, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The nearest rows by exact cosine distance, with score = 1 - distance to 4 places. Zero and null vectors come last.

    A batch is scored as one matrix and gives on only rows that can be among its first k + offset, ties included; the sort
    then keeps as many for each task.
    """
    q = np.asarray([float(x) for x in query])
    size, least = float(np.sqrt(q @ q)), k + offset

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(batch.column(vector), q, size)
            if len(d) > least:
                order = np.where(np.isnan(d), np.inf, d)
                keep = np.flatnonzero(order <= np.partition(order, least - 1)[least - 1]) if least else np.zeros(0, np.int64)
                batch, d = batch.take(pa.array(keep)), d[keep]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d, pa.float64(), from_pandas=True)], [*batch.schema.names, "distance"])

    schema = StructType([*df.drop("distance").schema.fields, StructField("distance", DoubleType())])
    page = df.drop("distance").mapInArrow(scored, schema).orderBy(F.col("distance").asc_nulls_last(), id_)
    page = page.offset(offset).limit(k) if offset else page.limit(k)
    return page.withColumn("score", F.bround(1 - F.col("distance"), 4)).drop("distance")


def _distances(column: pa.Array, q: np.ndarray, size: float) -> np.ndarray:
    """Cosine distances, NaN where a vector is null, zero or of another length."""
    out = np.full(len(column), np.nan)
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == len(q))
    if len(rows) and size:
        flat = column.take(pa.array(rows)).flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
        norms = np.sqrt(np.einsum("ij,ij->i", x, x))
        with np.errstate(invalid="ignore", divide="ignore"):
            out[rows] = np.where(norms > 0, 1 - (x @ q) / (norms * size), np.nan)
    return out


def without_units(spans: DataFrame, bridge: DataFrame, unit: int, span_id: str = "vec_id") -> DataFrame:
    """Spans that do not cover the unit."""
    covering = bridge.filter(F.col("unit_id") == unit).select(F.col("span_id").alias(span_id))
    return spans.join(covering, span_id, "left_anti")


def unit_vectors(bridge: DataFrame, vectors: DataFrame) -> DataFrame:
    """unit_id, vector: the weighted average of the spans that cover the unit, at unit length."""
    both = bridge.join(vectors.select(F.col("vec_id").alias("span_id"), "embedding"), "span_id")
    return V.weighted_average(both, "unit_id", "embedding", "weight")


def passage(unit: int, spans: DataFrame, bridge: DataFrame, own: DataFrame, k: int = 10, offset: int = 0) -> DataFrame:
    """The page of spans (vec_id, embedding) nearest to a unit among those that don't cover it.

    The query is the weighted average of the spans that cover the unit, else the unit's own vector (own: unit_id, vector);
    LookupError if it has neither.
    """
    covering = bridge.filter(F.col("unit_id") == unit)
    average = unit_vectors(covering, spans).filter("vector is not null")
    try:
        q = vector_of(average, "unit_id", unit, "vector")
    except LookupError:
        q = vector_of(own, "unit_id", unit, "vector")
    return top_k(without_units(spans, bridge, unit), q, k, offset)


def matches_any(query: str, *columns: str) -> Column:
    """A case-insensitive substring of any column; % and _ are wildcards, null is no match."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    return hit


def keyword(units: DataFrame, corpora: DataFrame, query: str, corpus_ids: Sequence | None = None, height: tuple = (None, None), depth: tuple = (None, None), limit: int = 20, offset: int = 0) -> DataFrame:
    df = units.join(corpora.select("corpus_id", F.col("name").alias("corpus")), "corpus_id")
    df = keep_range(keep_range(keep_ids(df, "corpus_id", corpus_ids), "height", *height), "depth", *depth)
    df = df.filter(matches_any(query, "text", "label", "path", "corpus"))
    return df.orderBy("unit_id").offset(offset).limit(limit).withColumn("score", F.lit(1.0))


def autocomplete(units: DataFrame, query: str, height: int | None = None, limit: int = 20) -> DataFrame:
    """By depth and id; at most 200."""
    df = units if height is None else units.filter(F.col("height") == height)
    return df.filter(matches_any(query, "text", "label", "path")).orderBy("depth", "unit_id").limit(min(limit, 200))


def compare(reference: int, requested: Sequence[int], vectors: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """place, unit_id, score to 6 places: cosine of each requested unit to the reference, in the order asked for, with
    repeats; units without a vector are left out. vectors and fallback: unit_id, vector; the first one's counts."""
    spark = vectors.sparkSession
    found = vectors
    if fallback is not None:
        found = vectors.unionByName(fallback.join(vectors.select("unit_id"), "unit_id", "left_anti"))
    asked = spark.range(1).select(F.posexplode(F.array(*(F.lit(int(u)) for u in requested))).alias("place", "unit_id"))
    found = found.filter(F.col("unit_id").isin([int(reference), *map(int, requested)]))
    q = vector_of(found, "unit_id", reference, "vector")
    score = F.bround(V.cosine_to(F.col("vector"), q), 6)
    return found.select("unit_id", score.alias("score")).join(F.broadcast(asked), "unit_id").orderBy("place").select("place", "unit_id", "score")


def default_row(df: DataFrame, column: str, preferred, id_: str) -> DataFrame:
    """The row with the preferred value, else the smallest."""
    return df.orderBy((F.col(column) == preferred).desc_nulls_last(), F.col(column), id_).limit(1)


def supports(bridge: DataFrame) -> DataFrame:
    """span_id, unit_ids in order."""
    return bridge.groupBy("span_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("unit_order", "unit_id"))), lambda s: s["unit_id"]).alias("unit_ids"))


def visible_results(results: DataFrame, bridge: DataFrame, visible: DataFrame, limit: int = 10) -> DataFrame:
    """Results (span_id, place) of which any support unit is visible, the first few."""
    seen = bridge.join(visible.select("unit_id"), "unit_id", "left_semi").select("span_id").distinct()
    return results.join(seen, "span_id", "left_semi").orderBy("place", "span_id").limit(limit)


def visible_units(units: DataFrame, hidden_corpora: Sequence = (), hidden_versions: Sequence = (), hidden_heights: Sequence = ()) -> DataFrame:
    for column, hidden in (("corpus_id", hidden_corpora), ("version_id", hidden_versions), ("height", hidden_heights)):
        if hidden:
            units = units.filter(~F.coalesce(F.col(column).isin(list(hidden)), F.lit(False)))
    return units
